from zlib import crc32

import numpy as np

from tickspark.llm import quality_classifier, queries, toxicity

SF = "/root/testdata/sf0.01"


def evaluated(spark, query, label, folds, fold):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = query(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (crc32(str(r.doc_id).encode()) % folds == fold) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    own = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    return np.array(own)


def test_quality_on_held_out_rows(spark):
    own = evaluated(spark, queries.op8_quality_classifier, "quality", 5, 0)
    good, bad = own[own[:, 1] == 1, 0], own[own[:, 1] == 0, 0]
    assert good.mean() > 0.9 and bad.mean() < 0.3


def test_toxicity_on_held_out_rows(spark):
    own = evaluated(spark, queries.op5_toxicity, "toxic", 4, 2)
    toxic, clean = own[own[:, 1] == 1, 0], own[own[:, 1] == 0, 0]
    assert toxic.mean() > 0.6 and clean.mean() < 0.05


def test_labels_of_the_fold_change_nothing(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").limit(300), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.selectExpr("doc_id", "if(pmod(crc32(cast(doc_id as string)), 5) = 0, 1 - quality, quality) quality", "toxic")
    a = quality_classifier.train(docs, labels)
    b = quality_classifier.train(docs, turned)
    assert np.array_equal(a.weights, b.weights) and a.cut == b.cut


def test_no_labels_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, "x"), (1, "idiot moron scum", "y"), (None, "", "z"), (3, "w " * 30_000, "z")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality_classifier.classify(docs, none).collect()} == {0.5}
    out = toxicity.classify(docs, none).collect()
    assert sorted(r.predicted for r in out) == [0, 0, 0, 1] and [r.held_out for r in out if r.doc_id is None] == [True]
    assert toxicity.classify(docs.where("false"), none).count() == quality_classifier.classify(docs.where("false"), none).count() == 0


def test_label_model_weighs_voters():
    rng = np.random.default_rng(4)
    y = rng.random(3000) < 0.2
    good = [np.where(rng.random(3000) < 0.9, np.where(y, 1, -1), 0) * np.where(rng.random(3000) < 0.93, 1, -1) for _ in range(4)]
    noise = np.where(rng.random(3000) < 0.3, 1, 0)
    votes = np.array([*good, noise, noise, noise]).T.astype(np.int8)  # a voter that is repeated must not win by number
    gold = np.where(rng.random(3000) < 0.1, y, -1)
    post = toxicity.label_model(votes, gold)
    assert ((post > 0.5) == y).mean() > 0.97
