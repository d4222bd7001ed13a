from collections import defaultdict
from zlib import crc32

import numpy as np

from pyspark.sql import functions as F

from tickspark.llm import queries, sharding
from tickspark.llm._common import materialize


def test_curve_visits_every_cell_by_unit_steps():
    for dims, bits in ((2, 3), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        place = sharding.hilbert_index(grid, bits)
        assert sorted(place) == list(range(len(grid)))
        path = grid[np.argsort(place)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def check(rows, texts, shards=40):
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted(i for i in texts if i is not None)
    size = {i: len((t or "").encode()) + 16 for i, t in texts.items()}
    per, groups = defaultdict(list), defaultdict(set)
    for r in rows:
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (size[r.doc_id], crc32((texts[r.doc_id] or "").encode()), "bytes", None)
        assert 0 <= r.shard < shards
        per[r.shard].append(r)
        groups[texts[r.doc_id] or ""].add(r.shard)
    for own in per.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    total = sum(size.values())
    n = defaultdict(int)
    for t in texts.values():
        n[t or ""] += 1
    slack = 2 * max(max(size.values()), sharding.WHOLE * total / shards)
    for s in range(shards):
        assert abs(sum(r.size for r in per[s]) - total / shards) <= slack
    for t, where in groups.items():
        if n[t] * (len(t.encode()) + 16) <= sharding.WHOLE * total / shards:
            assert len(where) == 1
        assert len(where) == max(where) - min(where) + 1


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    check(queries.op10_sharding(spark, sf_dir).collect(), texts)


def test_hot_group_nulls_and_ties(spark):
    rows = [(i, "same text", "en", "s1", 0) for i in range(400)] + [(1000 + i, f"text {i}" * (i % 9), None, None if i % 2 else "s2", 0) for i in range(800)] + [(5000, None, "en", "x", 1), (5001, "", "de", "y", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard int")
    out = sharding.assign_shards(materialize(sharding.describe(df), "test-rows"))
    check(out.collect(), {r[0]: r[1] for r in rows})
    assert sorted(out.collect()) == sorted(sharding.assign_shards(materialize(sharding.describe(df), "test-rows")).collect())


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert sharding.assign_shards(materialize(sharding.describe(df), "test-rows")).count() == 0


def test_order_and_cut_equal_brute_force(spark):
    """Codes, curve places, order and cuts worked out row by row; no group is larger than a tenth of a shard or shares its text."""
    rows = [(i, f"{i} " + "x" * (i * 37 % 900), ("en", "en", "de", None)[i % 4], f"s{i * 7 % 11:02}" if i % 13 else None) for i in range(600)]
    described = materialize(sharding.describe(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")), "test-rows")
    size = {r[0]: len(r[1].encode()) + 16 for r in rows}
    total = sum(size.values())

    def code(k):
        own = defaultdict(int)
        for r in rows:
            own[r[k]] += size[r[0]]
        out, before = {}, 0
        for v in sorted(own, key=lambda v: (v is not None, v or "")):
            out[v] = int((before + own[v] / 2) / total * 64)
            before += own[v]
        return out

    langs, sources = code(2), code(3)
    assert len(set(langs.values())) == 3 and len(set(sources.values())) == 12
    axes = np.array([(langs[r[2]], sources[r[3]], min(63, int(np.floor(4 * np.log2(size[r[0]] / 16))))) for r in rows])
    keys = {r.doc_id: (r.text_hash, r.size, r.text_crc32, r.tie) for r in described.withColumn("tie", F.xxhash64("doc_id")).collect()}
    order = sorted((int(p), *keys[r[0]], r[0]) for p, r in zip(sharding.hilbert_index(axes), rows))
    want, at, slots = {}, 0, defaultdict(int)
    for *_, i in order:
        shard = min(39, int((2 * at + size[i]) * 40 // (2 * total)))
        want[i] = (shard, slots[shard])
        at, slots[shard] = at + size[i], slots[shard] + 1
    assert {r.doc_id: (r.shard, r.slot) for r in sharding.assign_shards(described).collect()} == want


def test_files_prune_on_every_dimension(spark, sf_dir):
    """By least and greatest values, a filter on one language, source or size leaves fewer shards to read than rows ordered by hash, and fewer on language and source than rows ordered by size."""
    described = materialize(sharding.describe(spark.read.parquet(f"{sf_dir.rsplit('/', 1)[0]}/sf0.01/documents.parquet")), "test-rows")
    shards = {r.doc_id: r.shard for r in sharding.assign_shards(described).collect()}
    rows = [(r.doc_id, r.lang, r.source, r["size"]) for r in described.collect()]
    total = sum(r[3] for r in rows)

    def by(order):
        at, out = 0, {}
        for r in sorted(rows, key=order):
            out[r[0]] = min(39, at * 40 // total)
            at += r[3]
        return out

    def read(of, k):
        """Shards whose range holds a value, on average over the rows' values."""
        ranges = {}
        for r in rows:
            low, high = ranges.get(of[r[0]], (r[k], r[k]))
            ranges[of[r[0]]] = (min(low, r[k]), max(high, r[k]))
        return np.mean([sum(low <= v <= high for low, high in ranges.values()) for v in (r[k] for r in rows)])

    curve, hashed, sized = ([read(of, k) for k in (1, 2, 3)] for of in (shards, by(lambda r: crc32(str(r[0]).encode())), by(lambda r: (r[3], r[0]))))
    assert all(a < 0.75 * b for a, b in zip(curve, hashed)), (curve, hashed)
    assert curve[0] < 0.75 * sized[0] and curve[1] < 0.75 * sized[1], (curve, sized)
