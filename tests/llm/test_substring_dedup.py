import random
from hashlib import sha256

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tickspark.llm import queries, substring_dedup


def brute(rows):
    """Rows (doc_id, n_words, n_removed, kept_sha256) and kept texts of (doc_id, text) rows."""
    split = [(i, (t or "").encode().split()) for i, t in rows]
    owner = {}
    for i, words in split:
        for k in range(len(words) - 49):
            if i is not None:
                w = tuple(words[k : k + 50])
                owner[w] = min(owner.get(w, i), i)
    out = []
    for i, words in split:
        gone = set()
        for k in range(len(words) - 49):
            if i is not None and owner[tuple(words[k : k + 50])] < i:
                gone.update(range(k, k + 50))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append(((i, len(words), len(gone), sha256(kept).hexdigest()), kept.decode()))
    return sorted(out, key=repr)


def passages(seed=1):
    """Texts with shared, overlapping, nested and periodic passages around the window's length."""
    rng = random.Random(seed)
    words = lambda n, size=9999: [f"w{rng.randrange(size)}" for _ in range(n)]
    common = [words(n) for n in (49, 50, 51, 75, 76, 120, 400)]
    rows = []
    for i in range(160):
        text = words(rng.randrange(60))
        for _ in range(rng.randrange(4)):
            p = rng.choice(common)
            lo = rng.randrange(max(1, len(p) - 60)) if rng.random() < 0.5 else 0
            text += p[lo : len(p) - (rng.randrange(20) if rng.random() < 0.3 else 0)] + words(rng.randrange(30))
        rows.append((i, " ".join(text)))
    rows += [(200 + i, " ".join(["a"] * n)) for i, n in enumerate((49, 50, 51, 130))] + [(300 + i, " ".join(["a", "b"] * n)) for i, n in enumerate((25, 40, 26))]
    return rows


def spaced(text, rng):
    return "".join(rng.choice(" \t\n\r\x0b\f") * rng.randrange(1, 3) + w for w in text.split())


def compare(spark, rows, cells=1 << 16):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert sorted(map(tuple, substring_dedup.digests(docs, cells).collect()), key=repr) == [w for w, _ in want]
    return docs, want


def test_query_equals_sql(spark, sf_dir):
    got = sorted(map(tuple, queries.op12_substring_dedup(spark, sf_dir).collect()), key=repr)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert got == sorted(con.execute(substring_dedup.ORACLE_SQL).fetchall(), key=repr)
    assert any(0 < r[2] < r[1] for r in got) and any(r[2] == 0 for r in got)


@pytest.mark.parametrize("cells", [8, 1 << 20])
def test_passages_with_a_full_and_an_empty_sketch(spark, cells):
    """A sketch of eight cells lets everything through; results do not depend on it."""
    rng = random.Random(2)
    rows = [(i, spaced(t, rng)) for i, t in passages()]
    docs, want = compare(spark, rows, cells)
    kept = sorted(((r.doc_id, r.text) for r in substring_dedup.drop_repeats(docs.withColumn("n_removed", F.lit(1)), cells).collect()), key=repr)
    texts = dict(rows)
    assert kept == sorted(((w[0], k if w[2] else texts[w[0]]) for w, k in want), key=repr)


def test_odd_rows(spark):
    long = " ".join(f"x{k}" for k in range(60))
    rows = [(None, long), (None, long), (3, long), (3, long), (3, long + " y"), (9, long.replace(" ", "\n")), (5, None), (6, ""), (7, " \n "), (8, "É" * 3000), (8, " ".join("É" * 70))]
    compare(spark, rows)
    compare(spark, [])


def test_blocks_do_not_matter(monkeypatch):
    """Words and windows are the same whatever the size of slices and blocks; a word may be longer than a slice."""
    data = (" ".join(t for _, t in passages()) + " " + "z" * 700 + " end").encode()
    whole, places = substring_dedup.word_hashes(data)
    assert len(whole) == len(data.split()) and [data[p : p + 3] for p in places[:5]] == [w[:3] for w in data.split()[:5]]
    assert len(set(whole.tolist())) == len(set(data.split()))
    doc = np.zeros(len(whole), int)
    flat = lambda: np.concatenate([w for *_, w in substring_dedup.chunks(whole, doc)])
    windows = flat()
    assert len(windows) == len(whole) - 49
    monkeypatch.setattr(substring_dedup, "SLICE_BYTES", 64)
    monkeypatch.setattr(substring_dedup, "BLOCK_WORDS", 100)
    assert (substring_dedup.word_hashes(data)[0] == whole).all() and (flat() == windows).all()
    for anchor, first, n, own in substring_dedup.chunks(whole, doc):
        assert n.sum() == len(own) and n.max() <= 26 and len(anchor) == len(first) == len(n)


def test_estimates_are_never_too_small(spark):
    rows = passages()
    docs = substring_dedup._bodies(spark.createDataFrame(rows, "doc_id long, text string"))
    cells = 1 << 10
    counted = {r.cell: r.n for r in substring_dedup.sketch(docs, cells).collect()}
    held = {}
    for i, t in rows:
        h, doc = substring_dedup._hashed([t.encode()])
        for anchor, *_ in substring_dedup.chunks(h, doc):
            for a in anchor.tolist():
                held.setdefault(a, set()).add(i)
    for a, ids in held.items():
        assert min(counted[c] for c in substring_dedup.cells_of(np.array([a], np.uint64), cells)[:, 0].tolist()) >= len(ids)
