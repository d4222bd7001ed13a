from hashlib import sha256
from zlib import crc32

import duckdb
from pyspark.sql import functions as F

from tickspark.llm import merkle_manifest, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, text):
    return h(*map(field, (row[0], row[3], row[2], row[4], text)))


def levels(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def brute(rows):
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    for x in order:
        langs[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
    trees = {x: levels([leaf(r, r[1]) for r in langs[x]]) for x in order}
    top = levels([trees[x][-1][0] for x in order])
    out = []
    for at, x in enumerate(order):
        for k, r in enumerate(langs[x]):
            lower = r[1] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])
            now, proof = leaf(r, lower if r[0] is not None and crc32(str(r[0]).encode()) % 3 == 0 else r[1]), []
            for tree, place in ((trees[x], k), (top, at)):
                for nodes in tree[:-1]:
                    run, p = nodes[place // 8 * 8 : place // 8 * 8 + 8], place % 8
                    proof += run[:p] + run[p + 1 :]
                    now, place = h(*run[:p], now, *run[p + 1 :]), place // 8
            out.append((r[0], leaf(r, r[1]), trees[x][-1][0], top[-1][0], h(*proof), now, now == top[-1][0]))
    return sorted(out, key=repr)


def of(spark, rows):
    return sorted(map(tuple, merkle_manifest.manifest(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)


def test_query_equals_sql_and_brute_force(spark, sf_dir):
    got = sorted(map(tuple, queries.op13_merkle_manifest(spark, sf_dir).collect()), key=repr)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert got == sorted(con.execute(merkle_manifest.ORACLE_SQL).fetchall(), key=repr)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    assert got == brute([tuple(r) for r in docs.collect()])
    assert {r[6] for r in got} == {True, False}


def test_runs_over_many_blocks(spark, monkeypatch):
    """With small blocks every upper run is listed many times; the rows stay the same."""
    rows = [(i, f"Text {i}", None if i % 5 == 0 else f"l{i % 11 if i % 3 else 0}", "s", i) for i in range(700)]
    want = of(spark, rows)
    assert want == brute(rows)
    monkeypatch.setattr(merkle_manifest, "BLOCK", 8)
    assert of(spark, rows) == want


def test_no_key_of_the_climb_holds_more_than_a_block(spark):
    rows = [(i, "t", "en", "s", i) for i in range(merkle_manifest.BLOCK + 700)]
    placed = merkle_manifest.leaves(spark.createDataFrame(rows, SCHEMA))
    keys = placed.groupBy("tree", F.floor(F.col("place") / merkle_manifest.BLOCK)).count().collect()
    assert sorted(r["count"] for r in keys) == [700, merkle_manifest.BLOCK]
    assert of(spark, rows) == brute(rows)


def test_odd_rows(spark):
    assert of(spark, []) == []
    lone = [(5, "A", "en", "s", None)]
    assert of(spark, lone) == brute(lone)
    rows = lone * 9 + [(None, None, None, None, None), (None, "X", None, "", 0), (6, "", "de", "s", 1), (5, "BÉ" * 40_000, "en", " ", None)]
    assert of(spark, rows) == brute(rows)


def test_other_columns_are_ignored(spark):
    rows = [(i, f"T{i}", "en", "s", i) for i in range(20)]
    more = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("leaf", "tree", "place", "part", "start", "level")})
    assert sorted(map(tuple, merkle_manifest.manifest(more).collect()), key=repr) == brute(rows)
