import duckdb
from pyspark.sql import functions as F

from tickspark.llm import mixing, queries
from tickspark.llm._common import materialize


def test_query_equals_sql(spark, sf_dir):
    got = sorted(map(tuple, queries.op6_mixing(spark, sf_dir).collect()), key=repr)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert got == sorted(con.execute(mixing.ORACLE_SQL).fetchall(), key=repr)


def sized_table(spark, rows):
    return materialize(spark.createDataFrame(rows, "doc_id long, source string, size long, taken string"), "test-sized")


def test_targets_stop_and_reshare(spark):
    rows = [(i, "a", 10, "") for i in range(3)] + [(10 + i, "b", 100, "") for i in range(40)] + [(90, None, 7, ""), (91, "c", 0, ""), (92, "d", 1, "")]
    sized = sized_table(spark, rows)
    t = {r.source: r for r in mixing.source_targets(sized).collect()}
    total = sum(r[2] for r in rows)
    assert abs(sum(r.target for r in t.values()) - 1.5 * total) < 1e-6
    assert t["a"].target == 60 and t["c"].target == 0 and all(r.target <= 2 * r.source_size + 1e-9 for r in t.values())
    assert [r.source for r in sorted(t.values(), key=lambda r: r.sid)] == ["a", "b", "c", "d", None]
    for block in (1, 7, 2048):
        out = mixing.mix_documents(sized, block=block).collect()
        assert len(out) == len(rows)
        for source, r in t.items():
            assert sum(x.taken for x in out if x.source == source) == r.words
        assert all(0 <= x.taken <= 2 * x.size for x in out)


def test_schedule_is_balanced_and_whole(spark):
    rows = [(i, s, 50, "") for s, n in (("a", 60), ("b", 30), ("c", 10)) for i in range(n)]
    sized = sized_table(spark, rows)
    targets = materialize(mixing.source_targets(sized), "test-targets")
    need = {r.sid: -(-r.words // 10) for r in targets.collect()}
    slots = sorted(mixing.schedule(spark, targets, block=10).collect())
    for sid, n in need.items():
        assert sorted(r.k for r in slots if r.sid == sid) == list(range(n))
    whole = sum(need.values())
    seen = dict.fromkeys(need, 0)
    for place, r in enumerate(slots, 1):  # after any number of slots, each source is near its share
        seen[r.sid] += 1
        assert all(abs(seen[s] - place * need[s] / whole) <= 8 for s in need)


def test_empty_and_blank(spark):
    assert mixing.mix_documents(sized_table(spark, [])).count() == 0
    out = mixing.mix_documents(sized_table(spark, [(1, "a", 0, ""), (1, "a", 0, ""), (None, None, 0, "")])).collect()
    assert len(out) == 3 and {r.taken for r in out} == {0}


def test_rows_with_one_id(spark):
    out = mixing.mix_documents(sized_table(spark, [(1, "a", 5, ""), (1, "a", 5, ""), (1, "a", 0, ""), (2, "b", 9, "")])).collect()
    assert len(out) == 4 and sum(r.taken for r in out if r.source == "a") == 20


def test_copies_stand_in_slot_order(spark):
    """Read in order, the laid-out copies hold every source near its share, and a copy's first words are where the mix has them."""
    rows = [(i, s, " ".join(f"{s}{i}w{k}" for k in range(40))) for s, n in (("a", 60), ("b", 30), ("c", 10)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = mixing.repeat_documents(docs, block=40).withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()).orderBy("place").collect()
    targets = {r.source: r.target for r in mixing.source_targets(mixing.measure(docs).drop("text")).collect()}
    total, seen = sum(targets.values()), dict.fromkeys(targets, 0)
    for place, r in enumerate(out, 1):
        seen[r.source] += 1
        assert all(abs(seen[s] - place * targets[s] / total) <= 8 for s in seen)
    assert seen == {s: round(t / 40) for s, t in targets.items()}


def test_alike_rows_get_their_own_copies(spark):
    text = " ".join(f"w{k}" for k in range(10))
    rows = [(1, "a", text, k) for k in range(5)] + [(2, "b", text, 0), (3, None, None, 0), (4, "a", "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, size int")
    out = mixing.repeat_documents(docs)
    assert out.columns == docs.columns
    got = [tuple(r) for r in out.collect()]
    # 90 words are wanted of 60, at most twice each source's: 70 of a at 5 to 2, 20 of b
    assert len([r for r in got if r[0] == 1]) == 7 and len([r for r in got if r[0] == 2]) == 2 and {r[3] for r in got if r[0] == 1} == set(range(5))
