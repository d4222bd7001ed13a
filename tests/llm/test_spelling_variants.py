import random
import re
from collections import Counter
from zlib import crc32

import duckdb

from tickspark.llm import queries, spelling_variants
from tickspark.llm._common import materialize


def edits(a, b):
    """Whether one inserted, deleted or replaced code point leads from a to b."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(docs):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = None if i is None else crc32(f"{i}:{run}".encode())
            if h is not None and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and edits(w, v)] for w in words}
    best = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if words[v] >= 5 * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted(((w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()), key=repr)


def of(spark, docs):
    return sorted(map(tuple, spelling_variants.variants(spark.createDataFrame(docs, "doc_id long, text string")).collect()), key=repr)


def test_query_equals_sql(spark, sf_dir):
    got = sorted(map(tuple, queries.op11_spelling_variants(spark, sf_dir).collect()), key=repr)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert got == sorted(con.execute(spelling_variants.ORACLE_SQL).fetchall(), key=repr)
    assert got == brute([tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()])


def test_chains_ties_and_every_edit(spark):
    rng = random.Random(4)
    base = ["abcdef", "banana", "aaaaaa", "élégant", "ÀÉÎÕÜß", "strasse"]
    words = set(base)
    for w in base:
        for k in range(len(w) + 1):
            words |= {w[:k] + c + w[k:] for c in "azÿ"} | {w[:k] + w[k + 1 :], w[:k] + "q" + w[k + 1 :]}
    docs = []
    for i, w in enumerate(sorted(words)):
        docs.append((i, f"{w}; " * rng.choice((4, 5, 5, 25, 26))))
    docs += [(900 + k, "chains " * 5 + "chainss " * 25 + "chainsss " * 125 + "chainssss " * 700) for k in range(3)]
    got = of(spark, docs)
    assert got == brute(docs)
    assert any(r[2] != (r[1] or r[0]) for r in got)  # a root beyond the form


def test_odd_rows(spark):
    long = "wording " * 60_000 + "z" * 5000 + "K" * 9 + "İstanbul×÷"
    docs = [(None, "wordings " * 9), (1, None), (1, ""), (1, "worded,worded"), (1, "worded,worded"), (2, "worded"), (3, long), (3, long), (4, "a_b 12 " + "z" * 5000)]
    assert of(spark, docs) == brute(docs)
    assert of(spark, []) == []


def test_a_key_is_bounded_by_the_alphabet(spark):
    letters = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
    words = [(f"same{c}end", 7) for c in letters] + [("sameend", 9)]
    table = materialize(spark.createDataFrame(words, "word string, n long"), "test-words")
    sizes = [r["count"] for r in spelling_variants.rotations(table).groupBy("key").count().collect()]
    assert max(sizes) == len(letters) + 1
    assert spelling_variants.neighbours(table).count() == (len(letters) + 1) * len(letters)
