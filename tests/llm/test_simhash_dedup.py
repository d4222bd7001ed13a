import random
import re

import numpy as np
import xxhash

from tickspark.llm import queries, simhash_dedup
from tickspark.llm._common import materialize
from tickspark.llm.components import connected_components


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius=4):
    """fps: id -> fingerprint. The least id of each component, by breadth-first search over all pairs."""
    ids = sorted(fps)
    values = np.array([fps[i] for i in ids], dtype=np.uint64)
    out = {}
    for k, i in enumerate(ids):
        if i in out:
            continue
        todo, out[i] = [k], i
        while todo:
            for j in np.flatnonzero(np.bitwise_count(values ^ values[todo.pop()]) <= radius):
                if ids[j] not in out:
                    out[ids[j]] = i
                    todo.append(j)
    return out


def test_query_equals_brute_force(spark, sf_dir):
    fps = {r.doc_id: plain_fingerprint(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = plain_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op7_simhash_dedup(spark, sf_dir).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


def test_small_texts(spark):
    texts = [None, "", " \x0b", "One", "one", "a b c", "A B  C\n", "a b c d", "É é ÀB", "x " * 300]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "one", 1)], "doc_id long, text string, fp int")
    rows = simhash_dedup.near_duplicates(df).collect()
    want = plain_components({i: plain_fingerprint(t) for i, t in enumerate(texts)})
    for r in rows:
        if r.doc_id is None:
            assert r.component_id == 3
        else:
            assert (int(r.fingerprint, 16), r.component_id) == (plain_fingerprint(texts[r.doc_id]), want[r.doc_id])
    assert simhash_dedup.near_duplicates(df.where("false")).count() == 0


def test_tree_finds_every_link(spark, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "SHARD_ROWS", 64)
    monkeypatch.setattr(simhash_dedup, "BLOCK_ROWS", 50)
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(700)]
    for _ in range(500):  # chains of near fingerprints
        x = rng.choice(fps)
        for b in rng.sample(range(64), rng.randint(1, 5)):
            x ^= 1 << b
        fps.append(x)
    dense = rng.getrandbits(64)
    fps += [dense ^ 1 << a ^ 1 << b for a in range(20) for b in range(a)]
    fps = {i: x for i, x in enumerate(dict.fromkeys(fps))}
    signed = {i: x - (1 << 64) if x >> 63 else x for i, x in fps.items()}
    table = materialize(spark.createDataFrame(list(signed.items()), "doc_id long, fp long"), "test-fps")
    names = {r.fp: r.component_id for r in simhash_dedup.component_ids(table).collect()}
    assert {i: names[x] for i, x in signed.items()} == plain_components(fps)


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(1, 60)]
    root = list(range(3000))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in links:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: find(x) for u, v in links if u != v for x in (u, v)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_repeated_ids_lose_no_component(spark):
    def text(seed):
        return " ".join(f"w{random.Random(seed).random()}{k}" for k in range(40))

    a, b, c = map(text, "abc")
    # id 5 names b and is also a copy of a; then two components that the same id names, and rows without one
    for rows, want in (
        ([(3, a), (5, a), (5, b)], [(3, a), (5, b)]),
        ([(5, a), (5, b), (6, b), (7, c)], [(5, a), (5, b), (7, c)]),
        ([(None, a), (None, a), (None, b), (4, b)], [(None, a), (4, b)]),
    ):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted(map(repr, ((r.doc_id, r.text) for r in simhash_dedup.drop_near_duplicates(df).collect()))) == sorted(map(repr, want))
