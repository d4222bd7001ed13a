import numpy as np

from tickspark.llm import embedding_dedup, queries


def brute(rows, threshold=0.98):
    """rows: (vec_id, embedding, label) -> id: (n_links, component_id, kept)."""
    out = {i: [0, i] for i, _, _ in rows}
    groups = {}
    for i, x, label in rows:
        if i is None or x is None or label is None or any(c is None or not np.isfinite(c) for c in x) or not any(x):
            continue
        groups.setdefault((label, len(x)), []).append((i, np.array(x, dtype=np.float64)))
    for own in groups.values():
        ids = [i for i, _ in own]
        m = np.array([x / np.abs(x).max() for _, x in own])
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        near = m @ m.T >= threshold
        np.fill_diagonal(near, False)
        seen = {}
        for k in np.argsort(ids):
            out[ids[k]][0] = int(near[k].sum())
            if k in seen:
                continue
            todo, seen[k] = [k], ids[k]
            while todo:
                for j in np.flatnonzero(near[todo.pop()]):
                    if j not in seen:
                        seen[j] = ids[k]
                        todo.append(j)
        for k, c in seen.items():
            out[ids[k]][1] = c
    return {i: (n, c, i is not None and i == c) for i, (n, c) in out.items()}


def result(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert result(queries.op1_embedding_dedup(spark, sf_dir)) == brute(rows)


def test_trees_find_every_link(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(250, 8))
    near = base[rng.integers(0, 60, 300)] + 0.08 * rng.normal(size=(300, 8))
    dense = base[0] + 0.05 * rng.normal(size=(150, 8))
    x = np.concatenate([base, near, dense, base[:40], 3.0 * base[5:9]])
    rows = [(int(i), [float(c) for c in v], int(i) % 3 if i % 7 else 1) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert result(embedding_dedup.near_duplicates(df, block_rows=60, leaf=8)) == brute(rows)


def test_unusable_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, None, 1), (1, [0.0, 0.0], 1), (2, [1.0, None], 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 1), (5, [1.0, 2.0], None), (6, [1.0, 2.0], 1), (7, [2.0, 4.0], 1), (8, [1.0, 2.0], 2), (9, [], 1), (10, [1.0, 2.0, 0.0], 1), (11, [1e300, 2e300], 1), (12, [-0.0, 1.0], 3), (13, [0.0, 1.0], 3)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, n_links string")
    got = result(embedding_dedup.near_duplicates(df))
    assert got == brute(rows)
    assert embedding_dedup.near_duplicates(df.where("false")).count() == 0
    assert result(embedding_dedup.near_duplicates(df.where("vec_id is null").unionByName(df.where("vec_id = 6").withColumn("vec_id", df.vec_id * 0 + None).selectExpr("cast(null as long) vec_id", "embedding", "label", "n_links")))) == {None: (0, None, False)}


def test_rows_with_one_id_are_vectors_of_their_own(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (1, [0.0, 1.0], 2), (3, [0.01, 1.0], 2), (4, [0.02, 1.0], 2), (5, [1.0, 0.0], 3), (5, [1.0, 0.0], 3)]
    out = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in out.collect()) == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (4, 2, 1), (5, 1, 5), (5, 1, 5)]


def test_a_tie_at_the_threshold_links(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [3.0, 4.0], 1), (3, [2.9999, 4.0], 1)]
    got = result(embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), 0.6))
    assert got[1][0] == 1 and got[2][0] == 2 and got[3][0] == 1


def test_shape_of_a_tree_survives_packing():
    points = embedding_dedup.unit(np.random.default_rng(1).normal(size=(500, 6)))
    tree = embedding_dedup.CoverTree(points, leaf=8)
    again = embedding_dedup.CoverTree.unpack(tree.points, tree.pack())
    assert all((getattr(tree, f) == getattr(again, f)).all() for f in tree.FIELDS) and sorted(tree.order) == list(range(500))
    for node in range(len(tree.lo)):  # covering radii hold, children part their parent
        own = tree.points[tree.lo[node] : tree.hi[node]]
        assert np.linalg.norm(own - own[0], axis=1).max() <= tree.radius[node] + 1e-9
        kids = range(tree.first[node], tree.first[node] + tree.count[node])
        assert not kids or [tree.lo[k] for k in kids] + [tree.hi[kids[-1]]] == [tree.lo[node], *(tree.hi[k] for k in kids)]


def test_cells_get_about_a_block_each():
    """Also of vectors that all lie far from one another, where a net's level has a ball for every point."""
    points = embedding_dedup.unit(np.random.default_rng(2).normal(size=(4000, 48)))
    tree = embedding_dedup.CoverTree(points[:1000], leaf=16)
    cells, far = tree.descend(points, np.full(4000, 4000), 500)
    assert 4 <= len(set(cells)) <= 16 and (np.linalg.norm(points - tree.points[tree.lo[cells]], axis=1) <= far + 1e-9).all()
    near = embedding_dedup.unit(points[:20].repeat(200, axis=0) + 0.02 * points)
    cells, _ = embedding_dedup.CoverTree(near[::4], leaf=16).descend(near, np.full(4000, 4000), 500)
    assert 8 <= len(set(cells)) <= 40
