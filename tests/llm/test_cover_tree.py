import math

import numpy as np
import pytest

import factlake.llm.cover_tree as ct

SCHEMA = "vec_id long, embedding array<float>, label int, unit string"


def brute(rows, cosine):
    out, root = {}, {}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    good = {}
    for n, (i, v, label, _) in enumerate(rows):
        root.setdefault(i, i)
        x = np.array([np.nan if c is None else np.float32(c) for c in v or []], np.float64)
        if label is not None and len(x) and np.isfinite(x).all() and np.linalg.norm(x) > 0:
            good[n] = (i, label, x / np.linalg.norm(x))
    links = dict.fromkeys(range(len(rows)), 0)
    for n, (i, a, x) in good.items():
        for m, (j, b, y) in good.items():
            if n != m and a == b and len(x) == len(y) and x @ y >= cosine:
                links[n] += 1
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return sorted((r[0], links[n], find(r[0])) for n, r in enumerate(rows))


@pytest.mark.parametrize("block", [1024, 16])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(ct, "BLOCK", block)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 8))
    rows = []
    for i in range(260):
        v = centres[rng.integers(6)] + rng.normal(size=8) * rng.choice([0.0, 0.02, 0.2, 2.0])
        rows.append((i, v.astype(np.float32).tolist(), int(rng.integers(2)), "clash"))
    rows += [(300 + i, rows[0][1], rows[0][2], None) for i in range(30)]  # copies
    rows += [(400, None, 0, None), (401, [], 0, None), (402, [0.0] * 8, 0, None), (403, [1.0] * 7 + [None], 0, None), (404, [math.inf] + [1.0] * 7, 0, None), (405, rows[0][1], None, None), (406, [1.0, 2.0], 0, None), (407, [2.0, 4.0], 0, None), (408, [1e-30] * 8, 0, None), (408, [1e-30] * 8, 0, None)]
    found = ct.near_pairs(spark.createDataFrame(rows, SCHEMA), 0.98).collect()
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in found)
    assert got == brute(rows, 0.98) and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found)


@pytest.mark.parametrize("seed", range(4))
def test_upper_levels_and_wholly_linked_nodes(spark, monkeypatch, seed):
    """Dense balls, whose nodes link without comparisons, among loose vectors; copies and links between nodes count."""
    monkeypatch.setattr(ct, "BLOCK", 12)
    monkeypatch.setattr(ct, "CENTRES", 3)
    monkeypatch.setattr(ct, "DEALT", 20)
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, 4))
    rows = []
    for i in range(300):
        v = centres[rng.integers(4)] + rng.normal(size=4) * rng.choice([1e-4, 1e-3, 0.05, 1.0])
        rows.append((i, v.astype(np.float32).tolist(), 0, None))
    rows += [(500 + i, rows[i][1], 0, None) for i in range(0, 60, 2)]
    found = ct.near_pairs(spark.createDataFrame(rows, SCHEMA), 0.98).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in found) == brute(rows, 0.98)


def test_one_ball_is_not_compared_in_pairs(spark, monkeypatch):
    monkeypatch.setattr(ct, "BLOCK", 16)
    rng = np.random.default_rng(5)
    rows = [(i, (np.array([1.0, 2.0, 3.0]) + rng.normal(size=3) * 1e-4).astype(np.float32).tolist(), 0, None) for i in range(400)]
    frame = spark.createDataFrame(rows, SCHEMA)
    _, nodes = ct._levels(ct.stored(ct._unit_vectors(frame).groupBy("grp", "unit").agg(ct.F.min("vec_id").alias("cls"), ct.F.count("*").alias("weight")).select("cls", "grp", "unit", "weight")))
    last, whole = ct._node_pairs(nodes, 0.98)
    assert whole.count() and last.count() == 0
    assert {(r["n_links"], r["component_id"]) for r in ct.near_pairs(frame).collect()} == {(399, 0)}


def test_tree_covers_with_halving_radii():
    x = np.random.default_rng(1).normal(size=(500, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = ct.CoverTree.of(x)
    assert sorted(tree.order) == list(range(500))
    x = x[tree.order]
    assert (tree.start[0], tree.end[0]) == (0, 500)
    for i in range(len(tree.nodes)):
        members = x[tree.start[i] : tree.end[i]]
        assert (np.linalg.norm(members - x[tree.centre[i]], axis=1) <= tree.radius[i] + 1e-6).all()
        kids = range(tree.first[i], tree.first[i] + tree.children[i])
        if kids:
            assert [tree.start[k] for k in kids] == [tree.start[i], *(tree.end[k] for k in kids)][:-1] and tree.end[kids[-1]] == tree.end[i]
            assert all(tree.radius[k] <= tree.radius[i] / 2 + 1e-6 for k in kids)


def test_bounds_spare_comparisons_of_clustered_vectors():
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(20, 8)), 50, axis=0) + rng.normal(size=(1000, 8)) * 0.01
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = ct.CoverTree.of(x)
    x, ones = x[tree.order], np.ones(1000, np.int64)
    links = ct.Links(x, x, ones, ones, 0.98, True)
    links.descend(tree, tree)
    assert (links.of_x == ((x @ x.T) >= 0.98).sum(axis=1) - 1).all()
    assert tree.computed + links.compared < 1000 * 999 / 4


def test_empty_and_null_ids(spark):
    assert ct.near_pairs(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, [1.0], 1, ""), (4, [1.0], 1, ""), (None, [2.0], 1, "")]
    found = sorted((tuple(r) for r in ct.near_pairs(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert found == [(4, 0, 4, True), (None, 0, None, False), (None, 0, None, False)]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_members_are_shuffled_to_their_centres_where_these_are_many(spark, monkeypatch, kind):
    """Without told centres, with chunks of a few vectors, tiles dealt by hash and blocks that are not broadcast."""
    for name, value in {"BLOCK": 12, "CENTRES": 3, "DEALT": 20, "TOLD_BYTES": 400, "CHUNK_BYTES": 800, "TILES": 3, "BROADCAST_BLOCKS": 0}.items():
        monkeypatch.setattr(ct, name, value)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 4))
    rows = [(i, (centres[rng.integers(4)] + rng.normal(size=4) * rng.choice([1e-4, 0.05, 1.0])).astype(np.float32).tolist(), int(rng.integers(2)), None) for i in range(200)]
    rows += [(500 + i, [3 * c for c in rows[i][1]], rows[i][2], None) for i in range(0, 40, 2)]
    found = ct.near_pairs(spark.createDataFrame(rows, SCHEMA.replace("float", kind)), 0.98).collect()
    if kind == "float":
        assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in found) == brute(rows, 0.98)
    else:
        monkeypatch.setattr(np, "float32", np.float64)
        assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in found) == brute(rows, 0.98)


def test_a_vector_is_not_copied_for_each_pair_of_blocks(spark, monkeypatch):
    """Loose vectors, of which no two blocks are told apart: what any step shuffles grows with chunks, not with pairs."""
    monkeypatch.setattr(ct, "BLOCK", 8)
    most = []

    def records(node):
        kids, own = node.children(), node.metrics().get("shuffleRecordsWritten")
        return max([own.get().value() if own.isDefined() else 0, *(records(kids.apply(k)) for k in range(kids.size()))])

    def stored(df):
        df.collect()
        most.append(records(df._jdf.queryExecution().executedPlan()))
        return plain(df)

    plain = ct.stored
    monkeypatch.setattr(ct, "stored", stored)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=32).astype(np.float32).tolist(), 0, None) for i in range(300)]
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = ct.near_pairs(spark.createDataFrame(rows, SCHEMA), 0.98)
        # chunks of a fourth of the vectors (four tasks), and a header for each block of a tile
        assert 300 < max(most) < 300 * 4 + 300 * 4
        assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in found.collect()) == brute(rows, 0.98)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
