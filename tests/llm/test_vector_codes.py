import math
import random
from hashlib import sha256

import numpy as np
import pytest

from factlake.llm import vector_codes
from factlake.llm.queries import op13_vector_codes
from factlake.llm.vector_codes import LEAF, Assignment, Tree, compress_vectors, order_of

SCHEMA = "vec_id long, embedding array<double>, label int, code string, x string, ids string"


def brute(rows, parts=16, entries=64, rounds=2):
    kept = [r for r in rows if r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1])]
    kept = [(r[0], [math.floor(256 * v) if abs(v) < 2**53 else 256 * int(v) for v in r[1]], r[2]) for r in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))]
    w = len(kept[0][1]) // parts
    cut = [[r[1][k * w : k * w + w] for k in range(parts)] for r in kept]
    books = [[list(c[k]) for c in cut[:entries]] for k in range(parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda: [[min(range(len(books[k])), key=lambda e: (apart(c[k], books[k][e]), e)) for k in range(parts)] for c in cut]
    for _ in range(rounds):
        codes = near()
        for k in range(parts):
            for e in range(len(books[k])):
                own = [c[k] for c, code in zip(cut, codes) if code[k] == e]
                if own:
                    books[k][e] = [sum(v) // len(own) for v in zip(*own)]
    codes = near()
    most = 2**63 - 1
    errors = [min(most, sum(apart(c[k], books[k][code[k]]) for k in range(parts))) for c, code in zip(cut, codes)]
    sums = {}
    for r, e in zip(kept, errors):
        sums[r[2]] = sums.get(r[2], 0) + e
    digest = sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return [(r[0], "".join(f"{c:02x}" for c in code), e, min(most, sums[r[2]]), digest) for r, code, e in zip(kept, codes, errors)]


def vectors(n, dims, seed, near=8, step=None):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(dims)] for _ in range(near)]
    made = []
    for i in range(n):
        v = [c + rng.gauss(0, 0.05) for c in rng.choice(centres)]
        made.append((i * 7 % (2 * n), [round(x / step) * step for x in v] if step else v, rng.choice([None, 1, 2]), "c", "x", "i"))
    return made


@pytest.mark.parametrize("n, dims, step", [(700, 32, None), (300, 16, 0.125), (40, 48, None), (1, 16, None), (200, 64, 0.25)])
def test_brute_force(spark, tmp_path, n, dims, step):
    rows = vectors(n, dims, n, step=step)
    rows += rows[:5] * 3 + [(None, [0.5] * dims, 1, "", "", ""), (-3, None, 1, "", "", ""), (-2, [float("nan")] * dims, 1, "", "", ""), (-1, [None] + [0.0] * (dims - 1), 2, "", "", ""), (-5, [float("inf")] * dims, 1, "", "", "")]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op13_vector_codes(spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows)))


def test_huge_components(spark):
    rows = vectors(60, 16, 5) + [(500, [1e300] * 16, 1, "", "", ""), (501, [-1e20] * 15 + [3.0], 1, "", "", ""), (0, [2e300] * 16, 2, "", "", "")]
    got = compress_vectors(spark.createDataFrame(rows, SCHEMA)).drop("label").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows)))


def test_dimensions_and_an_empty_table(spark):
    rows = [(1, [0.5] * 16, 1, "", "", ""), (2, [0.5] * 15, 1, "", "", ""), (3, [], 1, "", "", ""), (4, [0.25] * 16, None, "", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r["vec_id"] for r in compress_vectors(docs).collect()) == [1, 4]
    assert compress_vectors(docs.where("vec_id in (2, 3)")).count() == 0 == compress_vectors(docs.limit(0)).count()


def test_dual_trees_prune_and_agree():
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 60, (20, 4))
    x = (centres[rng.integers(0, 20, 2000)] + rng.normal(0, 3, (2000, 4))).astype(np.int64)
    x = x[order_of(x.astype(float), LEAF)]
    book = np.concatenate([x[rng.integers(0, 2000, 60)], x[:4]])  # some entries are equal
    done = Assignment(Tree.of(x, LEAF), book)
    apart = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    assert (done.code == apart.argmin(axis=1)).all()
    assert (done.counts == np.bincount(done.code, minlength=64)).all() and (done.sums.sum(axis=0) == x.sum(axis=0)).all()
    assert done.pairs < 2000 * 64 / 5


def test_blocks_change_nothing(spark, monkeypatch):
    rows = vectors(500, 16, 9)
    whole = sorted(map(tuple, compress_vectors(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()), key=str)
    monkeypatch.setattr(vector_codes, "BLOCK_BYTES", 64 * 8 * 16)
    assert sorted(map(tuple, compress_vectors(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == whole
