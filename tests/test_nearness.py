"""Near pairs by cells and tiles against all pairs, with a hot group, ties, repeats and odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from factlake.operators import nearness, similarity

SCHEMA = "id long, namespace string, subject string, observed_at int, embedding array<float>, extra string"


def facts(n, seed, near=0.05):
    """Clustered vectors; half of all facts share one subject, some have none."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(25, 12))
    rows = []
    for i in range(n):
        v = centres[rng.integers(25)] + rng.normal(size=12) * near
        subject = None if i % 11 == 0 else "Hot" if i % 2 else f"s{i % 40}"
        rows.append((i, f"n{i % 20 == 0}", subject, int(rng.integers(0, 30)), [float(x) for x in v.astype(np.float32)], "x"))
    rows += [(n, "nFalse", "hot", 3, [0.0] * 12, None), (n + 1, "nFalse", "hot", 3, None, None), (n + 2, "nFalse", "hot", 3, [float("nan")] * 12, None), (n + 3, "nFalse", "hot", None, [1.0] * 12, None)]
    rows += [(n + 4, "nFalse", None, 3, [1.0] * 3, None), (n + 5, None, "hot", 3, [1.0] * 12, None)] + [(n + 10 + i, "nFalse", "HOT", 5, rows[1][4], None) for i in range(20)]
    return rows


def brute(rows, below, least=0.0):
    kept = [r for r in rows if r[4] and np.isfinite(r[4]).all() and any(r[4]) and r[3] is not None and r[1] is not None]
    unit = [np.array(r[4]) / np.linalg.norm(r[4]) for r in kept]
    found = []
    for i, a in enumerate(kept):
        for j in range(i + 1, len(kept)):
            b = kept[j]
            if a[1] != b[1] or len(a[4]) != len(b[4]) or (a[2] and b[2] and a[2].lower() != b[2].lower()):
                continue
            d = round(float(1 - unit[i] @ unit[j]) + 0.0, 6) + 0.0
            if least <= d < below:
                x, y = sorted((a, b), key=lambda r: (r[3], r[0]))
                found.append((x[0], y[0], abs(d), y[3]))
    return found


@pytest.fixture(params=[(2048, 512), (60, 16)], ids=["whole", "cells"])
def sizes(request, monkeypatch):
    for name, value in zip(("CELL", "BLOCK"), request.param):
        monkeypatch.setattr(nearness, name, value)
    return request.param


@pytest.mark.parametrize("below, least", [(0.03, 0.0), (0.5, 0.05)])
def test_against_all_pairs(spark, sizes, below, least):
    rows = facts(500, 3)
    frame = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, below, least)
    got = [(r["older"], r["newer"], abs(r["distance"])) for r in similarity.near_duplicate_pairs(frame, below, least).collect()]
    assert len(want) > 200 and sorted(got) == sorted(p[:3] for p in want)
    best, first = {}, {}
    for older, newer, d, seen in brute(rows, below):
        best[newer] = min(best.get(newer, (9.0, 0)), (d, older))
    for older, newer, d, seen in want:
        first[older] = min(first.get(older, (10**9, 0)), (seen, newer))
    assert {r["id"]: (abs(r["distance"]), r["absorbed_by"]) for r in similarity.dedupe_older(frame, below).collect()} == best
    assert {r["id"]: r["superseded_by"] for r in similarity.supersede_similar(frame, least, below).collect()} == {k: v[1] for k, v in first.items()}


def test_nearest_of_leads(spark, sizes):
    rows = facts(400, 4)
    frame = spark.createDataFrame(rows, SCHEMA).where("namespace is not null")
    grouped = frame.select(F.col("namespace").alias("grp"), "id", F.col("observed_at").alias("seq"), (F.col("id") % 7 == 0).alias("lead"), "embedding")
    got = {}
    for r in nearness.near_pairs(grouped, 0.4, newer_leads=True, nearest=3).collect():
        got.setdefault(r["newer"], set()).add((abs(r["distance"]), r["older"]))
    want = {}
    for older, newer, d, _ in brute([(*r[:2], None, *r[3:]) for r in rows], 0.4):
        if newer % 7 == 0:
            want.setdefault(newer, []).append((d, older))
    assert got == {k: {*sorted(v)[:3]} for k, v in want.items()}


def test_no_task_is_hot_and_cells_prune(spark, monkeypatch):
    """Half of the facts are of one subject: tiles are of like size, and far fewer pairs are compared than there are."""
    monkeypatch.setattr(nearness, "CELL", 128)
    monkeypatch.setattr(nearness, "BLOCK", 64)
    frame = spark.createDataFrame(facts(4000, 5, near=0.02), SCHEMA).where("subject is not null")
    held = nearness._unit(similarity._grouped(frame))
    made = nearness.tiles(held, (2 * 0.03) ** 0.5)
    n = [(r["l"], r["r"]) for r in made.groupBy("grp", "cell", "i", "j").agg(F.expr("count_if(side = 0)").alias("l"), F.expr("count_if(side = 1)").alias("r")).collect()]
    total = sorted(a + b for a, b in n)
    assert total[-1] <= 5 * max(total[len(total) // 2], 32)
    assert sum(a * (b or a / 2) for a, b in n) < 0.35 * 2000**2 / 2 + 40 * 60**2


def test_an_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert similarity.near_duplicate_pairs(empty, 0.1).count() == 0 == similarity.dedupe_older(empty).count()


def test_wide_thresholds_copy_no_rows_into_cells(spark, sizes):
    """Where every cell would be visited, each row is placed once, and pairs are those of all."""
    rows = facts(400, 6)
    frame = spark.createDataFrame(rows, SCHEMA).where("namespace is not null")
    grouped = frame.select(F.col("namespace").alias("grp"), "id", F.col("observed_at").alias("seq"), F.lit(True).alias("lead"), "embedding")
    assert {r["cell"] for r in nearness.tiles(nearness._unit(grouped), 1.2).select("cell").distinct().collect()} == {0}
    got = sorted((r["older"], r["newer"]) for r in nearness.near_pairs(grouped, 0.8, 0.6).collect())
    assert got and got == sorted(p[:2] for p in brute([(*r[:2], None, *r[3:]) for r in rows], 0.8, 0.6))
