import random

from pyspark.sql import functions as F

from factlake.llm import quality
from factlake.llm.queries import op2_quality_classifier

WORDS = "the of and a shore reads house then water under over near".split()


def text(rng, good):
    words = [rng.choice(WORDS) for _ in range(rng.randint(20, 200))]
    return ". ".join(" ".join(words[i : i + 9]).capitalize() for i in range(0, len(words), 9)) + "." if good else " | ".join(w.upper() + "$$$" for w in words)


def tables(spark, tmp_path, n=400):
    rng = random.Random(3)
    docs = [(i, text(rng, i % 4 > 0), "x", None) for i in range(n)] + [(n, None, None, None), (n + 1, "", None, None), (n + 2, "w " * 300_000, None, None), (1, "again", None, None), (None, "no id", None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, score double").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(i % 4 > 0), 0) for i in range(n)] + [(n, None, 0), (None, 1, 0), (5, int(5 % 4 > 0), 0), (10**9, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return n, len(docs)


def test_held_out_accuracy_and_edge_cases(spark, tmp_path):
    n, rows = tables(spark, tmp_path)
    found = op2_quality_classifier(spark, str(tmp_path)).collect()
    assert len(found) == rows and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in found)
    held = [r for r in found if r["doc_id"] is not None and r["doc_id"] < n and r["doc_id"] != 1 and r["held_out"]]
    assert held and sum(r["predicted"] == int(r["doc_id"] % 4 > 0) for r in held) >= 0.97 * len(held)


def test_no_labels_and_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert op2_quality_classifier(spark, str(tmp_path)).count() == 0
    model = quality.train(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet")), F.lit(True))
    assert quality.score(spark.createDataFrame([(1, "a")], "doc_id long, text string"), model).first()["score"] == 0.5


def test_statistics_are_finite():
    for t in ("", " ", "\n\n", "a", "!!", "é" * 10, "\x00"):
        found = quality.statistics(t)
        assert len(found) == len(quality.STATISTICS) and all(x == x and abs(x) < 1e9 for x in found)


def test_flattened_traversal_and_splits_against_plain_walks():
    """Trees walked row by row; the first split against all splits tried one by one."""
    import numpy as np

    from factlake.llm import quality

    rng = np.random.default_rng(4)
    x = rng.integers(0, 12, size=(300, 5)).astype(float)
    y = ((x[:, 1] > 5) ^ (rng.random(300) < 0.1)).astype(float)
    model = quality.fit(x, y, trees=12, depth=3)
    score = np.full(len(x), model.base)
    for row in range(len(x)):
        for at in model.roots:
            while model.feature[at] >= 0:
                at = model.left[at] + (x[row, model.feature[at]] > model.threshold[at])
            score[row] += model.value[at]
    assert np.allclose(model.probability(x), 1 / (1 + np.exp(-score)))
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    g, h = p - y, np.full(len(y), p * (1 - p))
    best = max(
        (a.sum() ** 2 / (b.sum() + 1) + c.sum() ** 2 / (d.sum() + 1), j)
        for j in range(5)
        for cut in np.unique(x[:, j])[:-1]
        for low in [x[:, j] <= cut]
        for a, b, c, d in [(g[low], h[low], g[~low], h[~low])]
        if b.sum() >= 2 and d.sum() >= 2
    )
    low = x[:, model.feature[model.roots[0]]] <= model.threshold[model.roots[0]]
    gain = g[low].sum() ** 2 / (h[low].sum() + 1) + g[~low].sum() ** 2 / (h[~low].sum() + 1)
    assert model.feature[model.roots[0]] == best[1] and np.isclose(gain, best[0])
