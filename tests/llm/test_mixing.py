import collections
import math

from factlake.llm import mixing

SCHEMA = "doc_id long, text string, source string, mix_copy string"


def rows(n):
    return [(i, f"t{i}", "hot" if i % 3 else f"s{i % 7}", "clash") for i in range(n)]


def poisson(u, mean):
    k, p = 0, math.exp(-mean)
    c = p
    while c < u:
        k += 1
        p = p * mean / k
        c = c + p
    return k


def uniform(doc, part, seed=17):
    import hashlib

    return (int(hashlib.md5(f"{seed}:{doc}:{part}".encode()).hexdigest()[:13], 16) + 0.5) / 2.0**52


def test_brute_force(spark):
    docs = spark.createDataFrame(rows(3000), SCHEMA)
    got = collections.Counter((r["doc_id"], r["mix_copy"]) for r in mixing.mix_sources(docs).collect())
    n = collections.Counter(s for _, _, s, _ in rows(3000))
    want = collections.Counter()
    for i, _, s, _ in rows(3000):
        rate = 3000.0 * 1.0 / len(n) / n[s]
        parts = max(1, math.ceil(rate / 16))
        for k in range(sum(poisson(uniform(i, j), rate / parts) for j in range(1, parts + 1))):
            want[i, k] += 1
    assert got == want


def test_targets_weights_and_large_rates(spark):
    docs = spark.createDataFrame([(i, "t", "a" if i % 100 else None, "x") for i in range(2000)], SCHEMA)
    found = mixing.mix_sources(docs, {"a": 1.0, None: 3.0, "absent": 0.0}, total=4000).groupBy("source").count().collect()
    n = {r["source"]: r["count"] for r in found}
    assert abs(n["a"] - 1000) < 150 and abs(n[None] - 3000) < 250  # 150 copies each on the average


def test_same_draw_every_time_and_shuffled(spark):
    docs = spark.createDataFrame(rows(500), SCHEMA)
    one, two = ([(r["doc_id"], r["mix_copy"]) for r in mixing.mix_sources(d).collect()] for d in (docs, docs.repartition(7)))
    assert sorted(one) == sorted(two) and one != sorted(one)


def test_empty_nulls_and_repeats(spark):
    assert mixing.mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(None, None, None, None), (None, None, None, None), (1, "", None, None)], SCHEMA)
    assert mixing.mix_sources(docs, total=300).count() > 100
