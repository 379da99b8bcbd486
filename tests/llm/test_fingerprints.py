import hashlib
import random
from collections import Counter

import factlake.llm.fingerprints as fp

SCHEMA = "doc_id long, text string, fingerprint string"


def jaccard(a, b):
    a, b = (Counter(x.lower().split() or [""]) for x in (a, b))
    return sum((a & b).values()) / sum((a | b).values())


def test_edited_texts_and_likeness(spark, monkeypatch):
    monkeypatch.setattr(fp, "STRETCH", 7)  # many borders
    rng = random.Random(6)
    words = [f"word{i}" for i in range(60)] + ["the"] * 30
    docs = {i * 3: " ".join(rng.choices(words, k=rng.randint(0, 120))) for i in range(120)}
    docs |= {1: "", 4: "é🙂x", 10**9: docs[3], 7: "w " * 30_000}
    rows = [(i, t or None, "clash") for i, t in docs.items()]
    found = {r["doc_id"]: r for r in fp.edited_halves(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found.keys() == docs.keys()
    order = sorted(docs, reverse=True)
    errors = []
    for i, nxt in zip(order, order[1:] + order[:1]):
        t, r = docs[i], found[i]
        half = len(t) // 2
        edited = t[: len(t) - half] + docs[nxt][:half]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        errors += [r["near_edited"] - jaccard(t, edited), r["near_next"] - jaccard(t, docs[nxt])]
    assert abs(sum(errors) / len(errors)) < 0.02 and (sum(e * e for e in errors) / len(errors)) ** 0.5 < 0.1
    assert found[10**9]["fingerprint"] == found[3]["fingerprint"]


def test_collision_rate_is_generalised_jaccard(spark):
    """Weighted bags whose similarity differs from the plain Jaccard similarity of their words."""
    a, b = "x " * 8 + "y " * 2 + "z", "x " * 2 + "y " * 8 + "z"
    many = [(i, (a if i % 2 else b).replace("x", f"x{i // 2}").replace("y", f"y{i // 2}").replace("z", f"z{i // 2}")) for i in range(400)]
    found = {r["doc_id"]: r["fingerprint"] for r in fp.fingerprint(spark.createDataFrame(many, "doc_id long, text string")).collect()}
    same = [sum(found[i][k : k + 8] == found[i + 1][k : k + 8] for k in range(0, 8 * fp.SAMPLES, 8)) / fp.SAMPLES for i in range(0, 400, 2)]
    assert abs(sum(same) / len(same) - 5 / 17) < 0.02


def test_empty_single_nulls_and_repeats(spark):
    assert fp.edited_halves(spark.createDataFrame([], SCHEMA)).count() == 0
    one = fp.edited_halves(spark.createDataFrame([(5, "ab cd", None)], SCHEMA)).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"ab ab").hexdigest()
    rows = [(5, "ab cd", None), (5, "ab cd", None), (None, None, None), (None, "x y", None)]
    assert fp.edited_halves(spark.createDataFrame(rows, SCHEMA)).count() == 4


def test_signature_has_64_samples(spark):
    assert fp.SAMPLES == 64
    row = fp.edited_halves(spark.createDataFrame([(5, "ab cd", None), (6, "ab ef", None)], SCHEMA)).first()
    assert len(row["fingerprint"]) == len(row["edited_fingerprint"]) == 512


def test_outlying_ids_leave_stretches_even(spark, monkeypatch):
    monkeypatch.setattr(fp, "STRETCH", 50)
    ids = [*range(1000), 10**15, -(10**15)]
    docs = spark.createDataFrame([(i,) for i in [*ids, None]], "doc_id long")
    cuts = fp.quantiles(docs, len(ids) // fp.STRETCH)
    found = {r["doc_id"]: r["s"] for r in docs.select("doc_id", fp.stretch_of(docs.doc_id, cuts).alias("s")).collect()}
    assert found.pop(None) == -1 and found == {i: sum(c <= i for c in cuts) for i in ids}
    assert len(set(found.values())) >= 18 and max(Counter(found.values()).values()) <= 100

    made = []
    real = fp.stretch_of
    monkeypatch.setattr(fp, "stretch_of", lambda doc_id, cuts: made.append(cuts) or real(doc_id, cuts))
    rows = [(i, f"text {i}", None) for i in ids]
    assert fp.edited_halves(spark.createDataFrame(rows, SCHEMA)).count() == len(ids) and len(made[0]) >= 17


def _murmur(values, seed=42):
    """Spark's 32-bit hash of longs."""
    mask, h = 0xFFFFFFFF, seed
    rotate = lambda x, k: ((x << k) | (x >> (32 - k))) & mask
    for v in values:
        for part in (v & mask, (v >> 32) & mask):
            h ^= rotate(part * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
            h = (rotate(h, 13) * 5 + 0xE6546B64) & mask
        h ^= 8
        h = (h ^ h >> 16) * 0x85EBCA6B & mask
        h = (h ^ h >> 13) * 0xC2B2AE35 & mask
        h ^= h >> 16
    return h


def test_samples_equal_a_plain_loop(spark):
    """Each place against consistent weighted sampling written out word by word."""
    import math
    import struct

    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    of_long = lambda v, seed: signed(xxhash.xxh64_intdigest(struct.pack("<q", v), seed & (1 << 64) - 1))
    rng = random.Random(9)
    texts = {i: " ".join(rng.choices(["a", "bb", "Ccc", "d", "e é"], k=rng.randint(1, 60))) for i in range(12)} | {50: ""}
    got = {r["doc_id"]: r["fingerprint"] for r in fp.fingerprint(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    for i, t in texts.items():
        want = ""
        for place in range(fp.SAMPLES):
            best = None
            for word, n in Counter(t.lower().split() or [""]).items():
                term = signed(xxhash.xxh64_intdigest(word.encode(), 42))
                g = signed(xxhash.xxh64_intdigest(struct.pack("<i", place), of_long(term, 42) & (1 << 64) - 1))
                h = of_long(g, 42)
                u = lambda x, at: (((x & (1 << 64) - 1) >> at & 0xFFFFFF) + 0.5) / (1 << 24)
                r, log_c, b = -math.log(u(g, 40) * u(g, 16)), math.log(-math.log(u(h, 40) * u(h, 16))), (h & 0xFFFF) / (1 << 16)
                step = math.floor(math.log(n) / r + b)
                a = log_c - r * (step - b + 1)
                best = min(best or (math.inf,), (a, _murmur([g & (1 << 64) - 1, step & (1 << 64) - 1])))
            want += f"{best[1]:08x}"
        assert got[i] == want


def test_hot_ids_are_cut_and_change_nothing(spark, monkeypatch):
    """A third of the rows without an id and a third with one id, in parts of their own, follow one another as before."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {i} " * (1 + i % 5), None) for i in range(150)]
    frame = spark.createDataFrame(rows, SCHEMA)
    whole = sorted(map(str, fp.edited_halves(frame, 4).collect()))
    monkeypatch.setattr(fp, "STRETCH", 5)
    assert sorted(map(str, fp.edited_halves(frame, 4).collect())) == whole and len(whole) == 150
