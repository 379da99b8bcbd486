import random

import numpy as np
import pytest

import factlake.llm.ngram_join as nj


def brute(docs, width, share):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        k = min(width, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            c = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * c >= share * (len(sets[i]) + len(sets[j]) - c):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    docs = []
    for i in range(n):
        kind = rng.random()
        if docs and kind < 0.5:  # an edited copy
            words = (rng.choice(docs)[1] or "").split()
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                if words:
                    at = rng.randrange(len(words))
                    words[at : at + rng.randint(0, 1)] = [rng.choice(vocabulary)]
            docs.append((i, rng.choice([" ", "\n", "\t "]).join(words)))
        else:
            docs.append((i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 5, 12, 14, 20, 25, 40, 90, 300])))))
    return docs


@pytest.mark.parametrize("width,share,block", [(3, 90, 512), (5, 80, 512), (3, 90, 4), (2, 70, 8)])
def test_against_all_pairs(spark, monkeypatch, width, share, block):
    monkeypatch.setattr(nj, "BLOCK", block)
    docs = corpus(width * share + block, 350)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nj.ngram_join(frame, width, share).collect()}
    assert got == brute(docs, width, share)


def test_pigeonhole_never_misses_a_pair():
    rng = random.Random(1)
    for share in (80, 90, 95):
        for _ in range(400):
            n = rng.choice([9, 10, 11, 19, 20, 35, 60, 200])
            import numpy as np

            a = np.array([rng.getrandbits(64) for _ in range(n)], np.uint64)
            d = nj.most_differing(n, share)
            gone = rng.randint(0, min(d, n - 1))
            b = np.concatenate([a[gone:], np.array([rng.getrandbits(64) for _ in range(max(0, d - gone))], np.uint64)])
            a, b = np.unique(a), np.unique(b)
            c = len(np.intersect1d(a, b))
            if len(a) != len(b) or c != len(a):
                if 100 * c >= share * (len(a) + len(b) - c):
                    mine, other = (nj.signatures(x, share) for x in (a, b))
                    assert {*mine[0]} & {*other[0]}
                    # and after each has left out its most frequent keys, whatever the frequencies
                    often = {k: rng.random() for k in (*mine[0], *other[0])}
                    kept = []
                    for keys, lots in (mine, other):
                        stay = {k for k, lot in zip(keys, lots) if lot < 0}
                        for lot in {*lots} - {-1}:
                            stay |= {*sorted((k for k, x in zip(keys, lots) if x == lot), key=lambda k: -often[k])[lot % 4096 :]}
                        kept.append(stay)
                    assert kept[0] & kept[1]


def test_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    docs = [(5, None, "a"), (6, "", "a"), (7, " \t\n", None), (8, "One two", "b"), (9, "one TWO", None), (3, "one two", None), (3, "one two", None), (None, "one two", None), (20, long, None), (21, long + " end", None), (22, "é É", None), (23, "É é", None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, cls string")
    got = [(r["doc_id"], r["component_id"]) for r in nj.ngram_join(frame).collect()]
    nameless = [r for r in got if r[0] is None]
    assert nameless == [(None, None)]
    got = sorted(r for r in got if r[0] is not None)
    assert got == [(3, 3), (3, 3), (5, 5), (6, 6), (7, 7), (8, 3), (9, 3), (20, 20), (21, 20), (22, 22), (23, 23)]
    assert nj.ngram_join(frame.limit(0)).count() == 0


def test_ids_that_repeat_with_other_texts(spark):
    """A text keeps its links though another text under its id is a copy of something else."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (5, a), (5, b), (9, b + " end")]
    got = sorted(tuple(r) for r in nj.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id").collect())
    assert got == [(1, 1), (5, 1), (5, 5), (9, 5)]


def test_hot_keys_are_salted_and_found_anyhow(spark):
    """Near copies make up most of the corpus: their keys are dealt over several tasks."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    docs = [(i, " ".join(base[:30] + [f"x{i}"] + base[30:])) for i in range(120)] + [(200 + i, " ".join(f"y{rng.randrange(10**6)}" for _ in range(50))) for i in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert len(nj._hot_keys(frame, len(docs), 3, 80))
    got = {r["doc_id"]: r["component_id"] for r in nj.ngram_join(frame, 3, 80).collect()}
    assert got == {i: x for i, (_, x) in brute(docs, 3, 80).items()} and len({*got.values()}) == 41


def test_words_are_told_apart(spark):
    """Words that a polynomial hash takes for one another, and words of all lengths against Python's tuples."""
    morse = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    docs = spark.createDataFrame([(1, morse), (2, morse.translate(str.maketrans("ab", "ba"))), (3, "other")], "doc_id long, text string")
    assert sorted(map(tuple, nj.ngram_join(docs).collect())) == [(1, 1, 1), (2, 1, 2), (3, 1, 3)]
    rng = random.Random(7)
    words = ["".join(rng.choices("abAB\u00e9", k=rng.choice([1, 2, 7, 8, 9, 15, 16, 17, 127, 128, 129, 500, 5000]))) for _ in range(3000)]
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    begin, value = nj._word_values(raw)
    lowered = [w.encode().lower() for w in words]
    assert len(begin) == len(words) and len({*zip(lowered, value.tolist())}) == len({*lowered}) == len({*value.tolist()})
