import random

import numpy as np
from pyspark.sql import functions as F

from factlake.llm import language_id as li
from factlake.llm.queries import op9_language_id

SYLLABLES = {"en": "th er on an re he in ed nd ha".split(), "de": "sch ei en ch er ü ung te ich ß".split(), "fr": "eau le ent é qu oi re ai ou ç".split()}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n)).capitalize() + "."


def corpus(n=500):
    rng = random.Random(8)
    return [(i, sentence(rng, lang := rng.choice([*SYLLABLES]), rng.randint(5, 120)), lang if i % 9 else None, lang) for i in range(n)]


def test_held_out_accuracy_and_edge_cases(spark, tmp_path):
    docs = corpus()
    odd = [(900, None, "en", ""), (901, "", "en", ""), (902, "12 34 !!", "de", ""), (903, "th " * 100_000, "en", ""), (3, docs[3][1], docs[3][2], ""), (None, docs[5][1], "fr", "")]
    spark.createDataFrame(docs + odd, "doc_id long, text string, lang string, score string").write.parquet(str(tmp_path / "documents.parquet"))
    found = op9_language_id(spark, str(tmp_path)).collect()
    assert len(found) == len(docs) + len(odd) and all(0 <= r["score"] <= 1 for r in found)
    by = {r["doc_id"]: r for r in found}
    assert [by[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "en"]
    truth = {i: lang for i, _, _, lang in docs}
    held = [r for r in found if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 50 and np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97


def test_posteriors_equal_word_by_word_forward_backward():
    rng = np.random.default_rng(3)
    lengths = np.array([1, 31, 0, 32, 33, 200, 5])
    scores, moves = rng.normal(size=(lengths.sum(), 3)) * 3, rng.normal(size=(3, 3))
    counted = rng.random(lengths.sum()) < 0.8
    got, at = li.posteriors(scores, counted, lengths, moves), 0
    for row, n in zip(got, lengths):
        p, m = np.exp(scores[at : at + n]), np.exp(moves)
        a, b = [np.full(3, 1 / 3)], [np.ones(3)]
        for t in range(n):
            x = (a[-1] @ m) * p[t]
            a.append(x / x.sum())
        for t in range(n - 1, 0, -1):
            x = m @ (p[t] * b[-1])
            b.append(x / x.sum())
        want = np.zeros(3)
        for t in range(n):
            x = a[t + 1] * b[n - 1 - t]
            want += x / x.sum() * counted[at + t]
        assert np.allclose(row, want, atol=1e-9)
        at += n


def test_code_switched_text_is_labelled_word_by_word(spark):
    rng = random.Random(11)
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, other string")
    model = li.language_model(docs)
    n, k = 40, len(model.labels)
    words = (sentence(rng, "en", n) + " " + sentence(rng, "fr", n)).lower().split()
    scores = model.emissions([li.core(w) for w in words])
    own = np.array([li.posteriors(scores, np.arange(len(words)) == i, np.array([len(words)]), model.moves)[0] for i in range(len(words))])
    best = own.argmax(axis=1)
    assert k == 3 and (best[:n] == model.labels.index("en")).mean() > 0.85 and (best[n:] == model.labels.index("fr")).mean() > 0.85


def test_empty_and_unlabelled(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    assert op9_language_id(spark, str(tmp_path)).count() == 0
    docs = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert li.identify(docs, li.language_model(docs)).first()["lang_pred"] == "und"


def test_words_beyond_the_cache(monkeypatch):
    monkeypatch.setattr(li, "CACHE", 50)
    monkeypatch.setattr(li, "AT_ONCE", 30)
    docs = corpus(200)
    model = li.train([t for _, t, _, _ in docs], [lang for *_, lang in docs], rounds=2)
    texts = [t for _, t, _, _ in docs[:20]] + [" ".join(t for _, t, _, _ in docs[:40])]
    one = model.label(texts)
    monkeypatch.setattr(li, "CACHE", 400_000)
    monkeypatch.setattr(li, "AT_ONCE", 200_000)
    fresh = li.LanguageModel(model.labels, model.weights, model.lexicon, model.moves)
    assert [a for a, _ in one] == [a for a, _ in fresh.label(texts)]
    assert F is not None


def test_text_without_white_space_is_read_whole():
    model = li.train([t for _, t, _, _ in corpus()], [lang for *_, lang in corpus()])
    rng = random.Random(4)
    end, inside = "schungeichschung", ",".join("".join(rng.choices(SYLLABLES["en"], k=3)) for _ in range(300))
    assert len(end) == li.LETTERS // 2 and "".join(li.words_of(end + inside + end)) == end + inside + end
    (lang, share), = model.label([end + inside + end])
    assert lang == "en" and share > 0.8
