import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from tests.llm.test_mixing import poisson, uniform
from tests.llm.test_ngram_join import brute

SECRET = re.compile(r"(?:password|passwd|secret|token|api_?key) ?= ?[A-Za-z0-9+/_.=-]{6,}")

WORDS = "the of and shore reads house then water under over near the of and".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def corpus(spark):
    rng = random.Random(12)
    texts = [" ".join(rng.choices([f"{w}{k}" for w in WORDS for k in "abc"], k=rng.randint(30, 200))) for _ in range(60)]
    rows = [(i, t, "en", "hot" if i % 3 else f"s{i % 4}", len(t), "x") for i, t in enumerate(texts)]
    rows += [(100, texts[3] + " end", "en", "s1", 0, None), (101, texts[3], None, None, None, None), (102, "12 34", "en", "s1", 5, None), (103, None, "en", "s1", None, None), (104, "see token = abcdef0123456789 here", "en", "s1", 33, None)]
    return spark.createDataFrame(rows, SCHEMA), texts


def test_stages_take_effect(spark, tmp_path):
    docs, texts = corpus(spark)
    kept = cp.language_stage(spark, docs, "")
    assert kept.columns == cp.COLUMNS and {r["doc_id"] for r in kept.collect()} == {*range(60), 100, 101, 104}
    single = cp.dedup_stage(spark, kept, "")
    assert single.columns == cp.COLUMNS and {r["doc_id"] for r in single.collect()} == {*range(60), 104}
    clean = cp.secret_stage(spark, single, "")
    by = {r["doc_id"]: r for r in clean.collect()}
    assert clean.columns == cp.COLUMNS and by[104]["text"] == "see [REDACTED] here" and by[104]["n_chars"] == 19 and by[0]["text"] == texts[0]
    mixed = cp.mixing_stage(spark, clean, "")
    assert mixed.columns == cp.COLUMNS and mixed.count() > 20
    packed = cp.packing_stage(spark, mixed, "")
    ends = packed.where("cast(ids as string) is not null").groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert max(r[1] for r in ends) <= 2048 and packed.selectExpr("sum(if(piece = 0, 1, 0)) as n").first()["n"] == mixed.count()


def test_run_and_empty(spark, tmp_path):
    docs, _ = corpus(spark)
    docs.write.parquet(str(tmp_path / "a" / "documents.parquet"))
    assert cp.run(spark, str(tmp_path / "a")).count() > 20
    docs.limit(0).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    assert cp.run(spark, str(tmp_path / "b")).count() == 0
    assert [len(s) for s in cp.STAGES] == [2] * 5


def test_repeated_rows_and_null_ids(spark):
    docs, texts = corpus(spark)
    rows = spark.createDataFrame([(1, texts[1], "en", "a", 1, None), (1, texts[1], "en", "a", 1, None), (None, texts[1], "en", "a", 1, None)], SCHEMA)
    assert sorted(str(r["doc_id"]) for r in cp.dedup_stage(spark, rows, "").collect()) == ["1", "None"]


def test_texts_that_share_an_id_ties_and_long_texts(spark):
    """Different texts under one id both stay, equal rows once with the smallest rest; very long texts pass whole."""
    _, texts = corpus(spark)
    long = " ".join(f"of{i % 997}a reads{i % 89}" for i in range(40_000))
    rows = spark.createDataFrame([(1, texts[1], "en", "b", 1, None), (1, texts[1], "en", "a", 1, None), (1, texts[2], "en", "a", 2, None), (7, long, "en", "a", 3, None), (8, long + " end", "en", "a", 4, None)], SCHEMA)
    got = sorted((r["doc_id"], r["text"], r["source"]) for r in cp.dedup_stage(spark, rows, "").collect())
    assert got == sorted([(1, texts[1], "a"), (1, texts[2], "a"), (7, long, "a")])
    clean = cp.secret_stage(spark, rows.where("doc_id = 7"), "").first()
    assert clean["text"] == long


def test_unknown_languages_are_rejected(spark):
    docs, texts = corpus(spark)
    rng = random.Random(2)
    strange = [(500 + i, " ".join("".join(rng.choices("βγδζθλμξπσφχψω", k=6)) for _ in range(80)), None, "s1", 0, None) for i in range(5)]
    both = docs.unionByName(spark.createDataFrame(strange, SCHEMA))
    kept = {r["doc_id"] for r in cp.language_stage(spark, both, "").collect()}
    assert not kept & {500 + i for i in range(5)} and {*range(60)} <= kept


def test_end_to_end_by_brute_force(spark, tmp_path):
    """What the run packs are the tokens of what plain Python keeps, redacts and draws, gapless in as few sequences as planned."""
    docs, _ = corpus(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: (r["text"], r["source"]) for r in cp.language_stage(spark, docs, "").collect()}
    linked = brute([(i, t) for i, (t, _) in rows.items()], cp.WORDS, cp.SHARE)
    single = {i: rows[i] for i in rows if linked[i][1] == i}
    clean = {}
    for i, (text, source) in single.items():
        clean[i] = (SECRET.sub("[REDACTED]", text), source)
    n = Counter(source for _, source in clean.values())
    tokenizer = Tokenizer.from_file(public_tokenizers.path(cp.TOKENIZER))
    want = Counter()
    for i, (text, source) in clean.items():
        rate = float(len(clean)) / len(n) / n[source]
        parts = max(1, math.ceil(rate / 16))
        copies = sum(poisson(uniform(i, j), rate / parts) for j in range(1, parts + 1))
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), cp.SEQUENCE)):
            want[i, piece, at, tuple(ids[at : at + cp.SEQUENCE])] += copies
    got = cp.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got) == +want
    filled = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= cp.SEQUENCE and len(filled) <= -(-sum(filled.values()) // cp.SEQUENCE) + 1
