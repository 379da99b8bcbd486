import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from factlake.llm import packing
from factlake.llm.queries import op5_best_fit_packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, "a", " \x1c\x1d x y", "é é ΑΣ ας İ ǅ", "<|endoftext|>x<|startoftext|> <|endoftext", "I'm they'll it's 12 3", "日本語テキスト🙂", " a\x85b", "THE!! the'", "hello,world. ...,;", "<|STARTOFTEXT|> x", "abc'S. don't!!", "ﬁ ß ẞ", "a\tb\r\nc"]


@pytest.mark.parametrize("seed", range(30))
def test_plan_fills_gaplessly(seed):
    rng = random.Random(seed)
    size = rng.choice([10, 50, 2048])
    counts = {rng.randint(1, size): rng.randint(1, 300) for _ in range(rng.randint(1, 200))}
    places, ranks = collections.defaultdict(list), collections.defaultdict(list)
    for length, rank, n, first, offset in packing.best_fit_plan(counts, size):
        for i in range(n):
            places[first + i].append((offset, length))
            ranks[length].append(rank + i)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(v)) for k, v in counts.items()}
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    # as few as greedy best-fit over documents needs
    left = []
    for length in sorted((x for k, n in counts.items() for x in [k] * n), reverse=True):
        fits = [r for r in left if r >= length]
        r = min(fits) if fits else size
        if fits:
            left.remove(r)
        left.append(r - length)
    assert len(places) == len(left)


def test_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 20)
    rng = random.Random(2)
    texts = ODD + [" ".join(rng.choices(["alpha", "beta,", "Gamma.", "δέλτα"], k=rng.randint(1, 3000))) for _ in range(60)] + ["same text"] * 50
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "no id", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, offset string").write.parquet(str(tmp_path / "documents.parquet"))
    tokenizer = Tokenizer.from_file(PATH)
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t, _ in rows}
    found = op5_best_fit_packing(spark, str(tmp_path)).collect()
    got, filled = collections.defaultdict(int), collections.defaultdict(list)
    for r in sorted(found, key=lambda r: (r["doc_id"] or -1, r["piece"])):
        ids = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == got[r["doc_id"]] and len(ids) == r["length"] and zlib.crc32(np.array(ids, "<u4").tobytes()) == r["ids_crc32"]
        assert r["length"] == 2048 or r["start"] + r["length"] == len(want[r["doc_id"]])
        got[r["doc_id"]] += r["length"]
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == {i: len(x) for i, x in want.items()}
    for own in filled.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert op5_best_fit_packing(spark, str(tmp_path)).count() == 0
