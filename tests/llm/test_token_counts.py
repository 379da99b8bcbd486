import random

import public_tokenizers
from tokenizers import Tokenizer

from factlake.llm.token_counts import MergeCounter, count_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "a", " \x1c\x1d x y", "é é ΑΣ ας İ ǅ", "<|endoftext|>x<|startoftext|> <|endoftext", "I'm they'll it's 12 3", "日本語テキスト🙂👍🏽", " 　a\x85b", "x" * 5000, "ﬁ ß ẞ", "̈́ á̧", "<|STARTOFTEXT|>"]


def test_equals_the_library(spark):
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéèêñçABC'.,!0123456789-_ \n"
    texts = ODD + ["".join(rng.choices(letters, k=rng.randint(0, 400))) for _ in range(500)]
    tokenizer, counter = Tokenizer.from_file(PATH), MergeCounter(PATH)
    assert [counter.count(t) for t in texts] == [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, None, 1), (2, "a a", 1), (10**17 + 1, "b " * 3000, 1)], "doc_id long, text string, n_bytes int")
    found = {r["doc_id"]: r for r in count_tokens(docs, PATH).collect() if r["doc_id"] != 2}
    assert found[None]["n_tokens"] == 0 == found[None]["n_bytes"] and found[10**17 + 1]["over_limit"] and found[10**17 + 1]["n_tokens"] == 3000
    assert all(found[i]["n_bytes"] == len(t.encode()) and not found[i]["over_limit"] or found[i]["n_tokens"] > 2048 for i, t in enumerate(texts) if i != 2)


def test_cache_ages(monkeypatch):
    counter = MergeCounter(PATH)
    counter.chunks.limit = counter.parts.limit = 5
    whole = [counter.count(f"alpha{i} beta gamma{i % 3}") for i in range(50)]
    assert whole == [MergeCounter(PATH).count(f"alpha{i} beta gamma{i % 3}") for i in range(50)]


def test_empty_table(spark):
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
