"""Extra columns that are called like anything inside the operators come back as they went in, or are ignored."""

import pathlib
import re

import public_tokenizers
import pytest

import factlake.llm
from factlake.llm import fingerprints, language_id, licenses, merkle, mixing, ngram_join, packing, quality, secrets, token_counts, url_filter, vector_codes
from factlake.llm.cover_tree import near_pairs

PATH = public_tokenizers.path("word_bpe_49k.json")
OWN = {"doc_id", "text", "lang", "source", "n_chars", "vec_id", "embedding", "label", "page_id", "url", "piece", "length"}


def names():
    """Every plain name that stands in quotes in the subpackage, with those of columns among them."""
    code = "".join(p.read_text() for p in pathlib.Path(factlake.llm.__file__).parent.glob("*.py"))
    return sorted({n.lower() for n in re.findall(r"[\"'](_{0,2}[A-Za-z]\w{0,30})[\"']", code)} - OWN)


def documents(spark):
    extra = names()
    rows = [(1, "cc by secret=abcdefgh the text of one", "en", "a", 9), (2, "another text of two", "en", None, 9), (2, None, None, "a", None), (None, "ein dritter", "de", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.selectExpr("*", *(f"concat('{n} ', coalesce(doc_id, 0)) as `{n}`" for n in extra)), extra


def unchanged(frame, results=()):
    """All kept columns hold their own names, but those that the results took."""
    _, extra = names(), [n for n in names() if n not in results]
    rows = frame.collect()
    assert rows and all(r[n] == f"{n} {r['doc_id'] or 0}" for r in rows for n in extra)
    return rows


def test_columns_come_back(spark):
    docs, extra = documents(spark)
    assert len(extra) > 100
    assert len(unchanged(mixing.mix_sources(docs, total=40), {"mix_copy"})) > 10
    pieces = docs.selectExpr("*", "0 as piece", "7 as length")
    assert len(unchanged(packing.with_slots(pieces), {"sequence_id", "offset"})) == 4
    keep = ["doc_id", *extra]
    assert len(unchanged(secrets.scan_secrets(docs, [0.0] * len(secrets.ALPHABET) ** 2, keep=keep), {"spans"})) == 4
    assert len(unchanged(licenses.scan_licenses(docs, keep=keep), {"n_words", "finds", "statements"})) == 4
    assert len(unchanged(quality.with_statistics(docs, keep), {"stats"})) == 4
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    from pyspark.sql import functions as F

    assert len(unchanged(quality.score(docs, quality.train(docs, labels, F.lit(True)), keep), {"score"})) == 4
    assert len(unchanged(language_id.identify(docs, language_id.language_model(docs), keep), {"lang_pred", "score", "familiar"})) == 4


@pytest.mark.parametrize(
    "name, call",
    [
        ("n-grams", lambda d: ngram_join.ngram_join(d)), ("tokens", lambda d: token_counts.count_tokens(d, PATH)), ("pieces", lambda d: packing.token_pieces(d, PATH)),
        ("fingerprints", lambda d: fingerprints.edited_halves(d)), ("manifest", lambda d: merkle.merkle_manifest(d)),
    ],
)
def test_columns_are_ignored(spark, name, call):
    docs, _ = documents(spark)
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    assert sorted(map(str, call(docs).collect())) == sorted(map(str, call(plain).collect()))


def test_columns_of_vectors_and_pages_are_ignored(spark):
    extra = names()
    vectors = spark.createDataFrame([(i, [float(i % 3), 1.0] * 8, i % 2) for i in range(9)], "vec_id long, embedding array<float>, label int")
    pages = spark.createDataFrame([(1, "http://a.example.net/en/x"), (2, None)], "page_id long, url string")
    for plain, call in ((vectors, near_pairs), (vectors, vector_codes.compress_vectors), (pages, url_filter.filter_urls)):
        wide = plain.selectExpr("*", *(f"'x' as `{n}`" for n in extra))
        assert sorted(map(str, call(wide).collect())) == sorted(map(str, call(plain).collect()))
