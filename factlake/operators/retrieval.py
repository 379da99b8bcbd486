"""Batch retrieval: many queries against many memories at once.

Arms rank by (query, score); fusion needs ranks only. Narrow rows (ids, scores) travel through the
shuffles, and wide columns are joined to the few survivors.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlake.functions.text import lex_term, lex_tokens
from factlake.operators.components import connected_components
from factlake.operators.nearness import near_pairs
from factlake.sources.shared import spread, stored

#: Rank constant of reciprocal-rank fusion, and BM25's two.
RRF, K1, B = 60, 1.5, 0.75
#: Queries up to this many are broadcast to the memories; more are joined by namespace through a shuffle.
BROADCAST_QUERIES = 2_000
#: Words of a lower-cased text (see ``lex_words``), for tasks.
LEX_WORD = re.compile("[a-z0-9]+")
#: Postings that a task holds, about, and terms of queries that all tasks are told.
SEGMENT, WANTED = 1_000_000, 100_000
#: Candidates and weak terms that are broadcast to postings.
BROADCAST_PAIRS = 200_000
#: Postings of a term that bound a query's scores from below.
FIRSTS = 128
#: Facts that share a word of a namespace and go to one task, about; more of them are split.
HOT_ROWS = 200_000
#: Parts of a namespace that many queries are sent to.
SPLITS = 64


def rank_in(df: DataFrame, keys: list[str], order: list[Column], k: int | None = None, name: str = "rank") -> DataFrame:
    """Number rows within ``keys``; with ``k`` keep the first so many (Spark cuts before the shuffle)."""
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked if k is None else ranked.where(F.col(name) <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, in double precision; null where one is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest vectors of a query's namespace: ``(query_id, id, distance, rank)``; ties by id.

    Few queries are broadcast. More are sent to each of :data:`SPLITS` parts of their namespace, so that
    none is gathered in one task; either way a part's best go on to the ranking.
    """
    return _ranked(_distances(queries, vectors), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The nearest ``k``; vectors that are null or zero are no neighbours."""
    return rank_in(found, ["query_id"], [F.asc_nulls_last("distance"), F.col("id")], k).where("distance is not null")


def _distances(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """``(query_id, id, distance)`` of all vectors in each query's namespace."""
    few = queries.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES
    asked = queries.select("query_id", "namespace", F.col("embedding").alias("__q"), norm(F.col("embedding")).alias("__nq"))
    rows = vectors.select("namespace", "id", "embedding", norm(F.col("embedding")).alias("__nv"))
    if few:
        both = rows.join(F.broadcast(asked), "namespace")
    else:
        parts = asked.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SPLITS - 1))))
        both = rows.withColumn("__part", F.pmod(F.xxhash64("id"), F.lit(SPLITS)).cast("int")).join(parts, ["namespace", "__part"])
    distance = 1 - F.try_divide(dot(F.col("embedding"), F.col("__q")), F.col("__nv") * F.col("__nq"))
    return both.select("query_id", "id", F.round(distance, 6).alias("distance"))


def vector_cells(vectors: DataFrame, cells: int = 64, rounds: int = 8, sample: int = 20_000) -> np.ndarray:
    """Unit centres of ``cells`` cells, fitted by spherical k-means to about ``sample`` vectors drawn by hash.

    The sample is bounded at every size of the table; what is indexed later is every row.
    """
    n = vectors.count()
    share = min(1.0, sample / max(n, 1))
    drawn = vectors.where(F.col("embedding").isNotNull() & (F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < int(share * (1 << 40)))).select("id", "embedding")
    rows = sorted((r["id"], r["embedding"]) for r in drawn.collect())
    x = np.array([v for _, v in rows], np.float64)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) if len(x) else 1.0
    centres = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)].copy() if len(x) else np.zeros((1, 1))
    for _ in range(rounds if len(x) else 0):
        own = (x @ centres.T).argmax(axis=1)
        for k in range(len(centres)):
            if (own == k).any():
                centres[k] = x[own == k].sum(axis=0)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)
    return centres


def vector_topk_cells(queries: DataFrame, vectors: DataFrame, k: int, centres: np.ndarray, probes: int) -> DataFrame:
    """As :func:`vector_topk`, but a query meets only the vectors of the ``probes`` cells nearest to it.

    Every vector is in the index, under its nearest centre; the recall depends on ``probes`` and is to be
    measured against the exact form. With as many probes as cells the result is exact.
    """
    held = vectors.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def nearest(embedding: pd.Series, n: pd.Series) -> pd.Series:
        x = np.stack([np.asarray(v, np.float64) for v in embedding]) if len(embedding) else np.zeros((0, held.value.shape[1]))
        order = np.argsort(-(x @ held.value.T), axis=1, kind="stable")
        return pd.Series([row[:m].tolist() for row, m in zip(order, n)])

    indexed = vectors.where("embedding is not null").withColumn("cell", F.element_at(nearest("embedding", F.lit(1)), 1))
    asked = queries.where("embedding is not null").select("query_id", "namespace", "embedding", F.explode(nearest("embedding", F.lit(probes))).alias("cell"))
    asked = asked.withColumn("namespace", F.concat_ws("|", "namespace", "cell"))
    return _ranked(_distances(asked, indexed.withColumn("namespace", F.concat_ws("|", "namespace", "cell"))), k)


def vector_codebooks(vectors: DataFrame, parts: int = 16, entries: int = 256, rounds: int = 8, sample: int = 20_000) -> np.ndarray:
    """Centres of the parts of unit vectors, ``(parts, entries, width)``, fitted by k-means to about ``sample`` vectors drawn by hash.

    The sample is bounded at every size of the table; what is coded later is every row. Dimensions are a multiple of ``parts``.
    """
    n = vectors.count()
    share = min(1.0, sample / max(n, 1))
    drawn = vectors.where(F.col("embedding").isNotNull() & (F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < int(share * (1 << 40)))).select("id", "embedding")
    rows = sorted((r["id"], r["embedding"]) for r in drawn.collect())
    if not rows:
        return np.zeros((parts, 1, 1))
    cut = _units(pd.Series([v for _, v in rows])).reshape(len(rows), parts, -1)
    books = cut[np.linspace(0, len(rows) - 1, min(entries, len(rows))).astype(int)].transpose(1, 0, 2).copy()
    for _ in range(rounds):
        for p in range(parts):
            own = _nearest_entry(cut[:, p], books[p])
            used, at = np.unique(own, return_inverse=True)
            sums = np.zeros((len(used), cut.shape[2]))
            np.add.at(sums, at, cut[:, p])
            books[p, used] = sums / np.bincount(at)[:, None]
    return books


def _units(vectors: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _nearest_entry(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((book * book).sum(axis=1) - 2 * x @ book.T).argmin(axis=1)


def vector_codes(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """``(namespace, id, code)``: a byte for each part of a vector, the number of its nearest entry."""
    held = vectors.sparkSession.sparkContext.broadcast(books)

    @F.pandas_udf(T.BinaryType())
    def coded(embedding: pd.Series) -> pd.Series:
        cut = _units(embedding).reshape(len(embedding), len(held.value), -1)
        codes = np.stack([_nearest_entry(cut[:, p], book) for p, book in enumerate(held.value)], axis=1).astype(np.uint8)
        return pd.Series([c.tobytes() for c in codes])

    return vectors.where("embedding is not null").select("namespace", "id", coded("embedding").alias("code"))


def vector_topk_codes(queries: DataFrame, codes: DataFrame, vectors: DataFrame, k: int, books: np.ndarray, candidates: int = 100) -> DataFrame:
    """As :func:`vector_topk`, but only the vectors of ``candidates`` rows a query are read; ``codes`` chooses them.

    All codes of a query's namespace are scanned, a byte for each part, by tables of the query's products with the
    entries; each task keeps its best, and the best of all are compared exactly. The recall depends on
    ``candidates`` and is to be measured against the exact form. Queries go through in blocks of
    :data:`BROADCAST_QUERIES`, each with its own scan.
    """
    asked = queries.where("embedding is not null").select("query_id", "namespace", "embedding")
    blocks = max(1, -(-asked.count() // BROADCAST_QUERIES))
    kinds, found = dict(queries.dtypes), []
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).collect()
        tables: dict[str, tuple[list, np.ndarray]] = {}
        for ns in {r["namespace"] for r in rows}:
            own = [r for r in rows if r["namespace"] == ns]
            cut = _units(pd.Series([r["embedding"] for r in own])).reshape(len(own), len(books), -1)
            tables[ns] = ([r["query_id"] for r in own], np.einsum("qpw,pew->qpe", cut, books))
        held = codes.sparkSession.sparkContext.broadcast(tables)

        def scan(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for ns, part in pdf.groupby("namespace"):
                    if ns in held.value:
                        names, products = held.value[ns]
                        code = np.frombuffer(b"".join(part["code"]), np.uint8).reshape(len(part), -1)
                        ids, places = part["id"].to_numpy(), np.arange(code.shape[1])
                        for name, table in zip(names, products):
                            like = table[places, code].sum(axis=1)
                            best = np.argpartition(-like, candidates - 1)[:candidates] if len(like) > candidates else np.arange(len(like))
                            yield pd.DataFrame({"query_id": name, "id": ids[best], "like": like[best]})

        found.append(codes.mapInPandas(scan, f"query_id {kinds['query_id']}, id {dict(codes.dtypes)['id']}, like double"))
    few = rank_in(functools.reduce(DataFrame.unionByName, found), ["query_id"], [F.desc("like"), F.col("id")], candidates)
    near = few.select("query_id", "id").join(vectors.select("id", "embedding"), "id").join(asked.select("query_id", F.col("embedding").alias("__q")), "query_id")
    exact = near.select("query_id", "id", F.round(1 - cosine(F.col("embedding"), F.col("__q")), 6).alias("distance"))
    return _ranked(exact, k)


def postings(docs: DataFrame, wanted: dict[str, set[str]] | None = None) -> DataFrame:
    """Postings in lists ``(namespace, term, ids, tfs, lens, said)``; ``said`` is how often the term stands in all of them.

    A text is read once: its terms, how often each stands there and its length come out together, so that nothing is
    shuffled for them. A task gathers about :data:`SEGMENT` postings before it gives out a list for each term, and a row without term
    whose ``said`` is the length of all texts. With ``wanted`` only those terms of a namespace get lists. Rows are one for each id (see :func:`_once`).
    """
    kind = dict(docs.dtypes)["id"]

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[tuple[str, str | None], int] = {}
        known: dict[str, dict[str, int | None]] = {}
        ids, at, code, tf, lengths = [], [], [], [], []

        def code_of(ns: str, word: str) -> int | None:
            """None for what is no word, the code of the row without term for what nobody wants."""
            term = lex_term(word)
            if term is None:
                return None
            return codes.setdefault((ns, term if wanted is None or term in wanted.get(ns, ()) else None), len(codes))

        def segment() -> pa.RecordBatch:
            order = np.argsort(np.array(code, np.int64), kind="stable")
            own, docs_of, tfs = (np.array(v, np.int64)[order] for v in (code, at, tf))
            ends = np.concatenate([[0], np.bincount(own, minlength=len(codes)).cumsum()])
            total = np.bincount(own, weights=tfs, minlength=len(codes)).astype(np.int64)
            unnamed = [n for (_, term), n in codes.items() if term is None]
            total[unnamed] = [said[ns] for ns, term in codes if term is None]
            names = pa.concat_arrays([i.cast(ids[0].type) for i in ids])
            parts = (names.take(pa.array(docs_of)), pa.array(tfs.astype(np.int32)), pa.array(np.array(lengths, np.int32)[docs_of]))
            lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), v) for v in parts]
            return pa.RecordBatch.from_arrays([pa.array([ns for ns, _ in codes], pa.string()), pa.array([t for _, t in codes], pa.string()), *lists, pa.array(total)], ["namespace", "term", "ids", "tfs", "lens", "said"])

        said: dict[str, int] = {}
        for batch in batches:
            start, begun = len(lengths), 0  # the number of the batch's first text, and where the segment begins in the batch
            ids.append(batch.column("id"))
            for n, (ns, text) in enumerate(zip(batch.column("namespace").to_pylist(), batch.column("text").to_pylist())):
                words = known.setdefault(ns, {})
                nobody = codes.setdefault((ns, None), len(codes))
                own: dict[int, int] = {}
                length = 0
                for word, times in Counter(LEX_WORD.findall(text)).items():
                    c = words.get(word, -1)
                    if c == -1:
                        c = words[word] = code_of(ns, word)
                    if c is not None:
                        length += times
                        if c != nobody:
                            own[c] = own.get(c, 0) + times
                lengths.append(length)
                said[ns] = said.get(ns, 0) + length
                at += [start + n] * len(own)
                code += own
                tf += own.values()
                if len(code) >= SEGMENT:
                    ids[-1] = batch.column("id").slice(begun, n + 1 - begun)
                    yield segment()
                    for held in (codes, known, said, at, code, tf, lengths):
                        held.clear()
                    begun = n + 1
                    ids, start = [batch.column("id").slice(begun)], -begun
        if codes:
            yield segment()

    texts = docs.where("namespace is not null").select("namespace", "id", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    return texts.mapInArrow(gathered, f"namespace string, term string, ids array<{kind}>, tfs array<int>, lens array<int>, said long")


def _once(docs: DataFrame) -> DataFrame:
    """``docs(namespace, id, text)`` with one row for each id of a namespace: texts of equal ids are one text."""
    twice = docs.groupBy("namespace", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    return docs.groupBy("namespace", "id").agg(F.array_join(F.collect_list("text"), " ").alias("text")) if twice else docs.select("namespace", "id", "text")


def _weighed(lists: DataFrame, docs: DataFrame) -> DataFrame:
    """``(namespace, term, df, idf, avg)`` of written lists."""
    corpus = docs.groupBy("namespace").agg(F.count(F.lit(1)).alias("n"))
    mean = lists.where("term is null").groupBy("namespace").agg(F.sum("said").alias("__sum")).join(corpus, "namespace").select("namespace", "n", (F.col("__sum") / F.col("n")).alias("avg"))
    df = lists.where("term is not null").groupBy("namespace", "term").agg(F.sum(F.size("ids")).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return df.join(F.broadcast(mean), "namespace").select("namespace", "term", "df", idf.alias("idf"), "avg")


def _impacts(lists: DataFrame, asked: DataFrame, few: bool) -> DataFrame:
    """``(namespace, term, id, impact)`` of the terms asked for, which come with their weights; an impact is the term's share of a document's score."""
    terms = asked.select("namespace", "term", "idf", "avg").distinct()
    rows = lists.join(F.broadcast(terms) if few else terms, ["namespace", "term"])
    rows = rows.select("namespace", "term", "idf", "avg", F.inline(F.arrays_zip("ids", "tfs", "lens"))).where("ids is not null")
    weight = F.col("idf") * F.col("tfs") * (K1 + 1) / (F.col("tfs") + K1 * (1 - B + B * F.col("lens") / F.col("avg")))
    return rows.select("namespace", "term", F.col("ids").alias("id"), weight.alias("impact"))


def _scores(impacts: DataFrame, asked: DataFrame, few: bool) -> DataFrame:
    """``(query_id, namespace, id, score)``: sums of impacts over the terms ``asked(query_id, namespace, term, df)``.

    A document's postings are brought to one task before queries multiply them, so that sums are not shuffled again.
    """
    made = asked.agg(F.sum("df")).first()[0] or 0
    terms = asked.select("query_id", "namespace", "term")
    hits = spread(impacts, made, "namespace", "id").join(F.broadcast(terms) if few else terms, ["namespace", "term"])
    return hits.groupBy("query_id", "namespace", "id").agg(F.sum("impact").alias("score"))


def _asked_terms(queries: DataFrame) -> tuple[DataFrame, bool]:
    """``(query_id, namespace, term)``, and whether queries are few."""
    asked = queries.select("query_id", "namespace", F.explode(F.array_distinct(lex_tokens(F.col("text")))).alias("term"))
    return asked, queries.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES


def lexical_topk(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """BM25 within a query's namespace, any of its terms: ``(query_id, id, score, rank)``; ties by id."""
    asked, few = _asked_terms(queries)
    named = asked.select("namespace", "term").distinct()
    names = named.limit(WANTED + 1).collect() if few else []
    wanted = None
    if few and len(names) <= WANTED:  # only the terms that are asked for get postings
        wanted = {}
        for r in names:
            wanted.setdefault(r["namespace"], set()).add(r["term"])
    rows = _once(docs.join(F.broadcast(queries.select("namespace").distinct()) if few else queries.select("namespace").distinct(), "namespace", "left_semi"))
    lists = stored(postings(rows, wanted))
    asked = stored(asked.join(_weighed(lists, docs), ["namespace", "term"]))
    scored = _scores(_impacts(lists, asked, few), asked, few)
    return rank_in(scored.select("query_id", "id", F.round("score", 6).alias("score")), ["query_id"], [F.desc("score"), F.col("id")], k)


@dataclass(frozen=True)
class LexicalIndex:
    """What many sets of queries ask of one corpus, as written tables.

    ``postings`` are the lists of :func:`postings` by namespace and term, so that Parquet skips what is not asked for;
    ``terms(namespace, term, df, idf, avg)`` has what weighs them.
    """

    postings: DataFrame
    terms: DataFrame

    def topk(self, queries: DataFrame, k: int) -> DataFrame:
        """As :func:`lexical_topk`, read from the index.

        The first postings of a query's terms give at least ``k`` documents a score that bounds the ``k``-th best from
        below. Terms whose largest impacts together stay under it can't bring a document up by themselves: only
        documents of the other terms are candidates. Their scores by those terms give a closer bound; the postings of weak
        terms are looked up for candidates only that all weak terms together could lift to it.
        """
        asked, few = _asked_terms(queries)
        asked = stored(asked.join(self.terms, ["namespace", "term"]))
        sized = lambda df: F.broadcast(df) if few else df
        names = [r["term"] for r in asked.select("term").distinct().limit(WANTED + 1).collect()]
        lists = self.postings.where(F.col("term").isin(names)) if len(names) <= WANTED else self.postings
        rows = stored(_impacts(lists, asked, few))
        firsts = stored(rank_in(rows, ["namespace", "term"], [F.desc("impact"), F.col("id")], FIRSTS))
        asked = asked.join(sized(firsts.where("rank = 1").select("namespace", "term", F.col("impact").alias("top"))), ["namespace", "term"])
        begun = firsts.join(sized(asked.select("query_id", "namespace", "term")), ["namespace", "term"]).groupBy("query_id", "id").agg(F.sum("impact").alias("score"))
        bound = rank_in(begun, ["query_id"], [F.desc("score")], k).where(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
        weak_first = Window.partitionBy("query_id").orderBy("top", "term").rowsBetween(Window.unboundedPreceding, 0)
        judged = asked.withColumn("so_far", F.sum("top").over(weak_first)).join(bound, "query_id", "left")
        judged = stored(judged.withColumn("weak", F.col("so_far") < F.coalesce("bound", F.lit(0.0)) - 1e-5))
        lift = judged.groupBy("query_id").agg(F.first("bound").alias("bound"), F.coalesce(F.max(F.when(F.col("weak"), F.col("so_far"))), F.lit(0.0)).alias("lift"))
        strong, weak = judged.where("not weak"), judged.where("weak").select("query_id", "namespace", "term")
        scored = _scores(rows.join(sized(strong.select("namespace", "term").distinct()), ["namespace", "term"], "left_semi"), strong, few)
        found = stored(scored.join(sized(lift), "query_id").where("bound is null or score >= bound - lift - 1e-5").drop("bound"))
        # what strong terms alone give the k-th best is a closer bound
        closer = rank_in(found, ["query_id"], [F.desc("score")], k).where(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
        found = stored(found.join(sized(closer), "query_id", "left").where("bound is null or score >= bound - lift - 1e-5"))
        candidates = found.select("query_id", "namespace", "id").join(sized(weak), ["query_id", "namespace"])
        candidates = F.broadcast(candidates) if candidates.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS else candidates
        more = rows.join(candidates, ["namespace", "term", "id"]).select("query_id", "id", F.col("impact").alias("score"))
        both = found.select("query_id", "id", "score").unionByName(more).groupBy("query_id", "id").agg(F.round(F.sum("score"), 6).alias("score"))
        return rank_in(both, ["query_id"], [F.desc("score"), F.col("id")], k)


def lexical_index(docs: DataFrame) -> LexicalIndex:
    """The index of ``docs(namespace, id, text)``."""
    lists = stored(postings(_once(docs)))
    terms = stored(_weighed(lists, docs))
    by_term = ["namespace", "term", F.get("ids", F.lit(0))]
    rows = lists.where("term is not null").repartitionByRange(*by_term).sortWithinPartitions(*by_term)
    return LexicalIndex(stored(rows), terms)


def parse_terms(queries: DataFrame) -> DataFrame:
    """Web-style queries as terms ``(query_id, grp, role, term)``: quoted words form a phrase, ``-`` forbids, OR joins neighbours.

    The terms of a group are alternatives; what OR does not join is a group by itself. ``role`` is want or not.
    """
    t = F.regexp_replace("text", r'(?i)(-?"[^"]*"|\S+)\s+or\s+(?=\S)', "|$1 ")
    pieces = F.regexp_extract_all(t, F.lit(r'(\|?-?"[^"]*"|\S+)'), F.lit(1))
    rows = queries.select("query_id", F.posexplode(pieces).alias("pos", "piece"))
    order = Window.partitionBy("query_id").orderBy("pos")
    joined = F.coalesce(F.lag("piece").over(order).startswith("|"), F.lit(False))
    rows = rows.withColumn("grp", F.sum((~joined).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    term = F.trim(F.lower(F.regexp_replace("piece", r'^[-|]+|"', "")))
    return rows.select("query_id", "grp", F.when(F.col("piece").rlike(r"^\|?-"), "not").otherwise("want").alias("role"), term.alias("term")).where("term <> ''")


def word_sequence(text: Column) -> Column:
    """The words of a text in order, lower-cased: runs of letters, marks and digits of any script; Han and kana letters each by itself."""
    lower = F.lower(text)
    # scripts are slow to tell, and none of these begins below U+2E80
    apart = F.when(lower.rlike(r"[\x{2E80}-\x{10FFFF}]"), F.regexp_replace(lower, r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}])", " $1 ")).otherwise(lower)
    return F.regexp_extract_all(apart, F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))


def _phrases_in(docs: DataFrame, wanted: list[Row]) -> DataFrame:
    """``(namespace, id, phrase)`` of the phrases that are ``wanted(namespace, phrase, words)``, in one pass over the texts.

    A phrase is looked for only in texts that have its first word.
    """
    begun: dict[str, dict[str, list[str]]] = {}
    for r in wanted:
        begun.setdefault(r["namespace"], {}).setdefault(r["words"][0], []).append(r["phrase"])

    def looked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, hits = [], []
            for n, (ns, said) in enumerate(zip(batch.column("namespace").to_pylist(), batch.column("said").to_pylist())):
                own, whole = begun.get(ns, {}), f" {said} "
                here = [p for word in own.keys() & {*said.split(" ")} for p in own[word] if p == word or f" {p} " in whole]
                at += [n] * len(here)
                hits += here
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("namespace").take(rows), batch.column("id").take(rows), pa.array(hits, pa.string())], ["namespace", "id", "phrase"])

    texts = docs.where(F.col("namespace").isin([*begun])).select("namespace", "id", F.array_join(word_sequence(F.col("text")), " ").alias("said")).where("said <> ''")
    return texts.mapInArrow(looked, f"namespace string, id {dict(docs.dtypes)['id']}, phrase string")


def _phrases_joined(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """As :func:`_phrases_in`, for more phrases than each task can be told."""
    texts = docs.select("namespace", "id", word_sequence(F.col("text")).alias("words"))
    one = texts.select("namespace", "id", F.explode(F.array_distinct("words")).alias("phrase"))
    single = one.join(wanted.where(F.size("words") == 1).select("namespace", "phrase"), ["namespace", "phrase"])
    several = wanted.where(F.size("words") > 1).select("namespace", "phrase", F.size("words").alias("n"), F.posexplode("words").alias("offset", "word"))
    places = texts.select("namespace", "id", F.posexplode("words").alias("pos", "word")).join(several, ["namespace", "word"])
    whole = places.groupBy("namespace", "id", "phrase", "n", (F.col("pos") - F.col("offset")).alias("start")).agg(F.count(F.lit(1)).alias("got")).where("got = n")
    return single.select("namespace", "id", "phrase").unionByName(whole.select("namespace", "id", "phrase").distinct())


def boolean_match(terms: DataFrame, docs: DataFrame, scope: DataFrame) -> DataFrame:
    """Documents ``(query_id, id)`` of a query's namespaces that have a term of each wanted group and none that is forbidden.

    ``scope(query_id, namespace)``. A term is a sequence of words (see :func:`word_sequence`) that stand one after
    another; one without words asks for nothing. Different terms are looked for once, however many queries have
    them. A few are looked for in each text when it is read (see :func:`_phrases_in`). Of more, single words are found
    among a text's distinct words, phrases by positional postings of their words, whose ``position - offset`` must
    agree. Only queries that forbid and want nothing go through all documents of
    their namespaces, which are their result but for a few.
    """
    asked = terms.withColumn("words", word_sequence(F.col("term"))).where(F.size("words") > 0)
    asked = asked.select("query_id", "grp", "role", "words", F.array_join("words", " ").alias("phrase")).join(scope.select("query_id", "namespace"), "query_id")
    wanted = asked.select("namespace", "phrase", "words").distinct()
    few = wanted.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES
    sized = lambda df: F.broadcast(df) if few else df
    found = _phrases_in(docs, wanted.collect()) if few else _phrases_joined(docs, wanted)
    found = found.join(sized(asked.select("query_id", "grp", "role", "namespace", "phrase")), ["namespace", "phrase"])
    need = asked.groupBy("query_id").agg(F.countDistinct(F.when(F.col("role") == "want", F.col("grp"))).alias("__need"))
    sums = found.groupBy("query_id", "id").agg(F.countDistinct(F.when(F.col("role") == "want", F.col("grp"))).alias("__got"), F.count_if(F.col("role") == "not").alias("__bad"))
    sums = stored(sums)
    matched = sums.join(need, "query_id").where("__need > 0 and __got = __need and __bad = 0").select("query_id", "id")
    negative = need.where("__need = 0").join(scope, "query_id").join(docs.select("namespace", "id"), "namespace").select("query_id", "id")
    return matched.unionByName(negative.join(sums.where("__bad > 0").select("query_id", "id"), ["query_id", "id"], "left_anti"))


def rrf(arms: list[DataFrame], k: int, c: int = RRF) -> DataFrame:
    """Reciprocal-rank fusion of ranked arms ``(query_id, id, rank)``; ties by id."""
    rows = arms[0].select("query_id", "id", "rank")
    for arm in arms[1:]:
        rows = rows.unionByName(arm.select("query_id", "id", "rank"))
    fused = rows.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (c + F.col("rank"))), 9).alias("score"))
    return rank_in(fused, ["query_id"], [F.desc("score"), F.col("id")], k)


def hybrid_search(queries: DataFrame, table: DataFrame, k: int = 40, current_only: bool = False, index: LexicalIndex | None = None) -> DataFrame:
    """Vector and lexical arms fused, with the survivors' columns: ``table(id, namespace, text, embedding, …)``.

    An ``index`` of the rows that count serves the lexical arm of as many sets of queries as there are.
    """
    rows = table.where("valid_to is null and expired_at is null") if current_only else table
    arms = [vector_topk(queries, rows.where("embedding is not null"), k), index.topk(queries, k) if index else lexical_topk(queries, rows, k)]
    return rrf(arms, k).join(rows.drop("embedding"), "id")


def timeline(queries: DataFrame, facts: DataFrame, limit: int) -> DataFrame:
    """The latest facts about a query's entities: ``queries(query_id, namespace, entities)``; subject equal or named in the statement.

    Names of several words meet the places where their first word stands, and are then compared whole. Each name
    has one list of its latest facts, ``limit`` long, which all queries that name it share. Words in more than
    :data:`HOT_ROWS` facts, which are few, go to several tasks if a name begins with them, else to none.
    """
    parts = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    asked = queries.select("query_id", "namespace", F.explode("entities").alias("entity")).select("query_id", "namespace", parts("entity").alias("parts"))
    asked = asked.select("query_id", "namespace", F.array_join("parts", " ").alias("name"), F.get("parts", 0).alias("word"), F.size("parts").alias("n")).where("n > 0").distinct()
    wanted = asked.select("namespace", "name", "word", "n").distinct()
    few = wanted.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES
    sized = lambda df: F.broadcast(df) if few else df
    said = facts.select("namespace", "id", "observed_at", parts("statement").alias("said"), F.array_join(parts("subject"), " ").alias("subject"))
    places = said.select("namespace", "id", "observed_at", "said", F.posexplode(F.when(F.size("said") > 0, F.col("said"))).alias("pos", "word"))
    begun = sized(wanted)
    if not few:
        counts = places.groupBy("namespace", "word").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > HOT_ROWS)
        known = wanted.select("namespace", "word").distinct().withColumn("known", F.lit(True))
        hot = counts.join(known, ["namespace", "word"], "left").select("namespace", "word", F.when(F.col("known"), F.ceil(F.col("rows") / HOT_ROWS).cast("int")).otherwise(0).alias("splits"))
        hot = F.broadcast(stored(hot))
        splits = F.coalesce("splits", F.lit(1))
        places = places.join(hot, ["namespace", "word"], "left").where(splits > 0).withColumn("part", F.pmod(F.xxhash64("id"), splits).cast("int")).drop("splits")
        begun = wanted.join(hot, ["namespace", "word"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), splits - 1))).drop("splits")
    named = places.join(begun, ["namespace", "word"] if few else ["namespace", "word", "part"]).where((F.col("n") == 1) | (F.array_join(F.slice("said", F.col("pos") + 1, F.col("n")), " ") == F.col("name")))
    subject = said.join(sized(wanted.select("namespace", F.col("name").alias("subject"))), ["namespace", "subject"]).withColumnRenamed("subject", "name")
    hits = named.select("namespace", "name", "id", "observed_at").unionByName(subject.select("namespace", "name", "id", "observed_at")).distinct()
    lists = rank_in(hits, ["namespace", "name"], [F.desc("observed_at"), F.desc("id")], limit).drop("rank")
    found = lists.join(sized(asked.select("query_id", "namespace", "name")), ["namespace", "name"]).select("query_id", "id", "observed_at").distinct()
    return rank_in(found, ["query_id"], [F.desc("observed_at"), F.desc("id")], limit).join(facts.select("id", "statement"), "id").select("id", "query_id", "observed_at", "statement", "rank")


def nearest_values(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` rows of a query's namespace whose value is nearest to its own: ``(query_id, id, distance, rank)``; ties by id.

    ``queries(query_id, namespace, value)``, ``rows(namespace, id, value)``. Different values are numbered in order; a
    query looks up the ``k`` numbers on either side of where it belongs, and of each value only the first ``k`` ids.
    """
    values = rows.where("value is not null").select("namespace", "value").distinct()
    asked = queries.select("query_id", "namespace", "value").where("value is not null")
    # numbers run over different values, which are sorted in their namespace together with the queries'
    order = Window.partitionBy("namespace").orderBy("value", F.desc("known")).rowsBetween(Window.unboundedPreceding, 0)
    both = values.withColumn("known", F.lit(1)).unionByName(asked.select("namespace", "value").distinct().withColumn("known", F.lit(0)))
    both = both.withColumn("n", F.sum("known").over(order))
    numbered = both.where("known = 1").select("namespace", "value", "n")
    first = rank_in(rows.where("value is not null").select("namespace", "id", "value"), ["namespace", "value"], [F.col("id")], k).drop("rank")
    near = asked.join(both.where("known = 0").select("namespace", "value", "n"), ["namespace", "value"])
    near = near.select("query_id", "namespace", F.col("value").alias("own"), F.explode(F.sequence(F.col("n") - k, F.col("n") + k)).alias("n"))
    found = near.join(numbered, ["namespace", "n"]).join(first, ["namespace", "value"]).select("query_id", "id", F.abs(F.col("value") - F.col("own")).alias("distance"))
    return rank_in(found, ["query_id"], [F.col("distance"), F.col("id")], k)


def dedupe_candidates(cands: DataFrame, key: Column) -> DataFrame:
    """One row for each query and content: the best score, then the latest; ``dup_count`` says for how many it stands."""
    rows = cands.withColumn("__k", key)
    order = Window.partitionBy("query_id", "__k").orderBy(F.desc("score"), F.desc("observed_at"), F.col("id"))
    counted = rows.withColumns({"dup_count": F.count(F.lit(1)).over(Window.partitionBy("query_id", "__k")), "__n": F.row_number().over(order)})
    return counted.where("__n = 1").drop("__k", "__n")


def dedupe_near(cands: DataFrame, key: Column, below: float = 0.03) -> DataFrame:
    """As :func:`dedupe_candidates`, but contents whose vectors lie closer than ``below`` count as one, and so on along chains.

    ``cands(query_id, id, score, observed_at, embedding, …)``. Near pairs of a query come from cells and tiles of
    bounded size, and chains are joined as components, in rounds that grow with the logarithm of their length.
    """
    single = stored(dedupe_candidates(cands, key))
    named = single.withColumn("__node", F.xxhash64("query_id", "id"))
    rows = named.select(F.col("query_id").cast("string").alias("grp"), F.col("__node").alias("id"), F.lit(0).alias("seq"), F.lit(True).alias("lead"), "embedding")
    chains = connected_components(near_pairs(rows, below).select(F.col("older").alias("a"), F.col("newer").alias("b")))
    labelled = named.join(chains.withColumnsRenamed({"node": "__node", "component": "__label"}), "__node", "left").withColumn("__label", F.coalesce("__label", "__node"))
    order = Window.partitionBy("query_id", "__label").orderBy(F.desc("score"), F.desc("observed_at"), F.col("id"))
    whole = labelled.withColumns({"dup_count": F.sum("dup_count").over(Window.partitionBy("query_id", "__label")), "__n": F.row_number().over(order)})
    return whole.where("__n = 1").drop("__label", "__n", "__node")


def rerank(cands: DataFrame, score: Column | Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]] | None = None, cap: int = 100, floor: float = 0.0) -> DataFrame:
    """Score the first ``cap`` candidates of a query; the tail keeps its order strictly below them.

    ``score`` is a column, or a function that turns batches of those candidates (all their columns) into
    ``(query_id, id, score)``; what it leaves out is dropped. Without a score the order of retrieval counts as
    ``1 / (1 + i)``. Scores under ``floor`` are dropped.
    """
    shown = F.col("rank") <= cap
    if callable(score) and not isinstance(score, Column):
        kinds = dict(cands.dtypes)
        scored = cands.where(shown).mapInPandas(score, f"query_id {kinds['query_id']}, id {kinds['id']}, __own double")
        cands = cands.join(scored, ["query_id", "id"], "left").where(~shown | F.col("__own").isNotNull())
        own = F.col("__own")
    else:
        own = F.when(shown, score if score is not None else 1.0 / F.col("rank"))
    rows = cands.withColumn("__s", own).withColumn("__low", F.min("__s").over(Window.partitionBy("query_id")))
    tail = F.col("__low") - 1e-6 * (F.col("rank") - cap)
    rows = rows.withColumn("rerank_score", F.when(shown, F.col("__s")).otherwise(tail)).drop("__s", "__low", "__own").where(F.col("rerank_score") >= floor)
    return rank_in(rows, ["query_id"], [F.desc("rerank_score"), F.col("rank")], None, "final_rank")


def assemble(cands: DataFrame, quotas: dict[str, int], facts_first: Column) -> DataFrame:
    """Quotas by arm, facts leading where ``facts_first``, stale rows last."""
    quota = F.lit(0)
    for arm, n in quotas.items():
        quota = F.when(F.col("arm") == arm, n).otherwise(quota)
    kept = rank_in(cands, ["query_id", "arm"], [F.desc("score"), F.col("id")], None, "__n").where(F.col("__n") <= quota)
    lead = F.when(F.col("arm") == "fact", F.when(facts_first, 0).otherwise(1)).otherwise(F.when(facts_first, 1).otherwise(0))
    return rank_in(kept, ["query_id"], [F.col("stale").cast("int"), lead, F.desc("score"), F.col("id")], None, "position").drop("__n")


def inject_pins(ranked: DataFrame, pins: DataFrame) -> DataFrame:
    """Pinned contents first; ranked rows that repeat one are left out."""
    rest = ranked.join(pins.select("query_id", "content"), ["query_id", "content"], "left_anti")
    rows = pins.select("query_id", "id", "content", F.lit(0).alias("__g"), F.lit(0.0).alias("score")).unionByName(rest.select("query_id", "id", "content", F.lit(1).alias("__g"), "score"))
    return rank_in(rows, ["query_id"], [F.col("__g"), F.desc("score"), F.col("id")], None, "position").withColumn("pinned", F.col("__g") == 0).drop("__g")


def render_context(rows: DataFrame, most: int) -> DataFrame:
    """Lines of a query in order, joined up to ``most`` letters; a line that does not fit is skipped, a pinned one never.

    The rows of a query are few (quotas bound them), so they are folded in an array.
    """
    lines = F.array_sort(F.collect_list(F.struct("position", "pinned", "line")))
    fold = F.aggregate(
        lines,
        F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("kept")),
        lambda acc, x: F.when(
            x.pinned | (acc.used + F.length(x.line) + 1 <= most),
            F.struct((acc.used + F.when(x.pinned, 0).otherwise(F.length(x.line) + 1)).alias("used"), F.concat(acc.kept, F.array(x.line)).alias("kept")),
        ).otherwise(acc),
    )
    return rows.groupBy("query_id").agg(fold.alias("f")).select("query_id", F.array_join("f.kept", "\n").alias("context"), F.size("f.kept").alias("n_lines"))


def rank_fair_share(rows: DataFrame, k: int) -> DataFrame:
    """Top ``k`` of a query with an equal share for each level; what a level leaves goes to the best of the rest."""
    levels = rows.groupBy("query_id").agg(F.countDistinct("level").alias("__levels"))
    ranked = rank_in(rows.join(levels, "query_id"), ["query_id", "level"], [F.desc("score"), F.col("id")], None, "__n")
    inside = (F.col("__n") <= F.floor(F.lit(k) / F.col("__levels"))).cast("int")
    return rank_in(ranked.withColumn("__in", inside), ["query_id"], [F.desc("__in"), F.desc("score"), F.col("id")], k).drop("__levels", "__n", "__in")
