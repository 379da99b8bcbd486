"""Mixing sources to target weights by Poisson replication (operator 3).

A source that should make up a share of the mix has a mean repetition rate. Each document's count is
drawn by inverting the Poisson distribution with that mean at a hash of its id and the seed, so the
draw is the same on every run and machine. Documents are exploded by their counts, and the copies are
shuffled globally by a hash of their own.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.llm.common import carried, restored

#: A mean above this is drawn as a sum of equal parts, each with a hash of its own.
PART = 16.0
#: Sources up to this many have their rates broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 50_000


def _hash_hex(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))


def uniform(seed: int, *parts: Column) -> Column:
    """A number from (0, 1): 52 bits of a hash of ``parts``."""
    return (F.conv(F.substring(_hash_hex(seed, *parts), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def rates(docs: DataFrame, weights: Mapping[str | None, float] | None = None, total: float | None = None) -> DataFrame:
    """``(source, n, rate)``: how often a document of each source is repeated on the average.

    ``weights`` gives target weights by source (not named: 0; a weight of a source that is not there is
    void); by default all sources weigh the same. ``total`` is the expected size of the mix, by default
    as many documents as there are. Documents without a source are a source of their own.
    """
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    weight = F.lit(1.0)
    if weights is not None:
        weight = F.lit(0.0)
        for source, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(source)), float(w)).otherwise(weight)
    counts = counts.withColumn("__w", weight)
    sums = counts.agg(F.sum("n").alias("n"), F.sum("__w").alias("w")).first()
    all_docs, all_weights = float(total if total is not None else sums["n"] or 0), float(sums["w"] or 0) or 1.0
    return counts.select("source", "n", (F.lit(all_docs) * F.col("__w") / F.lit(all_weights) / F.col("n")).alias("rate"))


def _distribution(mean: Column) -> Column:
    """Cumulative probabilities of 0, 1, 2, ... up to where what is left is below the hash's resolution."""
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))
    return F.aggregate(
        F.sequence(F.lit(1), F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")),
        start,
        lambda acc, j: F.struct((acc.p * mean / j).alias("p"), F.concat(acc.c, F.array(F.element_at(acc.c, -1) + acc.p * mean / j)).alias("c")),
        lambda acc: acc.c,
    )


def mix_sources(docs: DataFrame, weights: Mapping[str | None, float] | None = None, total: float | None = None, seed: int = 17) -> DataFrame:
    """The mix: the columns of ``docs`` and ``mix_copy`` (int, from 0), shuffled.

    A document stands in the mix as often as its draw says, perhaps not at all. Rows that share a
    ``doc_id`` share a draw; a row without one is drawn by all its columns. Texts, null ones too, are carried
    along unread. Other columns keep whatever names they have; one called ``mix_copy`` is replaced. The order
    is by hash within hash partitions; an empty table stays empty. Weights are by source, see :func:`rates`.
    """
    mean = rates(docs, weights, total)
    parts = F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")
    mean = mean.select(F.col("source").alias("of"), parts.alias("parts"), _distribution(F.col("rate") / parts).alias("c"))
    few = docs.select("source").distinct().limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    whole = F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns)))
    rows = carried(docs, docs.columns, F.col("source").alias("own"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.md5(whole))).alias("id"))
    rows = rows.join(F.broadcast(mean) if few else mean, F.col("own").eqNullSafe(F.col("of")))
    drawn = F.aggregate(
        F.sequence(F.lit(1), F.col("parts")),
        F.lit(0),
        lambda n, part: n + F.size(F.filter("c", lambda c: c < uniform(seed, F.col("id"), part))),
    )
    copies = rows.select("kept", "id", drawn.alias("n")).where("n > 0").select("kept", "id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("mix_copy"))
    order = _hash_hex(seed, F.lit("order"), F.col("id"), F.col("mix_copy"))
    shuffled = copies.select("kept", "mix_copy", order.alias("order")).repartition("order").sortWithinPartitions("order")
    return restored(shuffled.drop("order"))


#: The same mix by default weights in DuckDB; the table is called documents.
ORACLE = """
WITH RECURSIVE rate AS (
  SELECT source, CAST((SELECT count(*) FROM documents) AS DOUBLE) * 1.0 / (SELECT count(*) FROM (SELECT DISTINCT source FROM documents)) / count(*) AS rate
  FROM documents GROUP BY source
), parts AS (
  SELECT source, greatest(ceil(rate / 16.0), 1) AS parts, rate / greatest(ceil(rate / 16.0), 1) AS mean FROM rate
), dist(source, mean, j, p, c) AS (
  SELECT source, mean, 0, exp(-mean), exp(-mean) FROM parts
  UNION ALL
  SELECT source, mean, j + 1, p * mean / (j + 1), c + p * mean / (j + 1) FROM dist WHERE j < ceil(mean + 12 * sqrt(mean) + 30)
), drawn AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, count(*) FILTER (WHERE t.c < x.u) AS n
  FROM (
    SELECT documents.*, CAST(part AS INTEGER) AS part,
      (CAST(CAST('0x' || substr(md5('17:' || doc_id || ':' || CAST(part AS INTEGER)), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
    FROM documents JOIN parts ON documents.source IS NOT DISTINCT FROM parts.source, unnest(generate_series(1, CAST(parts AS BIGINT))) AS s(part)
  ) x JOIN documents d ON d.doc_id = x.doc_id JOIN dist t ON t.source IS NOT DISTINCT FROM d.source
  GROUP BY ALL
)
SELECT doc_id, text, lang, source, n_chars, CAST(k AS INTEGER) AS mix_copy FROM drawn, unnest(generate_series(0, n - 1)) AS s(k)
"""
