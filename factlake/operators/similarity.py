"""Closings and duplicates by vector distance. Facts compare within a namespace and, where both have one, a subject."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factlake.functions.predicates import reversal_cue, salient_tokens
from factlake.operators.nearness import near_pairs


def _grouped(facts: DataFrame) -> DataFrame:
    """Facts in the groups in which they meet: those of a subject, and facts without one with all of their namespace."""
    side = lambda df, grp, lead: df.select(grp.alias("grp"), "id", F.col("observed_at").alias("seq"), lead.alias("lead"), "embedding")
    keyed = side(facts.where("subject is not null"), F.concat(F.lit("s:"), F.to_json(F.struct("namespace", F.lower("subject")))), F.lit(True))
    open_to_all = facts.where("subject is null").select("namespace").distinct()
    loose = side(facts.join(open_to_all, "namespace", "left_semi"), F.concat(F.lit("n:"), F.col("namespace")), F.col("subject").isNull())
    return keyed.unionByName(loose)


def near_duplicate_pairs(facts: DataFrame, below: float, least: float = 0.0) -> DataFrame:
    """Pairs ``(namespace, older, newer, distance)`` with ``least <= distance < below``, older by (observed_at, id).

    Facts with a subject meet by equality of it; facts without one meet all of their namespace.
    """
    pairs = near_pairs(_grouped(facts), below, least)
    return pairs.join(facts.select(F.col("id").alias("older"), "namespace"), "older").select("namespace", "older", "newer", "distance")


def dedupe_older(facts: DataFrame, below: float = 0.03) -> DataFrame:
    """Facts that an older near-duplicate makes redundant: ``(id, absorbed_by, distance)``; the nearest absorbs, then the lowest id."""
    return near_pairs(_grouped(facts), below, nearest=1).select(F.col("newer").alias("id"), F.col("older").alias("absorbed_by"), "distance")


def restatements(facts: DataFrame, absorbed: DataFrame) -> DataFrame:
    """Counts and salience of the facts that absorbed others: 0.1 each, at most 1; only those not from the assistant corroborate."""
    said = absorbed.join(facts.select("id", "source_speaker"), "id")
    sums = said.groupBy(F.col("absorbed_by").alias("id")).agg(F.count(F.lit(1)).alias("restatements"), F.count_if(F.lower("source_speaker") != "assistant").alias("corroborations"))
    return sums.withColumn("salience", F.round(F.least(F.lit(1.0), 0.5 + 0.1 * F.col("restatements")), 6))


def supersede_similar(facts: DataFrame, least: float, below: float) -> DataFrame:
    """Facts closed by the first later one in a band of distances: ``(id, superseded_by)``."""
    return near_pairs(_grouped(facts), below, least, first=True).select(F.col("older").alias("id"), F.col("newer").alias("superseded_by"))


def supersede_inferred(facts: DataFrame) -> DataFrame:
    """Of inferred facts of one subject only the newest stays: ``(id, superseded_by)`` of the others."""
    w = Window.partitionBy("namespace", F.lower("subject"))
    newest = F.max(F.struct("observed_at", "id")).over(w)["id"]
    return facts.where("kind = 'inferred'").withColumn("superseded_by", newest).where("id <> superseded_by").select("id", "superseded_by")


def close_reversals(facts: DataFrame, reach: float = 0.40, nearest: int = 8) -> DataFrame:
    """Live facts that a later statement with a cue of reversal closes: ``(id, superseded_by, distance)``.

    Among the ``nearest`` live facts of its namespace observed before it, a reversal closes those within
    ``reach`` that share two salient words with it, one of them outside both subjects, and agree on the
    subject where both have one. Of several reversals the first closes. Reversals meet only what the cells
    of their namespace leave within ``reach``, and each keeps its nearest before anything else is compared.
    """
    live = facts.where("valid_to is null and expired_at is null and embedding is not null")
    rows = live.select(F.col("namespace").alias("grp"), "id", F.col("observed_at").alias("seq"), F.coalesce(reversal_cue(F.col("statement")), F.lit(False)).alias("lead"), "embedding")
    near = near_pairs(rows, reach + 1e-6, newer_leads=True, nearest=nearest).where(F.col("distance") <= reach)
    side = lambda tag: live.select(F.col("id").alias({"r": "newer", "o": "older"}[tag]), *(F.col(c).alias(f"{tag}_{c}") for c in ("subject", "statement", "observed_at")))
    near = near.join(side("r"), "newer").join(side("o"), "older").withColumnsRenamed({"newer": "r_id", "older": "o_id"})
    agree = F.col("r_subject").isNull() | F.col("o_subject").isNull() | (F.lower("r_subject") == F.lower("o_subject"))
    shared = F.array_intersect(salient_tokens(F.col("r_statement")), salient_tokens(F.col("o_statement")))
    outside = F.array_except(shared, F.concat(salient_tokens(F.col("r_subject")), salient_tokens(F.col("o_subject"))))
    hits = near.where(agree & (F.size(shared) >= 2) & (F.size(outside) > 0))
    return hits.groupBy(F.col("o_id").alias("id")).agg(F.min_by(F.struct("r_id", "distance"), F.struct("r_observed_at", "r_id")).alias("m")).select("id", F.col("m.r_id").alias("superseded_by"), "m.distance")
