"""Bi-temporal facts: what is current, as of when, and which fact closes which.

State is derived, never updated: facts are an immutable log and each operator computes closings from it
by windows, so a rerun gives the same rows whatever the order of arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlake.functions.predicates import is_historical, supersedable
from factlake.functions.text import event_date

#: A fact's identity without case: namespace, subject, predicate.
KEY = ("namespace", "__s", "__p")


def live(facts: DataFrame) -> DataFrame:
    """Still true and not corrected."""
    return facts.where("valid_to is null and expired_at is null")


def as_of(facts: DataFrame, valid_at: Column, known_at: Column) -> DataFrame:
    """Facts valid at one time as known at another; both intervals are half-open."""
    valid = (F.coalesce(F.col("valid_from") <= valid_at, F.lit(True))) & (F.col("valid_to").isNull() | (F.col("valid_to") > valid_at))
    known = (F.col("created_at") <= known_at) & (F.col("expired_at").isNull() | (F.col("expired_at") > known_at))
    return facts.where(valid & known)


def expire(facts: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """Set ``expired_at`` on the facts named in ``ids(id)``, unless they were corrected before."""
    marked = ids.select("id").distinct().withColumn("__hit", F.lit(True))
    expired = F.when(F.col("__hit") & F.col("expired_at").isNull(), at).otherwise(F.col("expired_at"))
    return facts.join(marked, "id", "left").withColumn("expired_at", expired).drop("__hit")


def _keyed(facts: DataFrame) -> DataFrame:
    return facts.withColumns({"__s": F.lower("subject"), "__p": F.lower("predicate"), "__o": F.lower(F.coalesce("object", F.lit("")))}).withColumn(
        "__closer", ~is_historical(F.col("statement")) & supersedable(F.col("predicate"), F.col("object"))
    )


def _closed(facts: DataFrame, closer: Column, at: Column) -> DataFrame:
    """Attach ``superseded_by`` and a ``valid_to`` that never inverts the interval."""
    valid_to = F.when(closer.isNotNull(), F.greatest(F.coalesce("valid_from", at), at))
    return facts.withColumns({"superseded_by": closer, "valid_to": valid_to})


def _closed_by_history(rows: DataFrame) -> DataFrame:
    """The first later statement of the past with a date of its own that closes a fact: ``(__old, __dated)``.

    It closes facts with another object that began no later than that date. Such statements are few, so
    they are joined to the facts of their key.
    """
    said = rows.where(is_historical(F.col("statement")) & supersedable(F.col("predicate"), F.col("object")))
    said = said.select(*KEY, F.struct("observed_at", "id", event_date(F.col("statement"), F.lit(None).cast("timestamp_ntz")).alias("at")).alias("h"), F.col("__o").alias("h_o")).where("h.at is not null")
    old = rows.select(*KEY, "__o", F.col("id").alias("__old"), "observed_at", "valid_from")
    later = (F.col("h.observed_at") > F.col("observed_at")) | ((F.col("h.observed_at") == F.col("observed_at")) & (F.col("h.id") > F.col("__old")))
    hits = old.join(said, list(KEY)).where(later & (F.col("__o") != F.col("h_o")) & (F.col("valid_from").isNull() | (F.col("valid_from") <= F.col("h.at"))))
    return hits.groupBy("__old").agg(F.min("h").alias("__dated"))


def supersede(facts: DataFrame, mode: str = "write", dated: bool = False) -> DataFrame:
    """Close facts by later facts on the same namespace, subject and predicate with another object.

    Only a *closer* closes: its predicate holds one value at a time (or its object is a quantity) and it
    does not tell of the past. With ``dated`` (``write`` only) a statement of the past that names a date
    closes facts that began no later, as of that date, which takes a join with those few statements; one
    without a date closes nothing. ``write``: the first later closer with another object closes a fact.
    ``reconcile``: the newest closer of the key closes every other object observed no later. Order is by
    (observed_at, id), so late arrivals are born closed. Adds ``superseded_by`` and ``valid_to``.

    The write form needs one shuffle and no self-join: among closers, runs of one object are islands; the
    next closer either differs or is of the fact's own object, and then the head of the next island does.
    """
    rows = _keyed(facts)
    if mode == "reconcile":
        newest = F.max(F.when(F.col("__closer"), F.struct("observed_at", "id", "__o"))).over(Window.partitionBy(*KEY))
        rows = rows.withColumn("__n", newest)
        hit = F.col("__n").isNotNull() & (F.col("__n.__o") != F.col("__o")) & (F.col("observed_at") <= F.col("__n.observed_at"))
        rows = _closed(rows, F.when(hit, F.col("__n.id")), F.col("__n.observed_at"))
        return rows.drop("__s", "__p", "__o", "__closer", "__n")
    order = Window.partitionBy(*KEY).orderBy("observed_at", "id")
    this = F.struct("id", "observed_at", "__o")
    later = order.rowsBetween(1, Window.unboundedFollowing)
    before = F.last(F.when(F.col("__closer"), F.col("__o")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    # a head is a closer whose object differs from the closer before it
    rows = rows.withColumn("__head", F.col("__closer") & (before.isNull() | (before != F.col("__o"))))
    rows = rows.withColumn("__next", F.first(F.when(F.col("__closer"), this), ignorenulls=True).over(later))
    rows = rows.withColumn("__next_head", F.first(F.when(F.col("__head"), this), ignorenulls=True).over(later))
    # the head of the island after the next closer's: seen from that closer, so carried back with it
    beyond = F.first(F.when(F.col("__closer"), F.struct("__next_head")), ignorenulls=True).over(later)["__next_head"]
    rows = rows.withColumn("__beyond", beyond)
    closer = F.when(F.col("__next.__o") != F.col("__o"), F.col("__next")).when(F.col("__next").isNotNull(), F.col("__beyond"))
    rows = rows.withColumn("__by", F.struct(closer["observed_at"].alias("observed_at"), closer["id"].alias("id"), closer["observed_at"].alias("at")))
    rows = rows.withColumn("__by", F.when(F.col("__by.id").isNotNull(), F.col("__by")))
    if dated:
        rows = rows.join(_closed_by_history(_keyed(facts)), F.col("id") == F.col("__old"), "left").drop("__old")
        rows = rows.withColumn("__by", F.least("__by", "__dated")).drop("__dated")
    return _closed(rows, F.col("__by.id"), F.col("__by.at")).drop("__s", "__p", "__o", "__closer", "__head", "__next", "__next_head", "__beyond", "__by")


def contradictions(facts: DataFrame) -> DataFrame:
    """Keys of live facts with more than one object where any object could be superseded."""
    rows = _keyed(live(facts)).withColumn("__x", supersedable(F.col("predicate"), F.col("object")))
    grouped = rows.groupBy("namespace", F.col("__s").alias("subject"), F.col("__p").alias("predicate"))
    return grouped.agg(F.countDistinct("__o").alias("n_objects"), F.count(F.lit(1)).alias("n_facts"), F.bool_or("__x").alias("__x")).where("n_objects > 1 and __x").drop("__x")


def retire_by_subject(pins: DataFrame) -> DataFrame:
    """Constraints of one namespace and subject: the newest stays, each older one is retired by its successor."""
    order = Window.partitionBy("namespace", F.lower("constraint_subject")).orderBy(F.desc("observed_at"), F.desc("id"))
    after = F.when(F.col("constraint_subject").isNotNull(), F.lag(F.struct("kind", "id", "observed_at")).over(order))
    return pins.withColumn("__by", after).withColumns({"retired_by": F.concat_ws(":", "__by.kind", "__by.id"), "retired_at": F.col("__by.observed_at")}).withColumn(
        "retired_by", F.when(F.col("__by").isNotNull(), F.col("retired_by"))
    ).drop("__by")


def stale_turns(turns: DataFrame, facts: DataFrame) -> DataFrame:
    """Turns from which facts were derived and all of those are closed: ``(id, closed_at)``."""
    links = facts.select(F.explode("source_turn_ids").alias("id"), "valid_to")
    state = links.groupBy("id").agg(F.bool_and(F.col("valid_to").isNotNull()).alias("closed"), F.max("valid_to").alias("closed_at"))
    return turns.select("id").join(state.where("closed"), "id").select("id", "closed_at")


def twin_flag(facts: DataFrame, column: str = "statement") -> DataFrame:
    return facts.withColumn("has_twin", F.count(F.lit(1)).over(Window.partitionBy(column)) > 1)


def diff_states(a: DataFrame, b: DataFrame) -> DataFrame:
    """Facts whose closing differs between two derived states, with what the second did less or more."""
    left = a.select("id", F.col("valid_to").alias("valid_to_a"), F.col("superseded_by").alias("by_a"))
    right = b.select("id", F.col("valid_to").alias("valid_to_b"), F.col("superseded_by").alias("by_b"))
    both = left.join(right, "id", "full_outer").where(~F.col("by_a").eqNullSafe(F.col("by_b")) | ~F.col("valid_to_a").eqNullSafe(F.col("valid_to_b")))
    change = F.when(F.col("by_b").isNull(), "did_less").when(F.col("by_a").isNull(), "did_more").otherwise("other")
    return both.withColumn("change", change)
