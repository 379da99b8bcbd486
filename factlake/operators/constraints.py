"""Pinned constraints of the three stores, and the rules that reach a namespace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.functions.text import ancestors, constraint_subject
from factlake.operators.governance import BROADCAST_NAMES, made_rows, resolve_precedence
from factlake.operators.retrieval import rank_in
from factlake.sources.shared import spread

PIN = ["kind", "id", "namespace", "content", "ts", "author", "constraint_subject", "retired_at", "sourced"]


def constraint_rows(turns: DataFrame, facts: DataFrame, episodes: DataFrame) -> DataFrame:
    """Constraints of all stores in one form: ``(kind, id, namespace, content, ts, author, constraint_subject, retired_at, sourced)``.

    Closed and corrected facts are none; ``sourced`` marks facts that were drawn from turns, whose turn is the constraint.
    Each store has its own ids, so (kind, id) names a row.
    """
    own = lambda df, kind, content, ts, sourced: df.where("memory_type = 'constraint'").select(
        F.lit(kind).alias("kind"), "id", "namespace", F.col(content).alias("content"), ts.alias("ts"), "author", "constraint_subject", "retired_at", sourced.alias("sourced")
    )
    drawn = F.coalesce(F.size("source_turn_ids") > 0, F.lit(False))
    live = facts.where("valid_to is null and expired_at is null")
    rows = own(turns, "turn", "text", F.col("observed_at"), F.lit(False))
    rows = rows.unionByName(own(live, "fact", "statement", F.coalesce("valid_from", "created_at"), drawn))
    return rows.unionByName(own(episodes, "episode", "text", F.coalesce("t_start", "observed_at"), F.lit(False)))


def list_pins(rows: DataFrame) -> DataFrame:
    """All that are not retired: ``(kind, id, namespace, content, constraint_subject)``."""
    return rows.where("retired_at is null").select("kind", "id", "namespace", "content", "constraint_subject")


def backfill_subjects(rows: DataFrame) -> DataFrame:
    """Give live constraints without a subject one that is derived from their content."""
    blank = F.col("retired_at").isNull() & (F.coalesce("constraint_subject", F.lit("")) == "")
    return rows.withColumn("constraint_subject", F.when(blank, constraint_subject(F.col("content"))).otherwise(F.col("constraint_subject")))


def retire_by_id(rows: DataFrame, orders: DataFrame) -> DataFrame:
    """Live constraints that ``orders(namespace, constraint)`` name as ``<kind>:<id>`` or ``<id>``, which may fit several stores.

    An order that is neither names nothing.
    """
    parts = F.split("constraint", ":")
    named = orders.where(F.col("constraint").rlike(r"^((turn|fact|episode):)?\d+$")).select(
        "namespace", F.element_at(parts, -1).cast("long").alias("id"), F.when(F.size(parts) > 1, F.element_at(parts, 1)).alias("__kind")
    )
    hits = rows.where("retired_at is null").join(named, ["namespace", "id"]).where("__kind is null or __kind = kind")
    return hits.select("kind", "id", "namespace", "content", "constraint_subject").distinct()


def pinned_constraints(asked: DataFrame, rows: DataFrame, overrides: DataFrame, cap: int = 10) -> tuple[DataFrame, DataFrame]:
    """The constraints that each query is shown, and those that precedence suppressed.

    ``asked(query_id, namespace)`` lists the namespaces a query reads. Of equal contents the oldest stays;
    an ancestor beats its descendants on one subject (see :func:`resolve_precedence`) before ``cap`` cuts. Equal
    contents of a namespace become one before they go to the queries that read it.
    Returns ``(query_id, kind, id, namespace, content, position)`` and ``(query_id, kind, id, namespace, beaten_by)``.
    """
    live = rows.where("retired_at is null and not sourced")
    oldest = [F.col("ts"), F.col("kind"), F.col("id")]
    read = rank_in(live, ["namespace", "content"], oldest, 1, "__n").drop("__n")
    found = asked.select("query_id", "namespace").distinct().join(read, "namespace")
    single = rank_in(found, ["query_id", "content"], oldest, 1, "__n").drop("__n")
    # precedence within each query: its number is part of the subject
    keyed = single.withColumn("subject", F.when(F.coalesce("constraint_subject", F.lit("")) != "", F.concat_ws("|", "query_id", "constraint_subject")))
    judged = resolve_precedence(keyed, overrides)
    order = [F.col("ts"), F.col("content"), F.col("kind"), F.col("id")]
    shown = rank_in(judged.where("beaten_by is null"), ["query_id"], order, cap, "position").select("query_id", "kind", "id", "namespace", "content", "position")
    return shown, judged.where("beaten_by is not null").select("query_id", "kind", "id", "namespace", "beaten_by")


def injection_audit(shown: DataFrame, suppressed: DataFrame) -> DataFrame:
    """A row for each constraint that a query was shown and for each that precedence kept from it."""
    key = F.concat_ws(":", "kind", "id").alias("constraint")
    given = shown.select("query_id", key, F.lit("injected").alias("event"), F.lit(None).cast("string").alias("beaten_by"))
    return given.unionByName(suppressed.select("query_id", key, F.lit("suppressed").alias("event"), "beaten_by"))


def enforcement_fanout(namespaces: DataFrame, rules: DataFrame, links: DataFrame, inherits: Column | None = None) -> DataFrame:
    """The rules that govern each namespace: its own, its ancestors' (the nearest first), then those of linked ones.

    ``rules(rule_id, namespace, level)``, ``links(src_ns, dst_ns)``. A rule that comes several ways counts
    once, by the first. ``inherits`` is a condition on ``namespace``; without it all inherit. A rule of a wide
    namespace reaches very many, so rules are dealt to tasks by how many rows they make.
    """
    own = namespaces.select(F.col("namespace").alias("ns")).distinct()
    up = own if inherits is None else namespaces.where(inherits).select(F.col("namespace").alias("ns")).distinct()
    sources = own.select("ns", F.col("ns").alias("namespace"), F.lit("own").alias("way"), F.lit(0).alias("step"))
    sources = sources.unionByName(up.select("ns", F.posexplode(ancestors(F.col("ns"))).alias("step", "namespace")).select("ns", "namespace", F.lit("ancestor").alias("way"), (F.col("step") + 1).alias("step")))
    linked = links.select(F.col("src_ns").alias("ns"), F.col("dst_ns").alias("namespace")).distinct().join(own, "ns")
    sources = sources.unionByName(linked.select("ns", "namespace", F.lit("link").alias("way"), F.lit(1_000).alias("step")))
    # of several ways from one namespace to another only the first counts
    sources = sources.groupBy("ns", F.col("namespace").alias("rule_ns")).agg(F.min(F.struct("step", "way")).alias("f")).select("ns", "rule_ns", "f.step", "f.way")
    held = rules.select("rule_id", "level", F.col("namespace").alias("rule_ns"))
    if sources.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES:
        held, sources = spread(held, made_rows(held, sources, "rule_ns"), "rule_id"), F.broadcast(sources)
    hits = held.join(sources, "rule_ns")
    return rank_in(hits, ["ns", "rule_id"], [F.col("step"), F.col("rule_ns")], 1, "__n").select(F.col("ns").alias("namespace"), "rule_id", "level", "rule_ns", "way")
