"""Usage, reliability and health of a knowledge store, as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlake.functions.text import contradiction_penalty


def op_stats(audit: DataFrame) -> DataFrame:
    """Calls by action: failures, denials, discrete latency percentiles, share of recalls without a result."""
    share = lambda c: F.round(F.avg(c.cast("double")) * 100, 4)
    return audit.groupBy("action").agg(
        F.count(F.lit(1)).alias("calls"),
        share(~F.col("ok")).alias("error_pct"),
        share(F.col("status") == 403).alias("denied_pct"),
        F.expr("cast(percentile_disc(0.5) within group (order by latency_ms) as int)").alias("p50"),
        F.expr("cast(percentile_disc(0.95) within group (order by latency_ms) as int)").alias("p95"),
        share(F.when(F.col("ok"), F.col("result_count") == 0)).alias("empty_pct"),
    )


def usage_rollup(usage: DataFrame) -> DataFrame:
    return usage.groupBy("op").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("cost_usd").alias("cost_usd")
    )


def usage_summary(usage: DataFrame) -> DataFrame:
    """Totals, by op, by namespace and by day in one pass: grouping sets instead of four scans."""
    view = usage.withColumn("day", F.to_date("ts"))
    sets = view.groupingSets([[], ["op"], ["namespace"], ["day"]], "op", "namespace", "day")
    level = F.expr("case grouping_id(op, namespace, day) when 7 then 'total' when 3 then 'op' when 5 then 'namespace' else 'day' end")
    return sets.agg(level.alias("level"), F.count(F.lit(1)).alias("calls"), F.sum("cost_usd").alias("cost_usd"))


def budget_status(usage: DataFrame, now: Column, day_limit: float, month_limit: float) -> DataFrame:
    """What a day and thirty days cost by namespace, against their limits."""
    spent = lambda days: F.sum(F.when(F.col("ts") > now - F.make_dt_interval(F.lit(days)), F.col("cost_usd")).otherwise(0))
    sums = usage.groupBy("namespace").agg(spent(1).alias("day_usd"), spent(30).alias("month_usd"))
    return sums.select("*", (F.col("day_usd") > day_limit).alias("over_day"), (F.col("month_usd") > month_limit).alias("over_month"))


def first_breach(usage: DataFrame, cap: float) -> DataFrame:
    """The call with which a namespace's running cost first passes ``cap``; costs are 0 or more.

    Sums by hour tell the hour in which that happens, so only its calls are put in order. A null cost counts as 0.
    """
    rows = usage.select("namespace", "ts", "id", F.coalesce("cost_usd", F.lit(0)).alias("cost_usd"), F.date_trunc("hour", "ts").alias("hour"))
    hours = rows.groupBy("namespace", "hour").agg(F.sum("cost_usd").alias("spent"))
    before = Window.partitionBy("namespace").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.withColumn("before", F.coalesce(F.sum("spent").over(before), F.lit(0))).where((F.col("before") <= cap) & (F.col("before") + F.col("spent") > cap))
    order = Window.partitionBy("namespace", "hour").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    running = rows.join(hours, ["namespace", "hour"]).withColumn("running_usd", F.col("before") + F.sum("cost_usd").over(order)).where(F.col("running_usd") > cap)
    return running.groupBy("namespace").agg(F.min(F.struct("ts", "id", "running_usd")).alias("b")).select("namespace", "b.ts", "b.id", "b.running_usd")


def health(facts: DataFrame, n_orphans: DataFrame, n_contradictions: DataFrame) -> DataFrame:
    """Counts of a namespace's facts by state, its ratios and a score from 0 to 100.

    ``n_orphans(namespace, orphans, entities)`` and ``n_contradictions(namespace, contradictions)`` are
    aggregates; namespaces that they lack count 0.
    """
    live = F.col("valid_to").isNull() & F.col("expired_at").isNull()
    sums = facts.groupBy("namespace").agg(
        F.count_if(live).alias("live"), F.count_if(F.col("valid_to").isNotNull()).alias("superseded"), F.count_if(F.col("expired_at").isNotNull()).alias("expired")
    )
    sums = sums.join(n_orphans, "namespace", "left").join(n_contradictions, "namespace", "left").fillna(0, ["orphans", "entities", "contradictions"])
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    score = 100 - contradiction_penalty(ratio("contradictions", "live")) - 30.0 * ratio("orphans", "entities")
    return sums.withColumn("score", F.bround(F.greatest(F.lit(0.0), score), 3))


def findings(stats: DataFrame, rules: list[tuple[str, str, float]]) -> DataFrame:
    """Rows of :func:`op_stats` that pass a rule's threshold: ``rules`` are (finding, measure, threshold)."""
    columns = ", ".join(f"'{name}', '{measure}', cast({measure} as double), cast({limit} as double)" for name, measure, limit in rules)
    return stats.selectExpr("action", f"stack({len(rules)}, {columns}) as (finding, measure, value, threshold)").where("value > threshold")


def namespace_census(turns: DataFrame, facts: DataFrame, registry: DataFrame) -> DataFrame:
    """Turns and facts of every namespace that is registered or holds data; secret ones and patterns are left out."""
    t = turns.groupBy("namespace").agg(F.count(F.lit(1)).alias("turns"))
    f = facts.groupBy("namespace").agg(F.count(F.lit(1)).alias("facts"))
    both = t.join(f, "namespace", "full_outer").join(registry.select("namespace").distinct().withColumn("registered", F.lit(True)), "namespace", "full_outer")
    return both.fillna(0, ["turns", "facts"]).fillna(False, ["registered"]).where(~F.col("namespace").startswith("secret:") & ~F.col("namespace").contains("*"))


def prune_candidates(census: DataFrame, last_write: DataFrame, now: Column, days: int, most_facts: int = 20) -> DataFrame:
    """Namespaces that are empty, or untouched for ``days`` with few facts."""
    rows = census.join(last_write, "namespace", "left")
    empty = (F.col("turns") == 0) & (F.col("facts") == 0)
    stale = (F.col("last_write") < now - F.make_dt_interval(F.lit(days))) & (F.col("facts") <= most_facts)
    return rows.withColumn("reason", F.when(empty, "empty").when(stale, "stale")).where("reason is not null")


def write_recap(audit: DataFrame, now: Column, days: int, actions: tuple[str, ...]) -> DataFrame:
    recent = audit.where(F.col("action").isin(*actions) & F.col("ok") & (F.col("ts") >= now - F.make_dt_interval(F.lit(days))))
    return recent.groupBy("namespace").agg(F.count(F.lit(1)).alias("writes"), F.max("ts").alias("last_write"))


def dirty_namespaces(facts: DataFrame) -> DataFrame:
    """Namespaces whose newest fact is younger than their newest dossier."""
    newest = lambda c: F.max(F.when(c, F.col("created_at")))
    sums = facts.groupBy("namespace").agg(newest(F.col("kind") != "dossier").alias("newest_fact"), newest(F.col("kind") == "dossier").alias("newest_dossier"))
    return sums.where("newest_fact is not null and (newest_dossier is null or newest_fact > newest_dossier)")


def fact_clusters(facts: DataFrame, entities: Column, least: int = 3, most: int = 25) -> DataFrame:
    """Facts by subject and named entity: the biggest clusters of each namespace, with their turns."""
    keys = F.array_distinct(F.transform(F.concat(F.array("subject"), entities), F.lower))
    rows = facts.select("namespace", F.explode(keys).alias("entity"), "id", "source_turn_ids", "valid_from")
    sums = rows.groupBy("namespace", "entity").agg(F.countDistinct("id").alias("n_facts"), F.max("valid_from").alias("newest")).where(F.col("n_facts") >= least)
    order = Window.partitionBy("namespace").orderBy(F.desc("n_facts"), "entity")
    top = sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    turns = rows.join(top.select("namespace", "entity"), ["namespace", "entity"]).select("namespace", "entity", F.explode("source_turn_ids").alias("turn"))
    n_turns = turns.groupBy("namespace", "entity").agg(F.countDistinct("turn").alias("n_turns"))
    return top.join(n_turns, ["namespace", "entity"], "left").fillna(0, ["n_turns"])


def channel_census(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Channels that are published to or subscribed to, with their traffic."""
    sent = messages.groupBy("namespace", "channel").agg(F.count(F.lit(1)).alias("messages"), F.max("created_at").alias("last"), F.countDistinct("sender_session").alias("publishers"))
    read = subscriptions.groupBy("namespace", "channel").agg(F.countDistinct("session_name").alias("subscribers"))
    return sent.join(read, ["namespace", "channel"], "full_outer").fillna(0, ["messages", "publishers", "subscribers"])


def score_by_category(rows: DataFrame) -> DataFrame:
    """Share of correct answers by category and over all."""
    return rows.rollup("category").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("correct").cast("double")), 6).alias("accuracy"))


def stale_canary(facts: DataFrame) -> DataFrame:
    """How often belief changes serve the old value: over keys with a closed and a live value."""
    pairs = facts.groupBy("namespace", "subject", "predicate").agg(
        F.count_if(F.col("valid_to").isNotNull()).alias("old"), F.count_if(F.col("valid_to").isNull() & F.col("expired_at").isNull()).alias("current"),
        F.max_by("object", F.struct("observed_at", "id")).alias("newest"), F.max_by(F.when(F.col("valid_to").isNull(), F.col("object")), F.struct("observed_at", "id")).alias("served"),
    ).where("old > 0")
    return pairs.groupBy("namespace").agg(
        F.count(F.lit(1)).alias("pairs"), F.round(F.avg((F.col("current") > 0).cast("double")), 6).alias("current_served"), F.round(F.avg(F.col("newest").eqNullSafe(F.col("served")).cast("double")), 6).alias("stale_suppressed")
    )


def tool_outcomes(events: DataFrame) -> DataFrame:
    """What happens after a tool is used, until the next human turn of its session: ``events(session, seq, kind, name)``.

    ``kind`` is human, use, action or error. Segments are running counts of human turns.
    """
    order = Window.partitionBy("session").orderBy("seq")
    rows = events.withColumn("segment", F.sum((F.col("kind") == "human").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    counts = rows.groupBy("session", "segment").agg(F.count_if(F.col("kind") == "action").alias("actions"), F.count_if(F.col("kind") == "error").alias("errors"))
    uses = rows.where("kind = 'use'").groupBy("session", "segment", "name").agg(F.count(F.lit(1)).alias("n"))
    found = uses.join(counts, ["session", "segment"]).groupBy("name")
    return found.agg(F.sum("n").alias("uses"), F.countDistinct("session").alias("sessions"), F.sum("actions").alias("actions"), F.sum("errors").alias("errors"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def approx_total(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.approx_count_distinct(column).alias("approx_rows"))
