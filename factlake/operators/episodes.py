"""Episodes: sessions cut at gaps, segmentation by surprise, decay, clusters for consolidation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], order: list[str], starts: Column, name: str = "island") -> DataFrame:
    """Number runs of rows: a row where ``starts`` holds begins the next one. ``starts`` may look back with ``lag``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("__start", F.coalesce(starts, F.lit(True)).cast("int"))
    return marked.withColumn(name, F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__start")


def numbered_by_day(turns: DataFrame, gap_minutes: int) -> DataFrame:
    """Add ``episode``, the number of a turn's episode in its namespace.

    Turns are put in order within days, and only what the last turn of each day was, and how many episodes
    begin in it, goes through one order for the namespace. Turns without a time come first, as a day of their own.
    """
    rows = turns.withColumn("__day", F.to_date("observed_at"))
    order = F.struct("observed_at", "id")
    days = rows.groupBy("namespace", "__day").agg(F.max_by(F.struct("session_id", "observed_at"), order).alias("__last"))
    by_day = Window.partitionBy("namespace").orderBy("__day")
    days = days.withColumn("__before", F.lag("__last").over(by_day)).select("namespace", "__day", "__before")
    w = Window.partitionBy("namespace", "__day").orderBy("observed_at", "id")
    rows = rows.withColumn("__prev", F.lag(F.struct("session_id", "observed_at")).over(w))
    rows = rows.join(days.withColumnsRenamed({"namespace": "__ns", "__day": "__d"}), (F.col("namespace") == F.col("__ns")) & F.col("__day").eqNullSafe(F.col("__d")), "left").drop("__ns", "__d")
    prev = F.coalesce("__prev", "__before")
    apart = (prev["session_id"] != F.col("session_id")) | (F.col("observed_at") > prev["observed_at"] + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(gap_minutes)))
    rows = rows.withColumn("__start", F.coalesce(apart, F.lit(True)).cast("int"))
    starts = rows.groupBy("namespace", "__day").agg(F.sum("__start").alias("__n"))
    starts = starts.withColumn("__offset", F.coalesce(F.sum("__n").over(by_day.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = starts.select(F.col("namespace").alias("__ns"), F.col("__day").alias("__d"), "__offset")
    rows = rows.withColumn("episode", F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(starts, (F.col("namespace") == F.col("__ns")) & F.col("__day").eqNullSafe(F.col("__d")), "left").withColumn("episode", F.col("episode") + F.col("__offset"))
    return rows.drop("__ns", "__d", "__offset", "__start", "__prev", "__before", "__day")


def segment_episodes(turns: DataFrame, gap_minutes: int = 30, summarise: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]] | None = None, letters: int = 400) -> DataFrame:
    """Episodes of a namespace: a change of session or a gap begins the next.

    Each has its turns, span, a summary, a salience of 0.3 + 0.1 for each turn (at most 1), and a type if all
    its turns agree on one. The summary is an extract of the first two sentences, at most ``letters`` letters, or
    what ``summarise`` makes of batches of ``(namespace, episode, text)``, as ``(namespace, episode, summary)``.
    Of an episode's texts only what begins with ``letters`` letters and one, blanks not counted, is gathered.
    """
    rows = numbered_by_day(turns, gap_minutes)
    w = Window.partitionBy("namespace", "episode").orderBy("observed_at", "id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length(F.regexp_replace("text", r"\s+", ""))).over(w), F.lit(0))
    begin = F.when(before <= letters, F.regexp_extract("text", rf"(?s)^(?:\s*+\S){{0,{letters + 1}}}+\s*+", 0))
    turns_of = F.array_sort(F.collect_list(F.struct("observed_at", "id", "__begin")))
    found = rows.withColumn("__begin", begin).groupBy("namespace", "episode").agg(
        F.min("observed_at").alias("t_start"), F.max("observed_at").alias("t_end"), F.count(F.lit(1)).alias("n_turns"), turns_of.alias("__t"),
        F.min("memory_type").alias("__low"), F.max("memory_type").alias("__high"), F.count("memory_type").alias("__typed"),
    )
    joined = F.array_join(F.transform("__t", lambda t: t["__begin"]), " ")
    sentences = F.slice(F.split(F.regexp_replace(joined, r"([.!?])\s+", "$1\u0001"), "\u0001"), 1, 2)
    found = found.select(
        "namespace", "episode", "t_start", "t_end", "n_turns", F.transform("__t", lambda t: t.id).alias("source_turn_ids"), joined.alias("__text"), F.substring(F.array_join(sentences, " "), 1, letters).alias("summary"),
        F.least(F.lit(1.0), 0.3 + 0.1 * F.col("n_turns")).alias("salience"), F.when((F.col("__low") == F.col("__high")) & (F.col("__typed") == F.col("n_turns")), F.col("__low")).alias("memory_type"),
    )
    if summarise is not None:
        made = found.select("namespace", "episode", F.col("__text").alias("text")).mapInPandas(summarise, "namespace string, episode long, summary string")
        columns = [c for c in found.columns if c != "__text"]
        found = found.drop("summary").join(made, ["namespace", "episode"], "left").select(columns)
    return found.drop("__text")


def segment_events(turns: DataFrame, gap_hours: int = 6, surprise: float = 0.55, most: int = 8) -> DataFrame:
    """Events of a session: a gap, ``most`` turns, or a turn unlike the event so far begins the next.

    The running centroid makes this sequential, so each session is one group; sessions are bounded by
    what people say in one. Returns ``(namespace, session_id, id, event)``.
    """

    def cut(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["observed_at", "id"])
        events, event, n, total, last = [], 0, 0, None, None
        for at, vector in zip(pdf["observed_at"], pdf["embedding"]):
            v = None if vector is None else np.asarray(vector, np.float64)
            unlike = total is not None and v is not None and (total @ v) / ((np.linalg.norm(total) or 1.0) * (np.linalg.norm(v) or 1.0)) < 1 - surprise
            if n and (n >= most or at - last > pd.Timedelta(hours=gap_hours) or unlike):
                event, n, total = event + 1, 0, None
            events.append(event)
            n, last = n + 1, at
            total = v if total is None else total if v is None else total + v
        return pd.DataFrame({"namespace": key[0], "session_id": key[1], "id": pdf["id"].to_numpy(), "event": events})

    return turns.groupBy("namespace", "session_id").applyInPandas(cut, "namespace string, session_id string, id long, event int")


def decay(episodes: DataFrame, now: Column, half_life_days: float) -> DataFrame:
    """Strength: halves with age, and grows with up to ten accesses; at most 1."""
    age = (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("t_end").cast("timestamp"))) / 86400.0
    return episodes.withColumn("strength", F.round(F.least(F.lit(1.0), F.pow(F.lit(2.0), -age / half_life_days) + 0.05 * F.least("access_count", F.lit(10))), 6))


def touch(episodes: DataFrame, log: DataFrame) -> DataFrame:
    """Access counts and times brought up to date from ``log(id, at)``."""
    seen = log.groupBy("id").agg(F.count(F.lit(1)).alias("__n"), F.max("at").alias("__at"))
    rows = episodes.join(seen, "id", "left")
    return rows.withColumns({"access_count": F.col("access_count") + F.coalesce("__n", F.lit(0)), "last_access": F.greatest("last_access", "__at")}).drop("__n", "__at")


def uncovered_turns(turns: DataFrame, episodes: DataFrame) -> DataFrame:
    return turns.join(episodes.select(F.explode("source_turn_ids").alias("id")), "id", "left_anti")


def link_provenance(facts: DataFrame, episodes: DataFrame) -> DataFrame:
    """Facts and episodes that share a turn: equality on exploded turns, not a test of all pairs."""
    f = facts.select(F.col("id").alias("fact_id"), F.explode("source_turn_ids").alias("turn"))
    e = episodes.select(F.col("id").alias("episode_id"), F.explode("source_turn_ids").alias("turn"))
    return f.join(e, "turn").select("fact_id", "episode_id").distinct()


def accept_conclusions(rows: DataFrame) -> DataFrame:
    """Conclusions with at least two valid supports and a known confidence: ``rows(id, supports, n_sources, confidence)``."""
    valid = F.array_distinct(F.filter("supports", lambda i: (i >= 0) & (i < F.col("n_sources"))))
    level = F.when(F.col("confidence") == "low", 0.3).when(F.col("confidence") == "medium", 0.6).when(F.col("confidence") == "high", 0.9)
    return rows.withColumns({"supports": valid, "score": level}).where((F.size("supports") >= 2) & F.col("score").isNotNull())


def consolidate(facts: DataFrame, generate: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]] | None = None, least: int = 3, top: int = 3) -> DataFrame:
    """One statement for each subject of several facts: ``(namespace, subject, statement, n_facts)``.

    ``generate`` turns batches of ``(namespace, subject, statements, n_facts)`` into results; by default
    the most recent statements are joined.
    """
    order = Window.partitionBy("namespace", "subject").orderBy(F.desc("observed_at"), F.desc("id"))
    ranked = facts.withColumns({"__n": F.row_number().over(order), "__c": F.count(F.lit(1)).over(Window.partitionBy("namespace", "subject"))})
    kept = ranked.where((F.col("__c") >= least) & (F.col("__n") <= top))
    rows = kept.groupBy("namespace", "subject").agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", "statement"))), lambda s: s.statement).alias("statements"), F.max("__c").alias("n_facts"))
    if generate is None:
        return rows.select("namespace", "subject", F.array_join("statements", "; ").alias("statement"), "n_facts")
    return rows.mapInPandas(generate, "namespace string, subject string, statement string, n_facts long")


def mark_consolidated(episodes: DataFrame, done: DataFrame) -> DataFrame:
    """Episodes with ``consolidated`` set where ``done(id)`` names them; what was set stays."""
    marks = done.select("id").distinct().withColumn("__done", F.lit(True))
    return episodes.join(marks, "id", "left").withColumn("consolidated", F.coalesce("consolidated", F.lit(False)) | F.coalesce("__done", F.lit(False))).drop("__done")


def unconsolidated(episodes: DataFrame) -> DataFrame:
    return episodes.where(~F.coalesce("consolidated", F.lit(False)))
