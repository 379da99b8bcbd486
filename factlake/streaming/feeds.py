"""Feeds, presence, metrics and replays over streams, with their batch forms.

Watermarks bound the state: rows later than the watermark are dropped, which the batch forms don't do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Tasks that a subscriber's rows are posted from.
POSTS = 8


def feed(turns: DataFrame, cursors: DataFrame, limit: int) -> DataFrame:
    """The next items after each subscriber's cursor: ``cursors(subscriber, namespace, cursor)``."""
    rows = turns.join(cursors, "namespace").where("id > cursor")
    order = Window.partitionBy("subscriber", "namespace").orderBy("id")
    return rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit)


def advance(cursors: DataFrame, delivered: DataFrame) -> DataFrame:
    """Cursors moved to the last item delivered."""
    last = delivered.groupBy("subscriber", "namespace").agg(F.max("id").alias("__last"))
    return cursors.join(last, ["subscriber", "namespace"], "left").withColumn("cursor", F.coalesce("__last", "cursor")).drop("__last")


def metrics(audit: DataFrame, size: str, slide: str | None = None, watermark: str | None = None) -> DataFrame:
    """Calls, failures and mean latency by action and time window; on a stream give a watermark."""
    rows = audit.withWatermark("ts", watermark) if watermark else audit
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    found = rows.groupBy(window.alias("w"), "action").agg(F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("ok")).alias("failures"), F.round(F.avg("latency_ms"), 6).alias("mean_ms"))
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "action", "calls", "failures", "mean_ms")


def presence(heartbeats: DataFrame, ttl: str, watermark: str | None = None) -> DataFrame:
    """Spans during which a session was active: heartbeats at most ``ttl`` apart, and ``ttl`` beyond the last."""
    rows = heartbeats.withWatermark("ts", watermark) if watermark else heartbeats
    found = rows.groupBy(F.session_window("ts", ttl).alias("w"), "namespace", "name").agg(F.count(F.lit(1)).alias("beats"))
    return found.select("namespace", "name", F.col("w.start").alias("active_from"), F.col("w.end").alias("active_until"), "beats")


def transitions(heartbeats: DataFrame) -> DataFrame:
    """Heartbeats at which a session's status differs from the one before."""
    w = Window.partitionBy("namespace", "name").orderBy("ts", "id")
    rows = heartbeats.withColumn("before", F.lag("status").over(w))
    return rows.where(~F.col("status").eqNullSafe(F.col("before"))).select("namespace", "name", "ts", "before", "status")


def replay(writes: DataFrame, watermark: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Queued writes, once each: those to apply, and those that can't ever be (kept aside)."""
    once = writes.withWatermark("queued_at", watermark).dropDuplicatesWithinWatermark(["item_id"]) if watermark else writes.dropDuplicates(["item_id"])
    lasting = F.col("status").isNotNull() & F.col("status").between(400, 499) & ~F.col("status").isin(408, 429)
    return once.where(~lasting), once.where(lasting)


def deliver(post: Callable[[list], None], path: str, most: int = 5) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that posts each subscriber's rows, at least once.

    ``post`` gets a list of rows on the executors and raises if it fails. What failed is kept below ``path``
    with the number of its failures in a row and posted again with the next batch; a subscriber with
    ``most`` of them is not posted to any more, and its rows wait there. A batch that is run again
    overwrites what it left; what earlier batches than the last left is removed, and a path without any is a
    fresh start, whatever the batch's number. The rows of a subscriber are dealt to :data:`POSTS` tasks.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        schema = T.StructType([*df.schema.fields, T.StructField("failures", T.IntegerType())])
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        left = sorted(int(f.getPath().getName()[6:]) for f in files.listStatus(folder) if f.getPath().getName().startswith("epoch-")) if files.exists(folder) else []
        before = [n for n in left if n < epoch]
        waiting = spark.read.schema(schema).parquet(f"{path}/epoch-{before[-1]}") if before else spark.createDataFrame([], schema)
        worst = waiting.groupBy("subscriber").agg(F.max("failures").alias("__worst"))
        rows = df.withColumn("failures", F.lit(0)).unionByName(waiting).join(worst, "subscriber", "left").withColumn("failures", F.coalesce("__worst", F.lit(0))).select(schema.names)

        def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for _, own in pdf.groupby("subscriber"):
                    try:
                        post(own.drop(columns="failures").to_dict("records"))
                    except Exception:  # whatever the caller's post raises counts as a failure
                        yield own.assign(failures=own["failures"] + 1)

        dealt = rows.where(F.col("failures") < most).withColumn("__task", F.pmod(F.xxhash64(F.to_json(F.struct(*df.columns))), F.lit(POSTS))).repartition("subscriber", "__task").drop("__task")
        dealt.mapInPandas(send, schema).unionByName(rows.where(F.col("failures") >= most)).write.mode("overwrite").parquet(f"{path}/epoch-{epoch}")
        for n in before[:-1]:
            files.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/epoch-{n}"), True)

    return batch


def supersede_stream(facts: DataFrame, watermark: str | None = None) -> DataFrame:
    """Closings as facts arrive, late ones included: ``(namespace, subject, predicate, id, superseded_by, closed_at)``.

    State for each key is its facts in order of observation, so a late fact is born closed and may take
    over the closing of earlier ones; each change is emitted. The last row for an id holds. With a
    ``watermark``, facts that come later than it are dropped, and a fact whose closer was observed before
    it is final and leaves the state; without one the state of a key grows with its facts.
    """
    out = "namespace string, subject string, predicate string, id long, superseded_by long, closed_at timestamp"

    def close(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = [tuple(r) for r in state.get[0]] if state.exists else []
        final = state.getCurrentWatermarkMs() * 1000 if watermark else -1
        for pdf in batches:
            rows += [(int(i), int(at.value // 1000), o, bool(c), -1) for i, at, o, c in zip(pdf["id"], pdf["observed_at"], pdf["object"], pdf["closer"]) if at.value // 1000 >= final]
        rows.sort(key=lambda r: (r[1], r[0]))
        changed, kept, first, other = [], [], None, None  # the next closer, and the next one with another object than it has
        for i, at, o, c, by in reversed(rows):
            closer = first if first is None or first[2] != o else other
            now = closer[0] if closer else -1
            if now != by:
                changed.append((*key, i, now, pd.Timestamp(closer[1], unit="us")))
            if not closer or closer[1] >= final:
                kept.append((i, at, o, c, now))
            if c:
                first, other = (i, at, o), first if first is None or first[2] != o else other
        state.update((kept,))
        yield pd.DataFrame(changed, columns=["namespace", "subject", "predicate", "id", "superseded_by", "closed_at"])

    keyed = (facts.withWatermark("observed_at", watermark) if watermark else facts).groupBy("namespace", "subject", "predicate")
    state = "facts array<struct<id: long, at: long, object: string, closer: boolean, superseded_by: long>>"
    return keyed.applyInPandasWithState(close, out, state, "update", GroupStateTimeout.NoTimeout)


def claim_state(events: DataFrame, at: Column, lease_minutes: int = 15, most: int = 3) -> DataFrame:
    """Who holds each message at a time, from ``events(message_id, session, action, ts, id)``.

    Folded in order: a claim takes a message that is free or whose lease has run out, unless it was done
    or has been claimed ``most`` times; release and done count only from the holder.
    """
    log = F.array_sort(F.collect_list(F.struct("ts", "id", "session", "action")))
    lease = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(lease_minutes))
    nobody = F.struct(F.lit(None).cast("string").alias("holder"), F.lit(None).cast("timestamp_ntz").alias("until"), F.lit(0).alias("attempts"), F.lit(False).alias("done"))

    def fold(s: Column, e: Column) -> Column:
        free = s.holder.isNull() | (s.until <= e.ts)
        mine = (s.holder == e.session) & (s.until > e.ts)
        state = lambda holder, until, attempts, done: F.struct(holder.alias("holder"), until.alias("until"), attempts.alias("attempts"), done.alias("done"))
        none, no_time = F.lit(None).cast("string"), F.lit(None).cast("timestamp_ntz")
        return (
            F.when((e.action == "claim") & free & ~s.done & (s.attempts < most), state(e.session, (e.ts + lease).cast("timestamp_ntz"), s.attempts + 1, F.lit(False)))
            .when((e.action == "release") & mine, state(none, no_time, s.attempts, s.done))
            .when((e.action == "done") & mine, state(none, no_time, s.attempts, F.lit(True)))
            .otherwise(s)
        )

    found = events.where(F.col("ts") <= at).groupBy("message_id").agg(F.aggregate(log, nobody, fold).alias("s"))
    held = F.when(F.col("s.until") > at, F.col("s.holder"))
    return found.select("message_id", held.alias("holder"), F.col("s.attempts").alias("attempts"), F.col("s.done").alias("done"), (~F.col("s.done") & held.isNull() & (F.col("s.attempts") < most)).alias("offered"))


def inbox_state(events: DataFrame) -> DataFrame:
    """The state of each inbox item after its last valid event; a newer item of a thread supersedes older open ones.

    ``events(item_id, thread_key, action, ts, id)``; an acted item can no longer be recalled.
    """
    w = Window.partitionBy("item_id").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    acted = F.coalesce(F.max((F.col("action") == "act").cast("int")).over(w), F.lit(0)) == 1
    valid = events.withColumn("__acted", acted).where(~((F.col("action") == "recall") & F.col("__acted")))
    last = valid.groupBy("item_id").agg(F.max_by("action", F.struct("ts", "id")).alias("state"), F.min(F.struct("ts", "id")).alias("sent"), F.first("thread_key", ignorenulls=True).alias("thread_key"))
    newer = F.lead("item_id").over(Window.partitionBy("thread_key").orderBy("sent"))
    rows = last.withColumn("__newer", F.when(F.col("thread_key").isNotNull(), newer))
    open_ = F.col("state").isin("send", "read")
    return rows.select("item_id", "thread_key", F.when(open_ & F.col("__newer").isNotNull(), "superseded").otherwise(F.col("state")).alias("state"), F.when(open_, F.col("__newer")).alias("superseded_by"))


def handoffs(records: DataFrame, hop_limit: int) -> DataFrame:
    """Current state of hand-off chains: ``records(chain, n, state, holder)``; only allowed moves count, closed chains stay closed."""
    log = F.array_sort(F.collect_list(F.struct("n", "state", "holder")))
    allowed = {"": ("offered",), "offered": ("accepted", "declined"), "accepted": ("offered", "done"), "declined": ("offered",)}
    start = F.struct(F.lit("").alias("state"), F.lit(None).cast("string").alias("holder"), F.lit(0).alias("hops"))

    def fold(s: Column, e: Column) -> Column:
        ok = F.lit(False)
        for before, after in allowed.items():
            ok = ok | ((s.state == before) & e.state.isin(*after))
        return F.when(ok, F.struct(e.state.alias("state"), e.holder.alias("holder"), (s.hops + (e.state == "accepted").cast("int")).alias("hops"))).otherwise(s)

    found = records.groupBy("chain").agg(F.aggregate(log, start, fold).alias("s"))
    return found.select("chain", "s.state", "s.holder", "s.hops", (F.col("s.hops") > hop_limit).alias("over_limit"))


def nudges(events: DataFrame) -> DataFrame:
    """Hits for each (principal, from, to) that was not delivered yet, the newest first."""
    sums = events.groupBy("principal_id", "from_ns", "to_ns").agg(F.count(F.lit(1)).alias("hits"), F.max("ts").alias("last"), F.bool_or("delivered").alias("__d"))
    return sums.where(~F.col("__d")).drop("__d")


def retention(messages: DataFrame, subscriptions: DataFrame, sessions: DataFrame, now: Column, keep_days: int, idle_days: int) -> DataFrame:
    """What a clean-up would drop, by kind: old messages, idle sessions, subscriptions of those, channels left without either."""
    ago = lambda n: now - F.make_dt_interval(F.lit(n))
    idle = sessions.where(F.col("last_seen") < ago(idle_days)).select("session_name")
    dead = subscriptions.join(idle, "session_name", "left_semi")
    old = messages.where(F.col("created_at") < ago(keep_days))
    left = messages.where(F.col("created_at") >= ago(keep_days)).select("channel").union(subscriptions.join(idle, "session_name", "left_anti").select("channel")).distinct()
    orphans = messages.select("channel").union(subscriptions.select("channel")).distinct().join(left, "channel", "left_anti")
    count = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(old, "messages").unionByName(count(idle, "sessions")).unionByName(count(dead, "subscriptions")).unionByName(count(orphans, "channels"))


def dedupe_exchanges(exchanges: DataFrame, watermark: str | None = None) -> DataFrame:
    """Captured exchanges once each, by conversation, question and answer: ``exchanges(conversation, user_text, reply, ts)``.

    On a stream, repeats within ``watermark`` are dropped with bounded state; in a batch, all are.
    """
    rows = exchanges.withColumn("__key", F.sha2(F.concat_ws("\u0001", F.coalesce("user_text", F.lit("")), F.coalesce("reply", F.lit(""))), 256))
    once = rows.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["conversation", "__key"]) if watermark else rows.dropDuplicates(["conversation", "__key"])
    return once.drop("__key")


def observed_writes(writes: DataFrame, now: Column) -> DataFrame:
    """Replayed writes as they are stored: observed when they are committed, while the time they were queued only
    dates the event: ``writes(item_id, queued_at, …)``."""
    return writes.withColumns({"observed_at": now, "event_at": F.coalesce("queued_at", now)})


def lease_spans(events: DataFrame, ttl_seconds: int = 1200) -> DataFrame:
    """Who held each lease when: ``(namespace, key, holder, acquired_at, ended_at)`` from ``events(namespace, key, holder, action, ts, id)``.

    An acquire takes a lease that is free or has run out; a heartbeat of the holder that comes in time extends
    it; a release of the holder ends it. Events of a key are folded in order, one after the other with one
    row of state, so a key's log is never held whole.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, None  # (holder, acquired, until)
        ttl = pd.Timedelta(seconds=ttl_seconds)
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if (r.namespace, r.key) != key:
                    if held:
                        out.append((*key, *held))
                    key, held = (r.namespace, r.key), None
                if held and held[2] <= r.ts:
                    out.append((*key, *held))
                    held = None
                if r.action == "acquire" and not held:
                    held = (r.holder, r.ts, r.ts + ttl)
                elif r.action == "heartbeat" and held and held[0] == r.holder:
                    held = (held[0], held[1], r.ts + ttl)
                elif r.action == "release" and held and held[0] == r.holder:
                    out.append((*key, held[0], held[1], r.ts))
                    held = None
            yield pd.DataFrame(out, columns=["namespace", "key", "holder", "acquired_at", "ended_at"])
        if held:
            yield pd.DataFrame([(*key, *held)], columns=["namespace", "key", "holder", "acquired_at", "ended_at"])

    rows = events.select("namespace", "key", "holder", "action", "ts", "id").repartition("namespace", "key").sortWithinPartitions("namespace", "key", "ts", "id")
    return rows.mapInPandas(fold, "namespace string, key string, holder string, acquired_at timestamp_ntz, ended_at timestamp_ntz")


def lease_holders(spans: DataFrame, at: Column) -> DataFrame:
    """Leases that are held at a time; a lease that ends then is not."""
    return spans.where((F.col("acquired_at") <= at) & (F.col("ended_at") > at))
