"""Stream forms on file streams give what the batch forms give."""

import datetime as dt
import random

from pyspark.sql import functions as F

from factlake.operators import bitemporal
from factlake.streaming import feeds

T0 = dt.datetime(2024, 1, 1)


def run(df, tmp_path, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp" / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_windows_and_presence(spark, tmp_path):
    rng = random.Random(2)
    rows = [(T0 + dt.timedelta(minutes=rng.randint(0, 600)), rng.choice("ab"), rng.random() < 0.8, rng.randint(1, 9), "n", rng.choice("xy")) for _ in range(300)]
    rows.append((T0 + dt.timedelta(days=3), "a", True, 1, "n", "x"))  # closes the windows before it
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, "ts timestamp, action string, ok boolean, latency_ms int, namespace string, name string").write.parquet(path)
    batch = spark.read.parquet(path)
    stream = spark.readStream.schema(batch.schema).parquet(path)
    run(feeds.metrics(stream, "1 hour", watermark="10 minutes"), tmp_path, "metrics_out", "append")
    run(feeds.presence(stream.select("ts", "namespace", "name"), "30 minutes", "10 minutes"), tmp_path, "presence_out", "append")
    until = F.lit(T0 + dt.timedelta(days=2))
    for name, want, end in (("metrics_out", feeds.metrics(batch, "1 hour"), "end"), ("presence_out", feeds.presence(batch, "30 minutes"), "active_until")):
        got = sorted(map(str, spark.table(name).collect()))
        assert got and got == sorted(map(str, want.where(F.col(end) < until).collect()))


def test_incremental_supersession_with_late_facts(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, "n", rng.choice("AB"), "status", rng.choice(["x", "y", "z"]), T0 + dt.timedelta(minutes=rng.randint(0, 10**6)), True) for i in range(60)]
    schema = "id long, namespace string, subject string, predicate string, object string, observed_at timestamp, closer boolean"
    path = str(tmp_path / "in")
    for k in range(3):  # three arrivals, in no order of observation
        spark.createDataFrame(rows[k * 20 : k * 20 + 20], schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    seen = {}

    def take(df, epoch):
        for r in df.collect():
            seen[r["id"]] = r["superseded_by"]

    q = feeds.supersede_stream(stream).writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = spark.read.parquet(path).withColumn("statement", F.lit("now")).withColumn("valid_from", F.col("observed_at"))
    want = {r["id"]: r["superseded_by"] for r in bitemporal.supersede(batch).collect() if r["superseded_by"] is not None}
    assert {i: by for i, by in seen.items() if by != -1} == want


def test_supersession_with_a_watermark_forgets_what_is_final(spark, tmp_path):
    """Facts in order, in several batches: the same closings as without a watermark."""
    rng = random.Random(5)
    rows = [(i, "n", rng.choice("AB"), "status", rng.choice(["x", "y", "z"]), T0 + dt.timedelta(hours=i), rng.random() < 0.8) for i in range(90)]
    schema = "id long, namespace string, subject string, predicate string, object string, observed_at timestamp, closer boolean"
    path = str(tmp_path / "in")
    for k in range(5):
        spark.createDataFrame(rows[k * 18 : k * 18 + 18], schema).coalesce(1).write.mode("append").parquet(path)
    seen = {}

    def take(df, epoch):
        for r in df.collect():
            seen[r["id"]] = r["superseded_by"]

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(path)
    q = feeds.supersede_stream(stream, "100 hours").writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = {}
    for i, _, s, _, o, at, _ in rows:
        closers = [r for r in rows if r[2] == s and r[6] and r[4] != o and r[5] > at]
        if closers:
            want[i] = min(closers, key=lambda r: r[5])[0]
    assert seen == want


def test_replay_once(spark, tmp_path):
    rows = [(f"i{i % 10}", (None, 500, 429, 404)[i % 10 % 4], T0) for i in range(40)]
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, "item_id string, status int, queued_at timestamp").write.parquet(path)
    stream = spark.readStream.schema("item_id string, status int, queued_at timestamp").parquet(path)
    good, bad = feeds.replay(stream, "1 hour")
    run(good, tmp_path, "good_out", "append")
    run(bad, tmp_path, "bad_out", "append")
    assert spark.table("good_out").count() == 8 and {r["item_id"] for r in spark.table("bad_out").collect()} == {"i3", "i7"}


def test_claims_against_a_simulation(spark):
    rng = random.Random(6)
    events = [(rng.randint(1, 5), rng.choice("ab"), rng.choice(["claim", "claim", "release", "done"]), T0 + dt.timedelta(minutes=i * 3), i) for i in range(120)]
    at, state = T0 + dt.timedelta(minutes=200), {}
    for m, s, action, ts, _ in events:
        if ts > at:
            break
        holder, until, n, done = state.get(m, (None, None, 0, False))
        if action == "claim" and (holder is None or until <= ts) and not done and n < 3:
            state[m] = (s, ts + dt.timedelta(minutes=15), n + 1, False)
        elif action in ("release", "done") and holder == s and until > ts:
            state[m] = (None, None, n, done or action == "done")
        else:
            state[m] = (holder, until, n, done)
    frame = spark.createDataFrame(events, "message_id int, session string, action string, ts timestamp_ntz, id int")
    got = {r["message_id"]: (r["holder"], r["attempts"], r["done"]) for r in feeds.claim_state(frame, F.lit(at).cast("timestamp_ntz")).collect()}
    assert got == {m: (h if h and u > at else None, n, d) for m, (h, u, n, d) in state.items()}
