"""Leases and claims on streams against their batch forms, and holds that end though nothing more is said of them."""

import datetime as dt
import random

import pytest

from factlake.streaming import feeds, timed

T0 = dt.datetime(2024, 1, 1)
LEASES = "namespace string, key string, holder string, action string, ts timestamp, id long"
CLAIMS = "message_id long, session string, action string, ts timestamp, id long"


@pytest.fixture
def rocks(spark):
    name, value = timed.STATE_STORE
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    yield spark
    spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def stream(spark, tmp_path, parts, schema, make):
    """The rows that ``make`` of a stream gives, arriving in parts."""
    path = str(tmp_path / "in")
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    found = []
    made = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path))
    q = made.writeStream.foreachBatch(lambda df, _: found.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return found


def test_an_unrenewed_lease_expires_with_no_further_event(rocks, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    parts = [[("n", "k", "a", "acquire", at(0), 1), ("n", "k", "a", "heartbeat", at(30), 2)], [("n", "other", "b", "acquire", at(4000), 3)], [("n", "other", "b", "release", at(4010), 4)]]
    found = [(r["key"], r["event"], r["holder"], r["since"], r["at"]) for r in stream(rocks, tmp_path, parts, LEASES, lambda s: timed.lease_stream(s, 60, "1 second"))]
    assert ("k", "expired", "a", at(0), at(90)) in found and ("k", "acquired", "a", at(0), at(0)) in found


def test_leases_equal_their_spans(rocks, tmp_path):
    rng = random.Random(3)
    rows = [("n", rng.choice("kl"), rng.choice("abc"), rng.choice(["acquire", "acquire", "heartbeat", "release"]), T0 + dt.timedelta(seconds=rng.randint(0, 4000)), i) for i in range(200)]
    rows.sort(key=lambda r: r[4])
    parts = []
    for i in range(0, 200, 40):  # out of order within a part, and a little between parts
        part = rows[i : i + 40]
        rng.shuffle(part)
        parts.append(part)
    parts[1][0], parts[2][0] = parts[2][0], parts[1][0]
    end = [[("n", "z", "z", "acquire", T0 + dt.timedelta(days=k + 1), 1000 + k)] for k in range(2)]
    found = stream(rocks, tmp_path, parts + end, LEASES, lambda s: timed.lease_stream(s, 60, "1 hour"))
    got = sorted((r["key"], r["holder"], r["since"], r["at"]) for r in found if r["event"] in ("released", "expired") and r["key"] != "z")
    frame = rocks.createDataFrame(rows, LEASES).selectExpr("namespace", "key", "holder", "action", "cast(ts as timestamp_ntz) as ts", "id")
    assert got and got == sorted((r["key"], r["holder"], r["acquired_at"], r["ended_at"]) for r in feeds.lease_spans(frame, 60).collect())


def test_claims_equal_their_fold(rocks, tmp_path):
    rng = random.Random(5)
    rows = [(rng.randint(1, 5), rng.choice("ab"), rng.choice(["claim", "claim", "release", "done"]), T0 + dt.timedelta(minutes=i * 3), i) for i in range(120)]
    end = [[(99, "z", "claim", T0 + dt.timedelta(days=3 + k), 1000 + k)] for k in range(2)]
    found = stream(rocks, tmp_path, [rows[:60], rows[60:], *end], CLAIMS, lambda s: timed.claim_stream(s, 15, 3, "1 minute"))
    last = {}
    for r in sorted(found, key=lambda r: (r["at"], r["event"] == "claimed")):
        last[r["message_id"]] = (r["attempts"], r["event"] == "done")
    frame = rocks.createDataFrame(rows, CLAIMS).selectExpr("message_id", "session", "action", "cast(ts as timestamp_ntz) as ts", "id")
    from pyspark.sql import functions as F

    want = {r["message_id"]: (r["attempts"], r["done"]) for r in feeds.claim_state(frame, F.lit(T0 + dt.timedelta(days=2)).cast("timestamp_ntz")).collect() if r["attempts"]}
    assert {k: v for k, v in last.items() if k != 99} == want
