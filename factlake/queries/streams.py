"""Batch forms of the streaming operators over whole tables; their stream forms are tested on file streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.plans import adapters as t
from factlake.plans.adapters import oracle
from factlake.registry import query
from factlake.streaming import feeds as op


@query(oracle(", c AS (SELECT 's' || k AS subscriber, 'team:' || k AS namespace, k * 300000 AS cursor FROM range(4) r(k)) SELECT subscriber, namespace, id, CAST(row_number() OVER (PARTITION BY subscriber, namespace ORDER BY id) AS INTEGER) AS n FROM turns JOIN c USING (namespace) WHERE id > cursor QUALIFY n <= 20", "turns"))
def h1_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    cursors = spark.range(4).selectExpr("concat('s', id) as subscriber", "concat('team:', id) as namespace", "id * 300000 as cursor")
    return op.feed(t.turns(spark, sf_dir), cursors, 20).select("subscriber", "namespace", "id", "n")


@query(oracle('SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS "end", action, count(*) AS calls, count(*) FILTER (WHERE NOT ok) AS failures, round(avg(latency_ms), 6) AS mean_ms FROM audit GROUP BY ALL', "audit"))
def h13_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.metrics(t.audit(spark, sf_dir), "1 hour")


@query(
    oracle(
        """, w AS (SELECT ts, action, ok, latency_ms, time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(30 * k) AS start FROM audit, range(2) r(k))
SELECT start, start + INTERVAL 1 HOUR AS "end", action, count(*) AS calls, count(*) FILTER (WHERE NOT ok) AS failures, round(avg(latency_ms), 6) AS mean_ms FROM w GROUP BY ALL""",
        "audit",
    )
)
def h13_sliding_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.metrics(t.audit(spark, sf_dir), "1 hour", "30 minutes")


@query(
    oracle(
        """, h AS (SELECT namespace, sender_session AS name, created_at AS ts FROM messages), m AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 60 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS s FROM h WINDOW w AS (PARTITION BY namespace, name ORDER BY ts)),
g AS (SELECT *, sum(s) OVER (PARTITION BY namespace, name ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT namespace, name, min(ts) AS active_from, max(ts) + INTERVAL 60 MINUTE AS active_until, count(*) AS beats FROM g GROUP BY namespace, name, k""",
        "messages",
    )
)
def h5_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    beats = t.messages(spark, sf_dir).selectExpr("namespace", "sender_session as name", "created_at as ts")
    return op.presence(beats, "60 minutes")


@query("SELECT ns AS namespace, name, ts, before, status FROM (SELECT 'n' AS ns, 'user_' || user_id AS name, ts, event_type AS status, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE status IS DISTINCT FROM before")
def h5_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    beats = t.table(spark, sf_dir, "events").selectExpr("'n' as namespace", "concat('user_', user_id) as name", "ts", "event_id as id", "event_type as status")
    return op.transitions(beats)


@query("SELECT status BETWEEN 400 AND 499 AND status NOT IN (408, 429) AS rejected, count(*) AS n FROM (SELECT DISTINCT ON (user_id) user_id, CASE user_id % 4 WHEN 0 THEN 400 WHEN 1 THEN 429 WHEN 2 THEN 500 ELSE 404 END AS status FROM events) GROUP BY 1")
def h9_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    writes = t.table(spark, sf_dir, "events").selectExpr("user_id as item_id", "case user_id % 4 when 0 then 400 when 1 then 429 when 2 then 500 else 404 end as status")
    good, bad = op.replay(writes)
    return good.select(F.lit(False).alias("rejected")).unionAll(bad.select(F.lit(True).alias("rejected"))).groupBy("rejected").agg(F.count(F.lit(1)).alias("n"))


@query()
def h4_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = t.table(spark, sf_dir, "events").selectExpr("user_id as message_id", "concat('s', event_id % 3) as session", "case event_type when 'view' then 'release' when 'purchase' then 'done' else 'claim' end as action", "ts", "event_id as id")
    return op.claim_state(events, F.expr("timestamp_ntz'2024-01-12 00:00:00'"), lease_minutes=1440, most=3)


@query(
    """WITH e AS (SELECT user_id * 7 + event_id % 3 AS item_id, CASE WHEN user_id % 2 = 0 THEN 't' || user_id END AS thread_key, CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'act' WHEN 'error' THEN 'recall' ELSE 'send' END AS action, ts, event_id AS id FROM events),
v AS (SELECT *, coalesce(max(CASE WHEN action = 'act' THEN 1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS acted FROM e),
l AS (SELECT item_id, arg_max(action, (ts, id)) AS state, min((ts, id)) AS sent, any_value(thread_key) AS thread_key FROM v WHERE NOT (action = 'recall' AND acted = 1) GROUP BY item_id),
n AS (SELECT *, CASE WHEN thread_key IS NOT NULL THEN lead(item_id) OVER (PARTITION BY thread_key ORDER BY sent) END AS newer FROM l)
SELECT item_id, thread_key, CASE WHEN state IN ('send', 'read') AND newer IS NOT NULL THEN 'superseded' ELSE state END AS state, CASE WHEN state IN ('send', 'read') THEN newer END AS superseded_by FROM n"""
)
def h8_inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = t.table(spark, sf_dir, "events").selectExpr(
        "user_id * 7 + event_id % 3 as item_id", "case when user_id % 2 = 0 then concat('t', user_id) end as thread_key", "case event_type when 'view' then 'read' when 'click' then 'act' when 'error' then 'recall' else 'send' end as action", "ts", "event_id as id"
    )
    return op.inbox_state(events)


@query()
def h16_handoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = t.table(spark, sf_dir, "events").selectExpr("user_id as chain", "event_id as n", "case event_type when 'view' then 'offered' when 'click' then 'accepted' when 'error' then 'declined' when 'signup' then 'offered' else 'done' end as state", "concat('a', event_id % 4) as holder")
    return op.handoffs(records, 8)


@query("SELECT user_id AS principal_id, 'a' || user_id % 3 AS from_ns, event_type AS to_ns, count(*) AS hits, max(ts) AS last FROM events GROUP BY ALL HAVING NOT bool_or(event_id % 50 = 0)")
def h12_nudges(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = t.table(spark, sf_dir, "events").selectExpr("user_id as principal_id", "concat('a', user_id % 3) as from_ns", "event_type as to_ns", "ts", "event_id % 50 = 0 as delivered")
    return op.nudges(events)


@query(
    oracle(
        """, s AS (SELECT sender_session AS session_name, max(created_at) AS last_seen FROM messages GROUP BY 1), u AS (SELECT DISTINCT sender_session AS session_name, channel || (id % 3) AS channel FROM messages),
i AS (SELECT session_name FROM s WHERE last_seen < TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 3 DAY), o AS (SELECT * FROM messages WHERE created_at < TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 10 DAY),
k AS (SELECT channel FROM messages WHERE created_at >= TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 10 DAY UNION SELECT channel FROM u WHERE session_name NOT IN (SELECT session_name FROM i))
SELECT 'messages' AS kind, count(*) AS n FROM o UNION ALL SELECT 'sessions', count(*) FROM i UNION ALL SELECT 'subscriptions', count(*) FROM u WHERE session_name IN (SELECT session_name FROM i)
UNION ALL SELECT 'channels', count(*) FROM (SELECT channel FROM messages UNION SELECT channel FROM u) WHERE channel NOT IN (SELECT channel FROM k)""",
        "messages",
    )
)
def h11_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = t.messages(spark, sf_dir)
    sessions = messages.groupBy(F.col("sender_session").alias("session_name")).agg(F.max("created_at").alias("last_seen"))
    subs = messages.selectExpr("sender_session as session_name", "concat(channel, id % 3) as channel").distinct()
    return op.retention(messages, subs, sessions, F.expr("timestamp_ntz'2024-02-01 00:00:00'"), 10, 3)
