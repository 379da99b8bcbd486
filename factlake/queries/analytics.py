"""Queries over ledgers, censuses and health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.functions.text import extract_entities
from factlake.operators import analytics as op
from factlake.operators import bitemporal
from factlake.plans import adapters as t
from factlake.plans.adapters import oracle
from factlake.queries.bitemporal import _CLOSERS
from factlake.registry import query

_STATS = """SELECT action, count(*) AS calls, round(avg(CASE WHEN ok THEN 0.0 ELSE 1.0 END) * 100, 4) AS error_pct, round(avg(CASE WHEN status = 403 THEN 1.0 ELSE 0.0 END) * 100, 4) AS denied_pct,
  percentile_disc(0.5) WITHIN GROUP (ORDER BY latency_ms) AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms) AS p95,
  round(avg(CASE WHEN ok THEN CASE WHEN result_count = 0 THEN 1.0 ELSE 0.0 END END) * 100, 4) AS empty_pct FROM audit GROUP BY action"""


@query(oracle(_STATS, "audit"))
def g1_op_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.op_stats(t.audit(spark, sf_dir))


@query(oracle("SELECT op, count(*) AS calls, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, sum(cost_usd) AS cost_usd FROM usage GROUP BY op", "usage"))
def g2_usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.usage_rollup(t.usage(spark, sf_dir))


@query(
    oracle(
        """SELECT op, namespace, day, CASE grouping_id(op, namespace, day) WHEN 7 THEN 'total' WHEN 3 THEN 'op' WHEN 5 THEN 'namespace' ELSE 'day' END AS level, count(*) AS calls, sum(cost_usd) AS cost_usd
FROM (SELECT *, CAST(ts AS DATE) AS day FROM usage) GROUP BY GROUPING SETS ((), (op), (namespace), (day))""",
        "usage",
    )
)
def g3_usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.usage_summary(t.usage(spark, sf_dir)).select("op", "namespace", "day", "level", "calls", "cost_usd")


@query(
    oracle(
        """SELECT namespace, CAST(sum(CASE WHEN ts > TIMESTAMP '2000-01-31 00:00:00' - INTERVAL 1 DAY THEN cost_usd ELSE 0 END) AS DECIMAL(22,2)) AS day_usd,
  CAST(sum(CASE WHEN ts > TIMESTAMP '2000-01-31 00:00:00' - INTERVAL 30 DAY THEN cost_usd ELSE 0 END) AS DECIMAL(22,2)) AS month_usd,
  day_usd > 400000 AS over_day, month_usd > 15000000 AS over_month FROM usage WHERE ts <= TIMESTAMP '2000-01-31 00:00:00' GROUP BY namespace""",
        "usage",
    )
)
def g4_budget_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.expr("timestamp_ntz'2000-01-31 00:00:00'")
    return op.budget_status(t.usage(spark, sf_dir).where(F.col("ts") <= now), now, 400000, 15000000)


@query(
    oracle(
        """, r AS (SELECT namespace, ts, id, sum(cost_usd) OVER (PARTITION BY namespace ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS running_usd FROM
  (SELECT *, l_orderkey * 10 + l_linenumber AS id FROM (SELECT 'team:' || l_suppkey % 4 AS namespace, l_shipdate AS ts, l_orderkey, l_linenumber, l_partkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DECIMAL(22,2)) AS cost_usd FROM lineitem GROUP BY ALL)))
SELECT namespace, min(ts) AS ts FROM r WHERE running_usd > 50000000 GROUP BY namespace""",
        "usage",
    )
)
def h15_budget_breach(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.table(spark, sf_dir, "lineitem").selectExpr("concat('team:', l_suppkey % 4) as namespace", "l_shipdate as ts", "l_orderkey * 10 + l_linenumber as id", "cast(l_extendedprice as decimal(12,2)) as cost_usd")
    return op.first_breach(rows, 50000000).select("namespace", "ts")


_ORPHANS = """, nodes AS (SELECT DISTINCT namespace, subject AS name FROM facts UNION SELECT DISTINCT namespace, subject || '_alias' FROM facts WHERE subject LIKE '%1'),
orphans AS (SELECT namespace, count(*) AS entities, count(*) FILTER (WHERE name LIKE '%_alias') AS orphans FROM nodes GROUP BY namespace)"""


@query(
    oracle(
        _CLOSERS
        + _ORPHANS
        + """, c AS (SELECT namespace, subject, predicate FROM facts JOIN written USING (id) WHERE valid_to IS NULL AND expired_at IS NULL GROUP BY ALL HAVING count(DISTINCT object) > 1 AND bool_or(object <> 'unknown')),
cn AS (SELECT namespace, count(*) AS contradictions FROM c GROUP BY namespace),
s AS (SELECT namespace, count(*) FILTER (WHERE valid_to IS NULL AND expired_at IS NULL) AS live, count(*) FILTER (WHERE valid_to IS NOT NULL) AS superseded, count(*) FILTER (WHERE expired_at IS NOT NULL) AS expired
  FROM facts JOIN written USING (id) GROUP BY namespace)
SELECT namespace, live, superseded, expired, orphans, entities, contradictions,
  round_even(greatest(0.0, 100 - 40.0 * least(1.0, sqrt(contradictions / live / 0.10)) - 30.0 * orphans / entities), 3) AS score FROM s JOIN orphans USING (namespace) JOIN cn USING (namespace)""",
        "facts",
    )
)
def g5_knowledge_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = t.facts(spark, sf_dir)
    state = bitemporal.supersede(facts)
    names = facts.selectExpr("namespace", "subject as name").union(facts.where("subject like '%1'").selectExpr("namespace", "concat(subject, '_alias')")).distinct()
    ends = facts.selectExpr("namespace", "subject as name").distinct()
    orphans = names.join(ends.withColumn("linked", F.lit(True)), ["namespace", "name"], "left").groupBy("namespace").agg(F.count_if(F.col("linked").isNull()).alias("orphans"), F.count(F.lit(1)).alias("entities"))
    contradictions = bitemporal.contradictions(state).groupBy("namespace").agg(F.count(F.lit(1)).alias("contradictions"))
    return op.health(state, orphans, contradictions)


@query(
    oracle(
        f", s AS ({_STATS}), r AS (SELECT action, 'slow' AS finding, 'p95' AS measure, CAST(p95 AS DOUBLE) AS value, CAST(140 AS DOUBLE) AS threshold FROM s UNION ALL SELECT action, 'denials', 'denied_pct', denied_pct, 5.5 FROM s UNION ALL SELECT action, 'empty', 'empty_pct', empty_pct, 33.0 FROM s) SELECT * FROM r WHERE value > threshold",
        "audit",
    )
)
def g7_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.findings(op.op_stats(t.audit(spark, sf_dir)), [("slow", "p95", 140), ("denials", "denied_pct", 5.5), ("empty", "empty_pct", 33.0)])


@query(
    oracle(
        _CLOSERS
        + """, p AS (SELECT namespace, subject, predicate, count(*) FILTER (WHERE valid_to IS NOT NULL) AS old, count(*) FILTER (WHERE valid_to IS NULL AND expired_at IS NULL) AS cur,
  arg_max(object, (observed_at, id)) AS newest, arg_max(CASE WHEN valid_to IS NULL THEN object END, (observed_at, id)) FILTER (WHERE valid_to IS NULL) AS served FROM facts JOIN written USING (id) GROUP BY ALL HAVING old > 0)
SELECT namespace, count(*) AS pairs, round(avg(CASE WHEN cur > 0 THEN 1.0 ELSE 0.0 END), 6) AS current_served, round(avg(CASE WHEN newest IS NOT DISTINCT FROM served THEN 1.0 ELSE 0.0 END), 6) AS stale_suppressed FROM p GROUP BY namespace""",
        "facts",
    )
)
def g8_stale_canary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.stale_canary(bitemporal.supersede(t.facts(spark, sf_dir)))


@query(
    oracle(
        """, r AS (SELECT 'team:0' AS namespace UNION SELECT 'team:9' UNION SELECT 'secret:x' UNION SELECT 'team:*'), tn AS (SELECT namespace, count(*) AS turns FROM turns WHERE namespace <> 'team:3' GROUP BY 1), fn AS (SELECT namespace, count(*) AS facts FROM facts WHERE namespace <> 'team:1' GROUP BY 1)
SELECT namespace, coalesce(turns, 0) AS turns, coalesce(facts, 0) AS facts, namespace IN (SELECT namespace FROM r) AS registered FROM (SELECT namespace FROM r UNION SELECT namespace FROM tn UNION SELECT namespace FROM fn) n
LEFT JOIN tn USING (namespace) LEFT JOIN fn USING (namespace) WHERE NOT starts_with(namespace, 'secret:') AND NOT contains(namespace, '*')""",
        "turns",
        "facts",
    )
)
def g9_namespace_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = spark.createDataFrame([("team:0",), ("team:9",), ("secret:x",), ("team:*",)], "namespace string")
    return op.namespace_census(t.turns(spark, sf_dir).where("namespace <> 'team:3'"), t.facts(spark, sf_dir).where("namespace <> 'team:1'"), registry)


@query(
    oracle(
        """, n AS (SELECT 'src:' || source || ':' || lang AS namespace, CAST(0 AS BIGINT) AS turns, count(*) AS facts, TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(max(doc_id) % 60 AS INTEGER)) AS last_write FROM documents GROUP BY source, lang)
SELECT namespace, turns, facts, last_write, 'stale' AS reason FROM n WHERE last_write < TIMESTAMP '2024-03-01 00:00:00' - INTERVAL 30 DAY AND facts <= 20""",
        "turns",
    )
)
def g10_prune_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t.table(spark, sf_dir, "documents").selectExpr("concat('src:', source, ':', lang) as namespace", "doc_id")
    census = docs.groupBy("namespace").agg(F.lit(0).cast("long").alias("turns"), F.count(F.lit(1)).alias("facts"))
    last = docs.groupBy("namespace").agg(F.max("doc_id").alias("m")).selectExpr("namespace", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(m % 60 as int)) as last_write")
    return op.prune_candidates(census, last, F.expr("timestamp_ntz'2024-03-01 00:00:00'"), 30)


@query(oracle("SELECT namespace, count(*) AS writes, max(ts) AS last_write FROM audit WHERE action IN ('signup', 'purchase') AND ok AND ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY GROUP BY namespace", "audit"))
def g15_write_recap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.write_recap(t.audit(spark, sf_dir), F.expr("timestamp_ntz'2024-01-31 00:00:00'"), 7, ("signup", "purchase"))


@query(
    oracle(
        """, k AS (SELECT subject AS namespace, CASE WHEN predicate = 'signup' THEN 'dossier' ELSE 'fact' END AS kind, created_at FROM facts)
SELECT namespace, max(created_at) FILTER (WHERE kind <> 'dossier') AS newest_fact, max(created_at) FILTER (WHERE kind = 'dossier') AS newest_dossier FROM k GROUP BY namespace HAVING newest_fact IS NOT NULL AND (newest_dossier IS NULL OR newest_fact > newest_dossier)""",
        "facts",
    )
)
def g16_dirty_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.dirty_namespaces(t.facts(spark, sf_dir).selectExpr("subject as namespace", "case when predicate = 'signup' then 'dossier' else 'fact' end as kind", "created_at"))


@query(
    oracle(
        """, e AS (SELECT DISTINCT namespace, id, source_turn_ids, valid_from, unnest(CASE WHEN id % 11 = 0 THEN [subject, 'formerly'] ELSE [subject] END) AS entity FROM facts),
s AS (SELECT namespace, entity, count(DISTINCT id) AS n_facts, max(valid_from) AS newest FROM e GROUP BY namespace, entity HAVING n_facts >= 3),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY namespace ORDER BY n_facts DESC, entity) AS INTEGER) AS rank FROM s QUALIFY rank <= 25),
n AS (SELECT namespace, entity, count(DISTINCT t) AS n_turns FROM (SELECT namespace, entity, unnest(source_turn_ids) AS t FROM e) GROUP BY namespace, entity)
SELECT namespace, entity, n_facts, newest, rank, n_turns FROM r JOIN n USING (namespace, entity)""",
        "facts",
    )
)
def g17_fact_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.fact_clusters(t.facts(spark, sf_dir), extract_entities(F.col("statement")))


@query(
    oracle(
        """, sub AS (SELECT DISTINCT namespace, '#' || split_part(channel, '#', 2) AS channel, sender_session AS session_name FROM messages UNION SELECT 'team:0', '#quiet', 'session_1')
SELECT namespace, channel, coalesce(messages, 0) AS messages, last, coalesce(publishers, 0) AS publishers, coalesce(subscribers, 0) AS subscribers FROM
  (SELECT namespace, channel, count(*) AS messages, max(created_at) AS last, count(DISTINCT sender_session) AS publishers FROM messages GROUP BY ALL) FULL JOIN
  (SELECT namespace, channel, count(DISTINCT session_name) AS subscribers FROM sub GROUP BY ALL) USING (namespace, channel)""",
        "messages",
    )
)
def g20_channel_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = t.messages(spark, sf_dir)
    subs = messages.selectExpr("namespace", "channel", "sender_session as session_name")
    subs = subs.union(spark.createDataFrame([("team:0", "#quiet", "session_1")], "namespace string, channel string, session_name string")).distinct()
    return op.channel_census(messages, subs)


@query(oracle("SELECT action AS category, count(*) AS n, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM audit GROUP BY ROLLUP (action)", "audit"))
def g21_score_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.score_by_category(t.audit(spark, sf_dir).selectExpr("action as category", "ok as correct"))


@query(
    oracle(
        """, e AS (SELECT user_id AS session, event_id AS seq, CASE event_type WHEN 'signup' THEN 'human' WHEN 'view' THEN 'use' WHEN 'click' THEN 'use' WHEN 'error' THEN 'error' ELSE 'action' END AS kind, event_type AS name FROM events),
g AS (SELECT *, sum(CASE WHEN kind = 'human' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING) AS segment FROM e),
c AS (SELECT session, segment, count(*) FILTER (WHERE kind = 'action') AS actions, count(*) FILTER (WHERE kind = 'error') AS errors FROM g GROUP BY ALL),
u AS (SELECT session, segment, name, count(*) AS n FROM g WHERE kind = 'use' GROUP BY ALL)
SELECT name, CAST(sum(n) AS BIGINT) AS uses, count(DISTINCT session) AS sessions, CAST(sum(actions) AS BIGINT) AS actions, CAST(sum(errors) AS BIGINT) AS errors FROM u JOIN c USING (session, segment) GROUP BY name""",
        "audit",
    )
)
def g22_tool_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = t.table(spark, sf_dir, "events").selectExpr("user_id as session", "event_id as seq", "case event_type when 'signup' then 'human' when 'view' then 'use' when 'click' then 'use' when 'error' then 'error' else 'action' end as kind", "event_type as name")
    return op.tool_outcomes(events)


@query("SELECT 'documents' AS table_name, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'events', count(*) FROM events")
def a25_table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.table_counts({n: t.table(spark, sf_dir, n) for n in ("documents", "pages", "events")})


@query()
def g23_approx_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.approx_total(t.table(spark, sf_dir, "lineitem"), "l_orderkey")


@query(oracle("SELECT id, ts, action, status FROM audit WHERE NOT ok ORDER BY ts DESC, id DESC LIMIT 50", "audit"))
def g24_recent_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.audit(spark, sf_dir).where("not ok").orderBy(F.desc("ts"), F.desc("id")).limit(50).select("id", "ts", "action", "status")


@query(oracle("SELECT action, round(avg(CASE WHEN result_count > 0 THEN 1.0 ELSE 0.0 END), 6) AS helpful_rate FROM audit GROUP BY action", "audit"))
def g25_helpful_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.audit(spark, sf_dir).groupBy("action").agg(F.round(F.avg((F.col("result_count") > 0).cast("double")), 6).alias("helpful_rate"))
