"""Driver tables as engine tables, and the same derivations as DuckDB CTEs for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factlake.sources.shared import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns: one namespace in four, a session for each conversation, a turn a minute."""
    return table(spark, sf_dir, "conversations").selectExpr(
        "conv_id * 10000 + turn as id", "concat('team:', conv_id % 4) as namespace", "cast(conv_id as string) as session_id", "role as speaker", "text",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(conv_id as int), cast(turn as int), 0) as observed_at",
        "case when conv_id % 3 = 0 then 'constraint' when turn % 5 = 0 then 'decision' else 'fact' end as memory_type",
        "concat('author_', conv_id % 5) as author",
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact for each event: a user's measured value by event type; some unknown, some in the past."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id as id", "concat('team:', user_id % 4) as namespace", "concat('user_', user_id) as subject", "event_type as predicate",
        "case when event_id % 7 = 0 then 'unknown' else concat(cast(floor(value) as bigint) % 3, ' units') end as object",
        "concat(case when event_id % 11 = 0 then 'Formerly user_' else 'user_' end, user_id, ' ', event_type, ' is ', case when event_id % 7 = 0 then 'unknown' else concat(cast(floor(value) as bigint) % 3, ' units') end) as statement",
        "ts as observed_at", "ts as valid_from", "ts as created_at",
        "case when event_id % 13 = 0 then ts end as expired_at", "array(event_id, event_id + 1) as source_turn_ids",
        "case when event_id % 4 = 0 then 'assistant' else 'user' end as source_speaker",
    )


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order status as facts: subject customer, predicate status."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as id", "concat('region:', o_custkey % 5) as namespace", "concat('cust_', o_custkey) as subject", "'status' as predicate", "o_orderstatus as object",
        "concat('cust_', o_custkey, ' status is ', o_orderstatus) as statement", "o_orderdate as observed_at", "o_orderdate as valid_from",
    )


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as an audited call: its type is the action, its value the latency."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id as id", "ts", "user_id as principal_id", "event_type as action", "concat('team:', user_id % 4) as namespace", "event_id % 9 <> 0 as ok",
        "case when event_id % 9 = 0 then case when event_id % 2 = 0 then 403 else 500 end else 200 end as status", "cast(floor(value) as int) as latency_ms", "cast(event_id % 3 as int) as result_count",
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as metered calls."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_shipdate as ts", "l_suppkey as principal_id", "concat('team:', l_suppkey % 4) as namespace", "l_returnflag as op", "concat('model-', l_linestatus) as model",
        "cast(l_quantity as int) as tokens_in", "cast(l_linenumber as int) as tokens_out", "cast(l_extendedprice as decimal(12,2)) as cost_usd",
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as channel messages: one channel for each event type."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id as id", "concat('team:', user_id % 4) as namespace", "concat('#', event_type) as channel", "concat('session_', user_id % 20) as sender_session", "ts as created_at",
        "case when event_id % 17 = 0 then ts end as recalled_at",
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id as id", "concat('label:', label) as namespace", "embedding")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part and supplier as an undirected graph; the weight counts line items."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    return spread(lines, lines.count(), "l_partkey", "l_suppkey").groupBy("l_partkey", "l_suppkey").count().selectExpr("concat('p', l_partkey) as src", "concat('s', l_suppkey) as dst", "cast(count as double) as weight")


#: The same tables in DuckDB.
CTES = {
    "turns": """turns AS (SELECT conv_id * 10000 + turn AS id, 'team:' || conv_id % 4 AS namespace, CAST(conv_id AS VARCHAR) AS session_id, role AS speaker, text,
      TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id) + to_minutes(turn) AS observed_at,
      CASE WHEN conv_id % 3 = 0 THEN 'constraint' WHEN turn % 5 = 0 THEN 'decision' ELSE 'fact' END AS memory_type, 'author_' || conv_id % 5 AS author FROM conversations)""",
    "facts": """facts AS (SELECT event_id AS id, 'team:' || user_id % 4 AS namespace, 'user_' || user_id AS subject, event_type AS predicate,
      CASE WHEN event_id % 7 = 0 THEN 'unknown' ELSE (CAST(floor(value) AS BIGINT) % 3) || ' units' END AS object,
      (CASE WHEN event_id % 11 = 0 THEN 'Formerly user_' ELSE 'user_' END) || user_id || ' ' || event_type || ' is ' || (CASE WHEN event_id % 7 = 0 THEN 'unknown' ELSE (CAST(floor(value) AS BIGINT) % 3) || ' units' END) AS statement,
      ts AS observed_at, ts AS valid_from, ts AS created_at, CASE WHEN event_id % 13 = 0 THEN ts END AS expired_at, [event_id, event_id + 1] AS source_turn_ids,
      CASE WHEN event_id % 4 = 0 THEN 'assistant' ELSE 'user' END AS source_speaker FROM events)""",
    "states": """states AS (SELECT o_orderkey AS id, 'region:' || o_custkey % 5 AS namespace, 'cust_' || o_custkey AS subject, 'status' AS predicate, o_orderstatus AS object,
      'cust_' || o_custkey || ' status is ' || o_orderstatus AS statement, o_orderdate AS observed_at, o_orderdate AS valid_from FROM orders)""",
    "audit": """audit AS (SELECT event_id AS id, ts, user_id AS principal_id, event_type AS action, 'team:' || user_id % 4 AS namespace, event_id % 9 <> 0 AS ok,
      CASE WHEN event_id % 9 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 403 ELSE 500 END ELSE 200 END AS status, CAST(floor(value) AS INTEGER) AS latency_ms, CAST(event_id % 3 AS INTEGER) AS result_count FROM events)""",
    "usage": """usage AS (SELECT l_shipdate AS ts, l_suppkey AS principal_id, 'team:' || l_suppkey % 4 AS namespace, l_returnflag AS op, 'model-' || l_linestatus AS model,
      CAST(l_quantity AS INTEGER) AS tokens_in, CAST(l_linenumber AS INTEGER) AS tokens_out, CAST(l_extendedprice AS DECIMAL(12,2)) AS cost_usd FROM lineitem)""",
    "messages": """messages AS (SELECT event_id AS id, 'team:' || user_id % 4 AS namespace, '#' || event_type AS channel, 'session_' || user_id % 20 AS sender_session, ts AS created_at,
      CASE WHEN event_id % 17 = 0 THEN ts END AS recalled_at FROM events)""",
    "vectors": """vectors AS (SELECT vec_id AS id, 'label:' || label AS namespace, embedding FROM embeddings)""",
    "edges": """edges AS (SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst, CAST(count(*) AS DOUBLE) AS weight FROM lineitem GROUP BY l_partkey, l_suppkey)""",
}


def oracle(body: str, *tables: str, recursive: bool = False) -> str:
    """``body`` after the CTEs of ``tables``. A body that begins with a comma adds CTEs of its own."""
    head = ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(CTES[t] for t in tables)
    return head + "\n" + body
