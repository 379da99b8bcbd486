"""Queries over the movement and derivation of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.plans import adapters as t
from factlake.plans.adapters import oracle
from factlake.registry import query
from factlake.sources import tables as op


@query(oracle(", x AS (SELECT 'team:1' AS namespace, 'pinned' AS kind UNION ALL SELECT 'team:9', 'spare'), s AS (SELECT namespace FROM turns UNION SELECT namespace FROM facts) SELECT namespace, coalesce(kind, 'default') AS kind, kind IS NULL AS auto_registered FROM s FULL JOIN x USING (namespace)", "turns", "facts"))
def a2_namespace_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    explicit = spark.createDataFrame([("team:1", "pinned"), ("team:9", "spare")], "namespace string, kind string")
    return op.namespace_registry([t.turns(spark, sf_dir), t.facts(spark, sf_dir)], explicit)


@query(oracle("SELECT id, speaker FROM turns WHERE namespace = 'team:1' AND memory_type = 'decision' ORDER BY id LIMIT 25", "turns"))
def a3_turns_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.turns_by_type(t.turns(spark, sf_dir), "team:1", "decision", 25).select("id", "speaker")


@query(oracle("SELECT id, namespace FROM turns WHERE memory_type = 'fact' ORDER BY id DESC LIMIT 40 OFFSET 20", "turns"))
def a4_memory_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.memory_feed(t.turns(spark, sf_dir), 40, 20, memory_type="fact").select("id", "namespace")


@query("SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS n, TIMESTAMP '2024-03-01 00:00:00' + to_days(CAST(conv_id % 28 AS INTEGER)) + to_minutes(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS observed_at, text FROM conversations")
def a5_ingest_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x.text)
    sessions = t.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(texts.alias("texts"))
    sessions = sessions.selectExpr("cast(conv_id as string) as session_id", "timestamp_ntz'2024-03-01 00:00:00' + make_dt_interval(cast(conv_id % 28 as int)) as session_date", "texts")
    return op.ingest_sessions(sessions).select("session_id", "n", "observed_at", "text")


@query()
def a7_chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t.table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"\.\n", ".\n\n").alias("text"))
    return op.chunk_text(docs).select("doc_id", "chunk", F.length("text").alias("n"))


@query()
def a6_ingest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.ingest_documents(t.table(spark, sf_dir, "documents")).select("doc_id", "chunk", F.length("text").alias("n"))


@query(oracle("SELECT namespace, count(*) AS n, count(DISTINCT id) AS ids FROM (SELECT namespace, id FROM turns UNION ALL SELECT 'copy', -id - 1 FROM turns WHERE namespace = 'team:2' AND contains(lower(text), 'the')) GROUP BY namespace", "turns"))
def a18_copy_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    copied = op.copy_namespace(t.turns(spark, sf_dir), "team:2", "copy", "THE")
    return copied.groupBy("namespace").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"))


@query(oracle("SELECT CASE WHEN namespace = 'team:2' THEN 'team:3' ELSE namespace END AS namespace, count(*) AS n FROM turns WHERE namespace <> 'team:0' GROUP BY 1", "turns"))
def a19_move_and_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = op.purge_namespace(op.move_namespace(t.turns(spark, sf_dir), "team:2", "team:3"), "team:0")
    return moved.groupBy("namespace").agg(F.count(F.lit(1)).alias("n"))


@query(oracle("SELECT least(lower(subject), lower(object)) AS src, greatest(lower(subject), lower(object)) AS dst, CAST(count(*) AS DOUBLE) AS weight FROM facts GROUP BY 1, 2", "facts"))
def a20_rebuild_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.rebuild_graph(t.facts(spark, sf_dir))[1]


@query("SELECT c.conv_id AS transcript, arg_max(text, turn) FILTER (WHERE role = 'user' AND trim(text) <> '') AS user_text, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE role = 'assistant' AND turn > l.last AND trim(text) <> ''), '') AS reply FROM conversations c JOIN (SELECT conv_id, max(turn) AS last FROM conversations WHERE role = 'user' AND trim(text) <> '' GROUP BY conv_id) l USING (conv_id) GROUP BY c.conv_id")
def a27_last_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.last_exchange(t.table(spark, sf_dir, "conversations").selectExpr("conv_id as transcript", "turn as n", "role", "text"))


@query("SELECT event_type AS kind, CAST(user_id % 6 AS VARCHAR) AS name, count(*) AS uses FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY ALL")
def a16_tool_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = t.table(spark, sf_dir, "events").selectExpr("ts", "event_type as kind", "cast(user_id % 6 as string) as name")
    return op.tool_usage(events, F.expr("timestamp_ntz'2024-01-10 00:00:00'"))


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus FROM orders GROUP BY o_custkey")
def s10_latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return op.latest_per_key(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(oracle("SELECT id, observed_at FROM facts WHERE (observed_at, id) < (TIMESTAMP '2024-01-20 00:00:00', 999999) ORDER BY observed_at DESC, id DESC LIMIT 100", "facts"))
def s4_keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = (F.expr("timestamp_ntz'2024-01-20 00:00:00'"), F.lit(999999))
    return op.keyset_page(t.facts(spark, sf_dir), before, 100).select("id", "observed_at")


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END, o_orderkey LIMIT 500")
def s6_priority_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).when(F.col("o_orderpriority") == "3-MEDIUM", 2).otherwise(3)
    return t.table(spark, sf_dir, "orders").orderBy(rank, "o_orderkey").limit(500).select("o_orderkey", "o_orderpriority")


@query("SELECT p_brand, CAST(sum(p_size) FILTER (WHERE p_partkey % 2 = 0) AS BIGINT) AS w FROM part GROUP BY p_brand ORDER BY w DESC NULLS LAST, p_brand LIMIT 10")
def s7_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = t.table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sum(F.when(F.col("p_partkey") % 2 == 0, F.col("p_size"))).alias("w"))
    return sums.orderBy(F.desc_nulls_last("w"), "p_brand").limit(10)


@query("SELECT n_name AS name FROM nation WHERE n_nationkey % 2 = 0 UNION SELECT r_name FROM region UNION SELECT c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def s8_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    idle = t.table(spark, sf_dir, "customer").join(t.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
    names = t.table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").selectExpr("n_name as name")
    return names.union(t.table(spark, sf_dir, "region").select("r_name")).union(idle.select("c_mktsegment")).distinct()


@query()
def a24_hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.hash_embed(t.table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "text")).select("conv_id", "turn", F.size("embedding").alias("dim"))
