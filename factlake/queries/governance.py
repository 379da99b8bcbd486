"""Queries over namespaces, grants, subscriptions and the entity graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.operators import governance as op
from factlake.operators import graph
from factlake.plans import adapters as t
from factlake.plans.adapters import oracle
from factlake.registry import query
from factlake.sources.shared import spread

# grants and roles derived from customers: a principal for each customer, a role for each nation
_GRANTS = """SELECT c_custkey AS principal_id, CASE c_custkey % 4 WHEN 0 THEN 'src:src' || (c_custkey % 20) || ':*' WHEN 1 THEN 'src:src' || (c_custkey % 20) || ':en' WHEN 2 THEN 'src:*' ELSE '*' END AS namespace,
  c_custkey % 5 <> 0 AS can_read, c_custkey % 7 = 0 AS can_write FROM customer"""
_MEMBERS = "SELECT c_nationkey AS role_id, c_custkey AS principal_id FROM customer"
_ROLE_GRANTS = "SELECT n_nationkey AS role_id, 'src:src' || (n_nationkey % 20) || ':de' AS namespace, true AS can_read, n_nationkey % 2 = 0 AS can_write FROM nation"
_REGISTRY = "SELECT DISTINCT 'src:' || source || ':' || lang AS namespace FROM documents"


def _sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    for name in ("customer", "nation", "documents", "supplier", "part", "events"):
        t.table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(text)


_COVER = """cover AS (SELECT namespace, namespace AS g FROM reg UNION SELECT namespace, 'src:' || split_part(namespace, ':', 2) || ':*' FROM reg UNION SELECT namespace, 'src:*' FROM reg UNION SELECT namespace, '*' FROM reg)"""


@query(f"WITH g AS ({_GRANTS}), m AS ({_MEMBERS}), r AS ({_ROLE_GRANTS}) SELECT principal_id, namespace, bool_or(can_read) AS can_read, bool_or(can_write) AS can_write FROM (SELECT * FROM g UNION ALL SELECT principal_id, namespace, can_read, can_write FROM m JOIN r USING (role_id)) GROUP BY ALL")
def g11_effective_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.effective_grants(_sql(spark, sf_dir, _GRANTS), _sql(spark, sf_dir, _MEMBERS), _sql(spark, sf_dir, _ROLE_GRANTS))


@query(f"WITH g AS ({_GRANTS}), reg AS ({_REGISTRY}), {_COVER} SELECT principal_id, c.namespace, bool_or(can_write) AS can_write FROM g JOIN cover c ON g.namespace = c.g WHERE can_read GROUP BY ALL")
def g12_readable_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.readable_namespaces(_sql(spark, sf_dir, _GRANTS), _sql(spark, sf_dir, _REGISTRY))


@query(f"WITH g AS ({_GRANTS}) SELECT principal_id FROM g WHERE namespace = '*' AND can_write")
def g13_admins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.admins(_sql(spark, sf_dir, _GRANTS))


@query(
    f"""WITH g AS ({_GRANTS}), q AS (SELECT doc_id AS request_id, doc_id % 150 AS principal_id, 'src:' || source || ':' || lang AS namespace FROM documents)
SELECT request_id, principal_id, namespace FROM q WHERE EXISTS (SELECT 1 FROM g WHERE g.principal_id = q.principal_id AND can_read AND
  (g.namespace = q.namespace OR g.namespace = '*' OR (ends_with(g.namespace, ':*') AND starts_with(q.namespace, left(g.namespace, -1)))))"""
)
def b9_authorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = _sql(spark, sf_dir, "SELECT doc_id AS request_id, doc_id % 150 AS principal_id, 'src:' || source || ':' || lang AS namespace FROM documents")
    return op.authorize(requests, _sql(spark, sf_dir, _GRANTS))


@query(
    f"""WITH reg AS ({_REGISTRY}), f AS (SELECT namespace, NOT ends_with(namespace, 'fr') AS inherit FROM reg WHERE NOT ends_with(namespace, 'es'))
SELECT namespace, unnest(['src:' || split_part(namespace, ':', 2), 'src']) AS ancestor, unnest([1, 2]) AS depth FROM reg LEFT JOIN f USING (namespace) WHERE coalesce(inherit, true)"""
)
def b7_effective_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _sql(spark, sf_dir, _REGISTRY)
    flags = names.where("namespace not like '%es'").selectExpr("namespace", "namespace not like '%fr' as inherit_ancestors")
    return op.effective_ancestors(names, flags)


_BINDINGS = """SELECT c_custkey % 50 AS principal_id, CASE c_custkey % 3 WHEN 0 THEN 'repo' WHEN 1 THEN 'host_repo' ELSE 'host_path' END AS key_type,
  CASE c_custkey % 3 WHEN 0 THEN 'r' || (c_custkey % 4) WHEN 1 THEN 'h1|r' || (c_custkey % 4) ELSE 'h1|/p' || (c_custkey % 2) END AS key, 'ns' || c_custkey AS namespace, c_custkey AS bound_at FROM customer"""


@query(
    f"""WITH b AS ({_BINDINGS}), q AS (SELECT event_id AS request_id, event_id % 60 AS principal_id, 'r' || (event_id % 5) AS repo, 'h' || (event_id % 2) AS host, '/p' || (event_id % 3) AS path FROM events),
k AS (SELECT *, 'repo' AS key_type, repo AS key, 1 AS priority FROM q UNION ALL SELECT *, 'host_repo', host || '|' || repo, 2 FROM q UNION ALL SELECT *, 'host_path', host || '|' || path, 3 FROM q)
SELECT request_id, namespace, key_type FROM k JOIN b USING (principal_id, key_type, key) QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY priority, bound_at DESC, namespace DESC) = 1"""
)
def b10_resolve_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _sql(spark, sf_dir, "SELECT event_id AS request_id, event_id % 60 AS principal_id, 'r' || (event_id % 5) AS repo, 'h' || (event_id % 2) AS host, '/p' || (event_id % 3) AS path FROM events")
    return op.resolve_bindings(q, _sql(spark, sf_dir, _BINDINGS))


@query(
    f"""WITH g AS ({_GRANTS}), l AS (SELECT DISTINCT c_custkey AS principal_id, 'src' AS src_ns, 'src:src' || (c_nationkey % 20) || ':en' AS dst_ns FROM customer)
SELECT principal_id, src_ns, dst_ns, CASE WHEN EXISTS (SELECT 1 FROM g WHERE g.principal_id = l.principal_id AND can_read AND
  (g.namespace = dst_ns OR g.namespace = '*' OR (ends_with(g.namespace, ':*') AND starts_with(dst_ns, left(g.namespace, -1))))) THEN 'used' ELSE 'skipped' END AS state FROM l"""
)
def j9_grounded_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _sql(spark, sf_dir, "SELECT DISTINCT c_custkey AS principal_id, 'src' AS src_ns, 'src:src' || (c_nationkey % 20) || ':en' AS dst_ns FROM customer")
    return op.grounded_namespaces(links, _sql(spark, sf_dir, _GRANTS))


_PINS = "SELECT c_custkey AS pin_id, CASE c_custkey % 3 WHEN 0 THEN 'org' WHEN 1 THEN 'org:t' || (c_custkey % 5) ELSE 'org:t' || (c_custkey % 5) || ':x' END AS namespace, 'Rule' || (c_custkey % 11) AS subject FROM customer"


@query(
    f"""WITH p AS ({_PINS}), n AS (SELECT DISTINCT lower(subject) AS s, namespace FROM p), pr AS (SELECT c.s, c.namespace AS child, q.namespace AS parent FROM n c JOIN n q ON c.s = q.s AND starts_with(c.namespace, q.namespace || ':')),
w AS (SELECT s, CASE WHEN child = 'org:t1' AND parent = 'org' THEN parent ELSE child END AS loser, CASE WHEN child = 'org:t1' AND parent = 'org' THEN child ELSE parent END AS winner FROM pr),
b AS (SELECT s, loser AS namespace, arg_min(winner, (length(winner), winner)) AS beaten_by FROM w GROUP BY ALL),
c AS (SELECT s, count(beaten_by) < count(*) AS ok FROM n LEFT JOIN b USING (s, namespace) GROUP BY s)
SELECT pin_id, p.namespace, subject, CASE WHEN ok THEN beaten_by END AS beaten_by FROM p LEFT JOIN b ON b.s = lower(subject) AND b.namespace = p.namespace LEFT JOIN c ON c.s = lower(subject)"""
)
def j12_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    overrides = spark.createDataFrame([("org:t1", "org")], "child_namespace string, parent_namespace string")
    return op.resolve_precedence(_sql(spark, sf_dir, _PINS), overrides).select("pin_id", "namespace", "subject", "beaten_by")


_SUBS = """SELECT DISTINCT 'team:' || (user_id % 4) AS namespace, 'session_' || (user_id % 20) AS session_name, CASE user_id % 3 WHEN 0 THEN '#' || event_type WHEN 1 THEN '#' || substr(event_type, 1, 1) || '*' ELSE '*' END AS channel,
  CAST(5000 + user_id % 10 * 100 AS BIGINT) AS cursor FROM events"""
_MATCH = f""", s AS ({_SUBS}), x AS (SELECT m.namespace, s.session_name, s.channel, m.id, m.channel AS message_channel, m.sender_session FROM messages m JOIN s ON m.namespace = s.namespace
  AND (s.channel = m.channel OR (ends_with(s.channel, '*') AND starts_with(m.channel, left(s.channel, -1)))) WHERE m.recalled_at IS NULL AND m.id > s.cursor AND m.sender_session <> s.session_name)
"""


@query(oracle(_MATCH + "SELECT session_name, channel, count(*) AS n, count(DISTINCT id) AS messages FROM x GROUP BY ALL", "messages"))
def j10_match_subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op.match_subscriptions(_sql(spark, sf_dir, _SUBS), t.messages(spark, sf_dir))
    return found.groupBy("session_name", "channel").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("messages"))


@query(oracle(_MATCH + "SELECT namespace, session_name, id, count(*) AS matches FROM x GROUP BY ALL", "messages"))
def h3_poll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.poll(_sql(spark, sf_dir, _SUBS), t.messages(spark, sf_dir))


@query(oracle(_MATCH + "SELECT namespace, session_name, count(DISTINCT id) AS unread, list_sort(list(DISTINCT message_channel)) AS channels FROM x GROUP BY ALL", "messages"))
def g26_unread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.unread(_sql(spark, sf_dir, _SUBS), t.messages(spark, sf_dir))


_CALLS = """SELECT event_id AS call_id, CASE event_id % 5 WHEN 0 THEN 'run_command' WHEN 1 THEN 'Edit' WHEN 2 THEN 'Read' ELSE 'Bash' END AS tool,
  CASE event_id % 11 WHEN 0 THEN 'rm -rf ' || user_id WHEN 1 THEN 'rm a\nrm b' WHEN 2 THEN 'git push' WHEN 3 THEN 'cd x\ngit  push origin' WHEN 4 THEN 'cat [x]' WHEN 5 THEN 'npm test' WHEN 6 THEN 'npm zest' WHEN 7 THEN 'a.b' WHEN 8 THEN 'axb' ELSE 'ls' || user_id END AS input FROM events"""
_RULES = [
    (1, "Bash(*push*)", "ask"), (2, "Bash(rm *)", "block"), (3, "Edit", "ask"), (4, "R?ad(ls??)", "ask"), (5, "[!BER]*(ls[0-4]*)", "ask"), (6, "*(cat [[]x])", "block"), (7, "Bash(npm [a-t]est)", "ask"), (8, "Bash(a.b)", "block"), (9, "B*", "ask"),
    (10, "Read(axb)", "ask"), (11, "Read(axb)", "block"),
]
_REGEXES = {1: r"Bash\(.*push.*\)", 2: r"Bash\(rm .*\)", 3: "Edit", 4: r"R.ad\(ls..\)", 5: r"[^BER].*\(ls[0-4].*\)", 6: r".*\(cat \[x\]\)", 7: r"Bash\(npm [a-t]est\)", 8: r"Bash\(a\.b\)", 9: "B.*", 10: r"Read\(axb\)", 11: r"Read\(axb\)"}


@query(
    f"""WITH c AS ({_CALLS}), s AS (SELECT call_id, unnest(CASE WHEN tool = 'run_command' THEN [tool, tool || '(' || input || ')', 'Bash', 'Bash(' || input || ')'] ELSE [tool, tool || '(' || input || ')'] END) AS subject FROM c),
r(rule_no, regex, level) AS (VALUES {', '.join(f"({n}, '(?s){_REGEXES[n]}', '{level}')" for n, _, level in _RULES)})
SELECT call_id, CASE WHEN bool_or(level = 'block') THEN 'block' ELSE 'ask' END AS level, coalesce(min(rule_no) FILTER (WHERE level = 'block'), min(rule_no)) AS rule_no FROM s JOIN r ON regexp_full_match(subject, regex) GROUP BY call_id"""
)
def j19_enforcement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands of several lines, and rules with every kind of wildcard."""
    rules = spark.createDataFrame(_RULES, "rule_no int, pattern string, level string")
    return op.match_enforcement(_sql(spark, sf_dir, _CALLS), rules)


@query(
    """WITH tk AS (SELECT DISTINCT event_id AS write_id, 'team:' || (user_id % 4) AS namespace, unnest([event_type, 'u' || (user_id % 63), 'k' || (event_id % 5)]) AS token FROM events),
k AS (SELECT DISTINCT 'team:' || (user_id % 7) AS namespace, unnest([event_type, 'u' || (user_id % 63)]) AS token FROM events),
n AS (SELECT write_id, count(DISTINCT token) AS n FROM tk GROUP BY ALL), s AS (SELECT write_id, tk.namespace AS own, k.namespace, count(*) AS hits FROM tk JOIN k USING (token) GROUP BY ALL),
o AS (SELECT write_id, hits AS own_hits FROM s WHERE namespace = own)
SELECT write_id, namespace, hits, n, coalesce(own_hits, 0) AS own_hits, CAST(row_number() OVER (PARTITION BY write_id ORDER BY hits DESC, namespace) AS INTEGER) AS rank
FROM s JOIN n USING (write_id) LEFT JOIN o USING (write_id) WHERE namespace <> own AND n >= 2 AND hits >= 0.6 * n AND hits > coalesce(own_hits, 0) QUALIFY rank <= 12"""
)
def g19_suggest_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = t.table(spark, sf_dir, "events")
    tokens = events.selectExpr("event_id as write_id", "concat('team:', user_id % 4) as namespace", "explode(array(event_type, concat('u', user_id % 63), concat('k', event_id % 5))) as token")
    known = events.selectExpr("concat('team:', user_id % 7) as namespace", "explode(array(event_type, concat('u', user_id % 63))) as token")
    return op.suggest_namespace(tokens, known)


_BOTH = ", b AS (SELECT src AS node, dst AS other, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges)\n"


@query(oracle(_BOTH + ", d AS (SELECT 'p' || p_partkey AS name FROM part UNION SELECT 's' || s_suppkey FROM supplier UNION SELECT 'x1'), g AS (SELECT node, count(*) AS degree FROM b GROUP BY node) SELECT count(*) AS entities, count(*) FILTER (WHERE degree IS NULL) AS orphans, count(*) FILTER (WHERE degree = 1) AS leaves FROM d LEFT JOIN g ON node = name", "edges"))
def n8_degree_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _sql(spark, sf_dir, "SELECT 'p' || p_partkey AS name FROM part UNION SELECT 's' || s_suppkey FROM supplier UNION SELECT 'x1'")
    return graph.degree_stats(names, t.edges(spark, sf_dir))


@query(oracle(", d AS (SELECT 'p' || p_partkey AS name FROM part UNION SELECT 's' || s_suppkey FROM supplier UNION SELECT 'x1') SELECT name FROM d WHERE name NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)", "edges"))
def j7_orphan_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.orphan_entities(_sql(spark, sf_dir, "SELECT 'p' || p_partkey AS name FROM part UNION SELECT 's' || s_suppkey FROM supplier UNION SELECT 'x1'"), t.edges(spark, sf_dir))


@query(oracle(_BOTH + "SELECT node, other, weight, CAST(row_number() OVER (PARTITION BY node ORDER BY weight DESC, other) AS INTEGER) AS rank FROM b WHERE node LIKE 's%' QUALIFY rank <= 5", "edges"))
def n4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbours(_sql(spark, sf_dir, "SELECT 's' || s_suppkey AS node FROM supplier"), t.edges(spark, sf_dir), 5)


@query(
    oracle(
        _BOTH
        + """, s AS (SELECT 'p' || p_partkey AS seed FROM part WHERE p_partkey % 50 = 1), h1 AS (SELECT DISTINCT seed, other AS node FROM s JOIN b ON node = seed), h2 AS (SELECT DISTINCT seed, other AS node FROM h1 JOIN b USING (node))
SELECT seed, seed AS node, 0 AS hop FROM s UNION ALL SELECT seed, node, 1 FROM h1 WHERE node <> seed UNION ALL SELECT seed, node, 2 FROM h2 WHERE node <> seed AND (seed, node) NOT IN (SELECT (seed, node) FROM h1)""",
        "edges",
    )
)
def n2_graph_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.expand(_sql(spark, sf_dir, "SELECT 'p' || p_partkey AS node FROM part WHERE p_partkey % 50 = 1"), t.edges(spark, sf_dir), 2)


_ORDERED = "SELECT 'p' || l_partkey AS src, 'o' || l_orderkey AS dst, CAST(count(*) AS DOUBLE) AS weight FROM lineitem GROUP BY l_partkey, l_orderkey"


@query(
    f"""WITH e AS ({_ORDERED}), b AS (SELECT src AS node, dst AS other, weight FROM e UNION ALL SELECT dst, src, weight FROM e), s AS (SELECT 'p' || p_partkey AS seed FROM part WHERE p_partkey % 100 = 0), g AS (SELECT node, count(*) AS degree FROM b GROUP BY node),
f AS (SELECT seed, other AS node, max(weight) AS weight FROM s JOIN b ON node = seed GROUP BY ALL),
p AS (SELECT seed, node FROM f JOIN g USING (node) WHERE degree <= 100 QUALIFY row_number() OVER (PARTITION BY seed ORDER BY weight DESC, node) <= 50),
h AS (SELECT seed, other AS node, max(weight) AS weight FROM p JOIN b USING (node) WHERE other <> seed GROUP BY ALL),
u AS (SELECT *, 1 AS hop FROM f UNION ALL SELECT *, 2 FROM h WHERE (seed, node) NOT IN (SELECT (seed, node) FROM f))
SELECT seed, node, weight, hop, CAST(row_number() OVER (PARTITION BY seed ORDER BY hop, weight DESC, node) AS INTEGER) AS rank FROM u QUALIFY rank <= 200"""
)
def n5_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and orders as a graph, whose degrees suit the default bounds; one part in a hundred asks."""
    seeds = _sql(spark, sf_dir, "SELECT 'p' || p_partkey AS node FROM part WHERE p_partkey % 100 = 0")
    lines = t.table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey")
    spread(lines, lines.count(), "l_partkey", "l_orderkey").createOrReplaceTempView("lineitem")
    return graph.neighbourhood(seeds, spark.sql(_ORDERED), 200)


@query(
    """WITH e AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 17 = 0 THEN 'true' WHEN p_partkey % 5 = 0 THEN upper(p_name) ELSE p_name END AS name FROM part),
m AS (SELECT id, min(id) OVER (PARTITION BY lower(name)) AS t FROM e WHERE lower(name) NOT IN ('true')),
x AS (SELECT a.t AS s, b.t AS d FROM lineitem JOIN m a ON a.id = l_partkey JOIN m b ON b.id = (l_partkey + l_suppkey) % 200)
SELECT least(s, d) AS src, greatest(s, d) AS dst, CAST(count(*) AS DOUBLE) AS weight FROM x WHERE s <> d GROUP BY ALL"""
)
def n6_clean_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = t.table(spark, sf_dir, "part").selectExpr("p_partkey as id", "case when p_partkey % 17 = 0 then 'true' when p_partkey % 5 = 0 then upper(p_name) else p_name end as name")
    edges = t.table(spark, sf_dir, "lineitem").selectExpr("l_partkey as src", "(l_partkey + l_suppkey) % 200 as dst", "1.0d as weight")
    return graph.clean_graph(entities, edges, ~F.lower("name").isin("true", "false", "null"), F.col("name"))[1]


@query(oracle(", m AS (SELECT DISTINCT l_orderkey AS episode, l_suppkey AS entity FROM lineitem) SELECT a.entity AS src, b.entity AS dst, CAST(count(*) AS DOUBLE) AS weight FROM m a JOIN m b ON a.episode = b.episode AND a.entity < b.entity GROUP BY ALL", "edges"))
def n1_comention_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.comention_edges(t.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as episode", "l_suppkey as entity"))


@query("SELECT lower(p_name) AS key, min(p_partkey) AS id, arg_min(p_name, p_partkey) AS name, arg_min(p_retailprice, p_partkey) FILTER (WHERE p_partkey % 3 = 0) AS embedding FROM part GROUP BY lower(p_name)")
def n7_upsert_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.table(spark, sf_dir, "part").selectExpr("p_partkey as id", "p_name as name", "case when p_partkey % 3 = 0 then p_retailprice end as embedding")
    return graph.upsert_entities(rows.where("id < 100"), rows.where("id >= 100"))
