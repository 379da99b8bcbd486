"""Queries that apply the text rules to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.functions import predicates as p
from factlake.functions import text as x
from factlake.plans import adapters as t
from factlake.plans.adapters import oracle
from factlake.registry import query

_SQL_LIST = lambda words: ", ".join(f"'{w}'" for w in words)


@query(
    f"""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '[A-Z][a-zA-Z]{{2,}}') AND x NOT IN ({_SQL_LIST(x.ENTITY_STOP)}))) AS name FROM documents)
SELECT lower(name) AS entity, count(DISTINCT doc_id) AS n_docs FROM w GROUP BY lower(name)"""
)
def f1_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = t.table(spark, sf_dir, "documents").select("doc_id", F.explode(x.extract_entities(F.col("text"))).alias("name"))
    return found.groupBy(F.lower("name").alias("entity")).agg(F.count(F.lit(1)).alias("n_docs"))


@query(
    f"""SELECT doc_id, round(1.0 / (1.0 + exp(-(0.4 * len(list_distinct(list_transform(list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '[A-Z][a-zA-Z]{{2,}}') AND x NOT IN ({_SQL_LIST(x.ENTITY_STOP)})), lambda x: lower(x))))
  + 0.002 * length(text) - 1.2))), 6) AS salience FROM documents"""
)
def f5_salience(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.round(x.salience(F.col("text"), F.size(x.extract_entities(F.col("text")))), 6).alias("salience"))


def _redact_sql() -> tuple[str, str]:
    text, n = "text", "0"
    for label, pattern in x.SECRET_PATTERNS:
        q = pattern.replace("'", "''")
        n += f" + len(regexp_extract_all({text}, '{q}'))"
        text = f"regexp_replace({text}, '{q}', '{chr(92) + '1' if label == 'credential' else ''}[REDACTED:{label}]', 'g')"
    return text, n


@query(f"SELECT doc_id, md5({_redact_sql()[0]}) AS clean_md5, CAST({_redact_sql()[1]} AS INTEGER) AS n_redacted FROM documents")
def f6_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(x.redact(F.col("text")).cast("binary")).alias("clean_md5"), x.count_secrets(F.col("text")).alias("n_redacted"))


@query(
    """WITH c AS (SELECT page_id, url, unnest(string_split(url, '')) AS ch FROM pages), n AS (SELECT page_id, ch, count(*) AS k, length(url) AS l FROM c GROUP BY page_id, url, ch)
SELECT page_id, round(-sum(k / l * log2(k / l)), 6) AS entropy FROM n GROUP BY page_id"""
)
def f8_shannon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "pages").select("page_id", F.round(x.shannon(F.col("url")), 6).alias("entropy"))


_PRED = "CASE c_custkey % 8 WHEN 0 THEN 'lives_in' WHEN 1 THEN 'visited' WHEN 2 THEN 'rate_limit' WHEN 3 THEN 'operates_in' WHEN 4 THEN 'uses' WHEN 5 THEN 'causes' WHEN 6 THEN 'ran' ELSE 'Count_Of' END"
_OBJ = "CASE c_custkey % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN '~ $' || CAST(c_nationkey AS VARCHAR) || ',000 per day' ELSE CAST(c_nationkey AS VARCHAR) || '%' END"


@query(
    f"""WITH s AS (SELECT c_custkey, {_PRED} AS predicate, {_OBJ} AS object FROM customer)
SELECT c_custkey, predicate IN ('lives_in', 'rate_limit', 'uses', 'Count_Of') AS single,
  predicate IN ('lives_in', 'rate_limit', 'uses', 'Count_Of') OR (predicate <> 'visited' AND c_custkey % 3 > 0) AS supersedable FROM s"""
)
def f10_supersedable(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_PRED.replace('VARCHAR', 'STRING')} as predicate", f"{_OBJ.replace('VARCHAR', 'STRING')} as object")
    return rows.select("c_custkey", p.is_single_valued(F.col("predicate")).alias("single"), p.supersedable(F.col("predicate"), F.col("object")).alias("supersedable"))


_SAYS = """CASE o_orderkey % 9 WHEN 0 THEN 'Alice lived in Boston' WHEN 1 THEN 'The branch was merged' WHEN 2 THEN 'It was slow in 2019' WHEN 3 THEN 'The limit was changed to 200 years ago'
  WHEN 4 THEN 'PR #2024 was closed' WHEN 5 THEN 'We were students back then' WHEN 6 THEN 'Order status is no longer open' WHEN 7 THEN 'It was fixed on March 3, 2021' ELSE 'Bob moved to Seattle' END"""


@query(
    f"""SELECT o_orderkey, o_orderkey % 9 IN (0, 2, 5, 7) AS historical, o_orderkey % 9 = 6 AS reversal,
  array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower({_SAYS}), '[a-z0-9][a-z0-9_-]{{3,}}'), lambda w: w NOT IN ({_SQL_LIST(p.SALIENT_STOP)})))), ',') AS salient FROM orders"""
)
def f11_statement_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_SAYS} as s")
    return rows.select(
        "o_orderkey", p.is_historical(F.col("s")).alias("historical"), p.reversal_cue(F.col("s")).alias("reversal"), F.array_join(F.sort_array(p.salient_tokens(F.col("s"))), ",").alias("salient")
    )


@query(
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 3 THEN date_trunc('month', o_orderdate) WHEN 4 THEN TIMESTAMP '2000-01-01 00:00:00' ELSE date_trunc('day', o_orderdate) END AS event_date FROM orders"""
)
def f13_event_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = """case o_orderkey % 5 when 0 then concat('placed ', date_format(o_orderdate, 'yyyy-MM-dd'), '.') when 1 then concat('placed on ', date_format(o_orderdate, 'MMMM d'), 'th, ', date_format(o_orderdate, 'yyyy'))
      when 2 then concat('on ', date_format(o_orderdate, 'd'), 'th ', date_format(o_orderdate, 'MMM yyyy'), ' it came') when 3 then concat('back in ', date_format(o_orderdate, 'MMMM yyyy')) else 'in 1999' end"""
    rows = t.table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{said} as s")
    return rows.select("o_orderkey", x.event_date(F.col("s"), F.expr("timestamp_ntz'2000-01-01 00:00:00'")).alias("event_date"))


_ASKS = """CASE c_custkey % 10 WHEN 0 THEN 'Where are we with the deployment?' WHEN 1 THEN 'What exactly did Caroline say?' WHEN 2 THEN 'Which projects does Maria own?' WHEN 3 THEN 'When did the outage start in 2021?'
  WHEN 4 THEN 'Why does the build fail with exit 1?' WHEN 5 THEN 'What is the current owner?' WHEN 6 THEN 'first meeting with Bob' WHEN 7 THEN 'status of Alpha and Bravo and Charlie' WHEN 8 THEN 'What "red lamp" means' ELSE 'Name the color' END"""


@query(
    f"""WITH q AS (SELECT c_custkey, c_custkey % 10 AS k, {_ASKS} AS ask FROM customer)
SELECT c_custkey, ['broad', 'verbatim', 'list', 'neutral', 'neutral', 'neutral', 'neutral', 'neutral', 'verbatim', 'neutral'][k + 1] AS intent, k IN (3, 5, 6) AS temporal, k = 5 AS current,
  CASE WHEN k = 6 THEN 'first' END AS "order", CASE WHEN k = 3 THEN 2021 END AS year, k = 4 AS error FROM q"""
)
def f15_query_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_ASKS} as ask")
    intent = x.temporal_intent(F.col("ask"))
    return rows.select("c_custkey", x.query_intent(F.col("ask")).alias("intent"), intent.temporal.alias("temporal"), intent.current.alias("current"), intent.order.alias("order"), intent.year.alias("year"), x.is_error_query(F.col("ask")).alias("error"))


@query("SELECT id, 'Symptom: ' || trim(speaker) || chr(10) || 'Cause: ' || trim(namespace) || chr(10) || 'Fix: ' || trim(author) || CASE WHEN memory_type = 'fact' THEN '' ELSE chr(10) || 'Verify: ' || memory_type END AS fix_text FROM turns".join(["WITH " + t.CTES["turns"] + "\n", ""]))
def f17_fix_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.turns(spark, sf_dir)
    return rows.select("id", x.fix_text(F.col("speaker"), F.col("namespace"), F.col("author"), F.when(F.col("memory_type") != "fact", F.col("memory_type"))).alias("fix_text"))


@query(
    """WITH n AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'the  User' WHEN 1 THEN 'me' WHEN 2 THEN 'THE assistant' WHEN 3 THEN 'ann lee' ELSE c_name END AS name, c_custkey % 6 AS k FROM customer)
SELECT c_custkey, CASE WHEN k IN (0, 1, 3) THEN 'Ann Lee' WHEN k = 2 THEN 'assistant' ELSE name END AS subject, CASE WHEN k IN (0, 3) THEN 'Ann Lee' WHEN k = 2 THEN 'assistant' ELSE name END AS object FROM n"""
)
def f19_canonical_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.table(spark, sf_dir, "customer").selectExpr("c_custkey", "case c_custkey % 6 when 0 then 'the  User' when 1 then 'me' when 2 then 'THE assistant' when 3 then 'ann lee' else c_name end as name")
    return rows.select("c_custkey", x.canonical_entity(F.col("name"), "Ann Lee").alias("subject"), x.canonical_entity(F.col("name"), "Ann Lee", is_object=True).alias("object"))


@query(
    r"""WITH n AS (SELECT doc_id, trim(regexp_replace(lower(text), '[ \t\n\r\f\v]+', ' ', 'g')) AS norm FROM documents), s AS (SELECT *, regexp_extract_all(norm, '[a-z0-9]+') AS w FROM n)
SELECT doc_id, 'auto:' || coalesce(nullif(trim(substr(array_to_string(w[1:6], '-'), 1, 60), '-'), ''), 'constraint') || '-' || substr(sha1(norm), 1, 10) AS subject FROM s"""
)
def f20_constraint_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "documents").select("doc_id", x.constraint_subject(F.col("text")).alias("subject"))


@query(
    """SELECT page_id, '<peer_memory author="' || url || '" trust="untrusted">' || replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</peer_memory>' AS envelope
FROM (SELECT page_id, html, replace(url, '&', '&amp;') AS url FROM pages)"""
)
def f21_peer_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "pages").select("page_id", x.peer_envelope(F.col("html"), F.col("url")).alias("envelope"))


@query("SELECT doc_id, sha1('blob ' || strlen(text) || chr(0) || text) AS blob_sha FROM documents")
def f22_git_blob_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "documents").select("doc_id", x.git_blob_sha(F.col("text")).alias("blob_sha"))


@query(
    """WITH v AS (SELECT p_partkey, p_size || '.' || (p_partkey % 12) || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '.' || (p_partkey % 7) END AS version FROM part)
SELECT p_partkey, list_resize(list_transform(string_split(version, '.'), lambda s: CAST(s AS INTEGER)), 6, 0) AS version, list_resize(list_transform(string_split(version, '.'), lambda s: CAST(s AS INTEGER)), 6, 0) >= [10, 2, 0, 0, 0, 0] AS since_10_2 FROM v"""
)
def f26_semver(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.table(spark, sf_dir, "part").selectExpr("p_partkey", "concat(p_size, '.', p_partkey % 12, case when p_partkey % 3 = 0 then '' else concat('.', p_partkey % 7) end) as v")
    return rows.select("p_partkey", x.semver(F.col("v")).alias("version"), (x.semver(F.col("v")) >= x.semver(F.lit("10.2"))).alias("since_10_2"))


@query(r"SELECT count(*) AS n, count(DISTINCT trim(regexp_replace(lower(text), '[ \t\n\r\f\v]+', ' ', 'g'))) AS n_distinct FROM documents")
def f27_norm_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = t.table(spark, sf_dir, "documents").select(x.norm_content(F.col("text")).alias("k"))
    return keys.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("k").alias("n_distinct"))


@query(r"SELECT doc_id, array_to_string(regexp_split_to_array(trim(text, E' \n'), '[ \t\n\r\f\v]+')[1:40], ' ') AS head FROM documents")
def f28_clamp_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "documents").select("doc_id", x.clamp_tokens(F.trim("text"), 40).alias("head"))


@query(
    f"""SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'prohibition' ELSE 'requirement' END AS polarity,
  CAST(len(list_distinct(list_filter(list_transform(regexp_extract_all(text, '[A-Za-z]{{4,}}'), lambda w: lower(w)), lambda w: w NOT IN ({_SQL_LIST(x.DIFF_STOP)})))) AS INTEGER) AS n_words FROM benchmark"""
)
def f29_polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.table(spark, sf_dir, "benchmark")
    said = F.concat(F.when(F.col("item_id") % 2 == 0, "It MUST NOT be. ").otherwise("It MUST be. "), F.col("text"))
    return rows.select("item_id", x.polarity(said).alias("polarity"), F.size(x.content_words(F.col("text"))).alias("n_words"))


@query(
    """WITH c AS (SELECT event_id, event_id % 5 AS k, event_type FROM events)
SELECT event_id, CASE k WHEN 0 THEN '#' || event_type WHEN 1 THEN '@' || event_type WHEN 2 THEN 'status:' || event_type WHEN 3 THEN '*' END AS channel,
  CASE k WHEN 0 THEN 'topic' WHEN 1 THEN 'direct' WHEN 2 THEN 'status' WHEN 3 THEN 'wildcard' END AS kind FROM c"""
)
def f31_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.table(spark, sf_dir, "events").selectExpr("event_id", "case event_id % 5 when 0 then event_type when 1 then concat(' @', event_type) when 2 then concat('status:', event_type) when 3 then '*' else 'no spaces allowed' end as c")
    rows = rows.select("event_id", x.valid_channel(F.col("c")).alias("channel"))
    return rows.select("event_id", "channel", F.when(F.col("channel").isNotNull(), x.channel_kind(F.col("channel"))).alias("kind"))


@query(
    """SELECT a.p_name AS a, b.p_name AS b FROM (SELECT DISTINCT p_name FROM part) a JOIN (SELECT DISTINCT p_name FROM part) b
ON a.p_name < b.p_name AND levenshtein(a.p_name, b.p_name) <= 2"""
)
def f32_near_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names within two edits differ in length by two at most and share one of three equal pieces' positions, so
    pairs are found through deletions of up to two letters rather than by comparing all."""
    names = t.table(spark, sf_dir, "part").select("p_name").distinct()
    cut = lambda s, i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1, F.length(s)))
    once = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: cut(s, i))
    own = F.col("p_name")
    keys = F.array_distinct(F.concat(F.array(own), once(own), F.flatten(F.transform(once(own), once))))
    keyed = names.select("p_name", F.explode(keys).alias("k"))
    pairs = keyed.alias("l").join(keyed.alias("r"), F.expr("l.k = r.k and l.p_name < r.p_name")).select(F.col("l.p_name").alias("a"), F.col("r.p_name").alias("b")).distinct()
    return pairs.where(x.near_name(F.col("a"), F.col("b")))


@query(
    """WITH u AS (SELECT l_returnflag AS op, CASE l_linenumber % 3 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'gpt-5-mini' ELSE 'local' END AS model, l_quantity * 100 AS tin, l_linenumber * 10 AS tout FROM lineitem)
SELECT op, model, round(sum(tin / 1e6 * CASE model WHEN 'gpt-4o' THEN 2.5 WHEN 'gpt-5-mini' THEN 0.25 ELSE 0.0 END + tout / 1e6 * CASE model WHEN 'gpt-4o' THEN 10.0 WHEN 'gpt-5-mini' THEN 2.0 ELSE 0.0 END), 4) AS cost FROM u GROUP BY op, model"""
)
def f33_llm_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.table(spark, sf_dir, "lineitem").selectExpr("l_returnflag as op", "case l_linenumber % 3 when 0 then 'gpt-4o' when 1 then 'gpt-5-mini' else 'local' end as model", "l_quantity * 100 as tin", "l_linenumber * 10 as tout")
    return rows.groupBy("op", "model").agg(F.round(F.sum(x.llm_cost(F.col("model"), F.col("tin"), F.col("tout"))), 4).alias("cost"))


_STEM = """CASE WHEN w LIKE '%ing' AND length(w) >= 6 THEN left(w, -3) WHEN w LIKE '%es' AND length(w) >= 5 THEN left(w, -2) WHEN w LIKE '%ed' AND length(w) >= 5 THEN left(w, -2)
  WHEN w LIKE '%s' AND length(w) >= 4 THEN left(w, -1) ELSE w END"""


@query(
    f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents), s AS (SELECT doc_id, {_STEM} AS term FROM w WHERE length(w) >= 2 AND w NOT IN ({_SQL_LIST(x.LEX_STOP)}))
SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM s GROUP BY term"""
)
def f36_lex_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = t.table(spark, sf_dir, "documents").select("doc_id", F.explode(x.lex_words(F.col("text"))).alias("word")).where(x.is_lex_word(F.col("word")))
    terms = words.select("doc_id", x.lex_stem(F.col("word")).alias("term"))
    by_doc = terms.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return by_doc.groupBy("term").agg(F.sum("n").alias("tf"), F.count(F.lit(1)).alias("df"))


@query("""SELECT doc_id, ['src:' || source || ':' || lang, 'src:' || source, 'src'][1 + (doc_id % 2):] AS ancestors FROM documents""")
def b6_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.table(spark, sf_dir, "documents").selectExpr("doc_id", "concat('src:', source, ':', lang, case when doc_id % 2 = 0 then ':leaf' else '' end) as ns")
    return rows.select("doc_id", x.ancestors(F.col("ns")).alias("ancestors"))


@query("""SELECT s_suppkey, 'host' || s_nationkey || '.example.com/team/' || lower(replace(s_name, '#', '-')) AS repo FROM supplier""")
def b11_repo_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey",
        """case s_suppkey % 3 when 0 then concat('git@host', s_nationkey, '.example.com:Team/', replace(s_name, '#', '-'), '.git')
          when 1 then concat('https://bob@host', s_nationkey, '.example.com/team/', replace(s_name, '#', '-'), '/') else concat(' ssh://HOST', s_nationkey, '.example.com/team/', replace(s_name, '#', '-'), '.git') end as url""",
    )
    return rows.select("s_suppkey", x.repo_key(F.col("url")).alias("repo"))


@query(
    oracle(
        "SELECT id, substr(sha256(namespace || '|' || first_value(text) OVER (PARTITION BY session_id ORDER BY CASE WHEN speaker = 'user' THEN 0 ELSE 1 END, id)), 1, 16) AS conv_key FROM turns",
        "turns",
    )
)
def f35_conversation_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("session_id").orderBy(F.when(F.col("speaker") == "user", 0).otherwise(1), "id")
    key = F.sha2(F.concat_ws("|", "namespace", F.first("text").over(order)).cast("binary"), 256)
    return t.turns(spark, sf_dir).select("id", F.substring(key, 1, 16).alias("conv_key"))


@query(oracle("SELECT id, round(40.0 * least(1.0, sqrt((id % 100) / 1000.0 / 0.10)), 6) AS penalty FROM turns", "turns"))
def f34_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.turns(spark, sf_dir).select("id", F.round(x.contradiction_penalty(F.col("id") % 100 / 1000.0), 6).alias("penalty"))
