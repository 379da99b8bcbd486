"""What joins broadcast, and how many rows they make."""

import fnmatch
import random
from collections import Counter

from pyspark.sql import functions as F

from factlake.operators import constraints, corpus, governance, graph, recall, retrieval
from factlake.sources import shared


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def joined_rows(spark, make):
    """Rows that the largest join of the frame that ``make`` gives makes when it runs."""

    def walk(node):
        own = node.metrics().get("numOutputRows") if "Join" in node.getClass().getSimpleName() else None
        kids = node.children()
        return ([own.get().value()] if own is not None and own.isDefined() else []) + [n for k in range(kids.size()) for n in walk(kids.apply(k))]

    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = make()
        rows = df.collect()
        return rows, max(walk(df._jdf.queryExecution().executedPlan()))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_enforcement_never_broadcasts_calls(spark, tmp_path):
    calls = [(i, "Bash", ("rm a", "git push", "ls")[i % 3]) for i in range(300)]
    spark.createDataFrame(calls, "call_id int, tool string, input string").write.parquet(f"{tmp_path}/calls")
    rules = [(1, "Bash(rm *)", "block"), (2, "*push*", "ask"), (3, "*x?", "ask")]
    got = governance.match_enforcement(spark.read.parquet(f"{tmp_path}/calls"), spark.createDataFrame(rules, "rule_no int, pattern string, level string"))
    assert "BuildLeft" not in plan_of(got)
    want = {i: min(n for n, p, _ in rules if fnmatch.fnmatchcase(f"{t}({s})", p)) for i, t, s in calls if s != "ls"}
    assert {r["call_id"]: r["rule_no"] for r in got.collect()} == want


def test_a_request_meets_the_latest_binding_of_a_key(spark):
    bindings = spark.range(300).selectExpr("1 as principal_id", "'repo' as key_type", "concat('r', id % 2) as key", "concat('ns', id) as namespace", "id as bound_at")
    requests = spark.range(200).selectExpr("id as request_id", "1 as principal_id", "concat('r', id % 3) as repo", "'h' as host", "'/p' as path")
    got, most = joined_rows(spark, lambda: governance.resolve_bindings(requests, bindings))
    assert most <= 200
    assert {r["request_id"]: r["namespace"] for r in got} == {i: ("ns298", "ns299")[i % 3] for i in range(200) if i % 3 < 2}


def test_queries_with_one_window_share_its_facts(spark):
    day = "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(id as int))"
    facts = spark.range(300).selectExpr("id", "'a' as namespace", f"{day} as valid_from", "cast(null as timestamp_ntz) as valid_to", "cast(null as timestamp_ntz) as expired_at")
    ends = "timestamp_ntz'2024-01-11 00:00:00' as start, timestamp_ntz'2024-09-01 00:00:00' as end".split(", ")
    windows = spark.range(100).selectExpr("id as query_id", "'a' as namespace", *ends, "cast(null as string) as order")
    # a query that asks for two windows gets the first facts of both together
    windows = windows.unionByName(spark.sql("select 7L as query_id, 'a' as namespace, timestamp_ntz'2024-01-06 00:00:00' as start, timestamp_ntz'2024-01-08 00:00:00' as end, cast(null as string) as order"))
    none = spark.createDataFrame([], "query_id long, id long, rank int")
    got, most = joined_rows(spark, lambda: recall.temporal_search(none, windows, facts, 4).groupBy("query_id").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    assert most <= 1000
    found = {r["query_id"]: r["ids"] for r in got}
    assert found == {q: [5, 6, 10, 11] if q == 7 else [10, 11, 12, 13] for q in range(100)}


def test_readable_namespaces_are_made_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(shared, "TASK_ROWS", 50)
    grants = spark.range(40).selectExpr("id as principal_id", "explode(array('*', 'a:*', 'a:1')) as namespace", "id % 4 <> 3 as can_read", "id % 2 = 0 as can_write")
    names = spark.range(20).selectExpr("concat('a:', id) as namespace")
    got = governance.readable_namespaces(grants, names)
    rows = got.withColumn("task", F.spark_partition_id()).collect()
    assert max(Counter(r["task"] for r in rows).values()) <= 150
    assert {tuple(r)[:3] for r in rows} == {(i, f"a:{k}", i % 2 == 0) for i in range(40) if i % 4 < 3 for k in range(20)}
    assert len(rows) == 600


def test_fanout_is_made_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(shared, "TASK_ROWS", 50)
    names = spark.range(20).selectExpr("concat('a:', id) as namespace")
    rules = spark.range(40).selectExpr("id as rule_id", "explode(array('a', 'a:1', 'b')) as namespace", "'ask' as level")
    links = spark.sql("select 'a:2' as src_ns, 'b' as dst_ns union all select 'a:2', 'a'")
    rows = constraints.enforcement_fanout(names, rules, links).withColumn("task", F.spark_partition_id()).collect()
    assert max(Counter(r["task"] for r in rows).values()) <= 150
    want = {(f"a:{k}", i): ("a:1", "own") if k == 1 else ("a", "ancestor") for i in range(40) for k in range(20)}
    assert len(rows) == 800
    assert {(r["namespace"], r["rule_id"]): (r["rule_ns"], r["way"]) for r in rows} == want


def test_equal_contents_are_one_before_queries_read_them(spark):
    pins = spark.range(400).selectExpr("'turn' as kind", "id", "'a' as namespace", "concat('must ', id % 3) as content", "400 - id as ts", "cast(null as string) as constraint_subject", "cast(null as int) as retired_at", "false as sourced")
    asked = spark.range(50).selectExpr("id as query_id", "'a' as namespace")
    none = spark.sql("select 'a' as child_namespace, 'b' as parent_namespace where false")
    got, most = joined_rows(spark, lambda: constraints.pinned_constraints(asked, pins, none)[0])
    assert most <= 400
    assert sorted((r["query_id"], r["position"], r["id"]) for r in got) == [(q, p, i) for q in range(50) for p, i in ((1, 399), (2, 398), (3, 397))]


def test_comentions_are_paired_in_many_tasks(spark, monkeypatch):
    rows = spark.range(60).selectExpr("id % 3 as episode", "id as entity")
    monkeypatch.setattr(shared, "TASK_ROWS", 50)
    assert plan_of(graph.comention_edges(rows)).count(", 24), REPARTITION_BY_NUM") == 2
    got = {tuple(r) for r in graph.comention_edges(rows).collect()}
    assert got == {(a, b, 1.0) for a in range(60) for b in range(a + 1, 60) if a % 3 == b % 3}


def test_diffs_are_judged_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(shared, "TASK_ROWS", 50)
    hunks = spark.range(100).selectExpr("id as diff_id", "1 as hunk", "'alpha beta gamma' as added", "case when id % 2 = 0 then 'alpha' end as removed")
    rules = spark.range(10).selectExpr("id as constraint_id", "'It MUST NOT alpha beta' as statement")
    rows = corpus.check_diffs(hunks, rules).withColumn("task", F.spark_partition_id()).collect()
    assert max(Counter(r["task"] for r in rows).values()) <= 200
    assert {(r["diff_id"], r["constraint_id"], r["verdict"], r["added_words"], r["removed_words"]) for r in rows} == {(d, c, "violated", 2, int(d % 2 == 0)) for d in range(100) for c in range(10)}


def test_hot_words_of_a_timeline_are_split_or_left_out(spark, monkeypatch):
    facts = spark.range(200).selectExpr("id", "'a' as namespace", "concat('s', id % 5) as subject", "concat('team red', id % 4, ' is up') as statement", "id as observed_at")
    queries = spark.sql("select concat('q', id) as query_id, 'a' as namespace, array(concat('Team Red', id % 4), concat('s', id)) as entities from range(8)")
    asked = lambda: sorted((r["query_id"], r["id"], r["rank"]) for r in retrieval.timeline(queries, facts, 6).collect())
    plain = asked()
    monkeypatch.setattr(retrieval, "BROADCAST_QUERIES", 2)
    monkeypatch.setattr(retrieval, "HOT_ROWS", 30)
    assert asked() == plain
    want = {(f"q{q}", i, n + 1) for q in range(8) for n, i in enumerate(sorted((i for i in range(200) if i % 4 == q % 4 or i % 5 == q), reverse=True)[:6])}
    assert {*plain} == want


def test_facts_near_seeds_are_dealt_once(spark, monkeypatch):
    monkeypatch.setattr(shared, "TASK_ROWS", 50)
    reached = spark.sql("select concat('s', a.id) as seed, concat('n', b.id) as node, cast(pmod(a.id + b.id, 3) as int) as hop from range(6) a, range(10) b")
    facts = spark.range(100).selectExpr("id", "cast(null as timestamp) as valid_to", "case when id % 9 = 0 then timestamp'2024-01-01 00:00:00' end as expired_at")
    mentions = spark.range(100).selectExpr("id", "explode(array(concat('n', id % 4), concat('n', id % 20))) as key")
    make = lambda: graph.expand_facts(reached, mentions, facts)
    assert "hashpartitioning(seed" not in plan_of(make())
    want = {}
    for i in (i for i in range(100) if i % 9):
        for s in range(6):
            want[f"s{s}", i] = min((s + k) % 3 for k in (i % 4, i % 20) if k < 10)
    assert {(r["seed"], r["id"]): r["hop"] for r in make().collect()} == want
    monkeypatch.setattr(graph, "BROADCAST_NEAR", 3)
    assert {(r["seed"], r["id"]): r["hop"] for r in make().collect()} == want


def test_the_last_frontier_is_not_written(spark, monkeypatch):
    written = []
    monkeypatch.setattr(graph, "stored", lambda df: written.append(1) or shared.stored(df))
    edges = spark.range(30).selectExpr("concat('a', id) as src", "concat('a', id + 1) as dst", "1.0d as weight")
    got = graph.expand(spark.sql("select 'a5' as node"), edges, 3)
    assert len(written) == 4
    assert {(r["node"], r["hop"]) for r in got.collect()} == {(f"a{5 + d}", abs(d)) for d in range(-3, 4)}


def test_what_the_last_hop_reaches_is_not_shuffled(spark, monkeypatch):
    rng = random.Random(9)
    pairs = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(90)] + [("n1", "n1"), ("n2", None), ("x1", "x2")]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src string, dst string, weight double")
    seeds = spark.createDataFrame([(f"n{i}",) for i in (*range(0, 60, 4), 4)] + [("x1",), ("alone",), (None,)], "node string")
    near = {}
    for a, b in pairs:
        if b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for (seed,) in seeds.distinct().collect():
        level, seen = {seed}, {seed}
        for hop in range(4):
            want |= {(seed, node): hop for node in level}
            level = {m for n in level for m in near.get(n, ())} - seen
            seen |= level
    # as it is; without those that go on told first; seeds in a few broadcasts; too many of them
    for told in ({}, {"FRONTIER_NODES": 0}, {"FRONTIER_BYTES": 4_000, "FRONTIERS": 50}, {"FRONTIERS": 0}):
        for name, value in told.items():
            monkeypatch.setattr(graph, name, value)
        got = graph.expand(seeds, edges, 3)
        assert (plan_of(got).count("Generate explode") > 1) == ("FRONTIER_BYTES" in told)
        assert ("hashpartitioning(seed" in plan_of(got)) == ("FRONTIERS" in told and not told["FRONTIERS"])
        assert sorted(map(str, got.collect())) == sorted(f"Row(seed={s!r}, node={n!r}, hop={h})" for (s, n), h in want.items())


def test_edges_into_a_hub_are_dealt_to_several_tasks(spark, monkeypatch):
    """Forty seeds reach a hub by way of forty nodes each; no task gets all of that."""
    monkeypatch.setattr(graph, "HUB_ROWS", 100)
    monkeypatch.setattr(shared, "TASK_ROWS", 100)
    pairs = [(f"s{i}", f"m{j}") for i in range(40) for j in range(40)] + [(f"m{j}", "hub") for j in range(40)]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src string, dst string, weight double")
    got = graph.expand(spark.sql("select concat('s', id) as node from range(40)"), edges, 2)
    tasks = got.withColumn("task", F.spark_partition_id()).where("node = 'hub' and hop = 2")
    assert tasks.select("task").distinct().count() > 4
    want = {(f"s{i}", n): h for i in range(40) for n, h in [("hub", 2), *((f"m{j}", 1) for j in range(40)), *((f"s{j}", 0 if i == j else 2) for j in range(40))]}
    rows = got.collect()
    assert {(r["seed"], r["node"]): r["hop"] for r in rows} == want and len(rows) == len(want)


def test_a_text_is_read_once_for_its_postings(spark, monkeypatch):
    """Segments end inside batches; equal ids are one text, and nothing but ids is shuffled for them."""
    monkeypatch.setattr(retrieval, "SEGMENT", 40)
    rng = random.Random(11)
    texts = [(i, rng.choice(["a", "b", None]), " ".join(rng.choices(["Gates", "gate", "lamps", "lamp", "the", "stored", "x", "K9"], k=rng.randrange(30))) or None) for i in range(200)]
    docs = spark.createDataFrame([*texts, (5, "a", "gate again"), (5, "a", "lamp"), (None, "b", "gate")], "id long, namespace string, text string").coalesce(1)
    want = {}
    for r in docs.where("namespace is not null").collect():
        for w in (r["text"] or "").lower().split():
            term = {"gates": "gat", "lamps": "lamp", "stored": "stor"}.get(w, w)
            if w not in ("the", "x"):
                want[r["namespace"], r["id"], term] = want.get((r["namespace"], r["id"], term), 0) + 1
    size = Counter()
    for (ns, i, _), n in want.items():
        size[ns, i] += n
    lists = retrieval.postings(retrieval._once(docs))
    assert "Exchange" not in plan_of(retrieval.postings(docs))
    got = lists.where("term is not null").selectExpr("namespace", "term", "inline(arrays_zip(ids, tfs, lens))").collect()
    assert {(r["namespace"], r["ids"], r["term"]): (r["tfs"], r["lens"]) for r in got} == {k: (n, size[k[:2]]) for k, n in want.items()} and len(got) == len(want)
    assert {(r["namespace"], r["n"]) for r in lists.where("term is null").groupBy("namespace").agg(F.sum("said").alias("n")).collect()} == {(ns, sum(n for k, n in size.items() if k[0] == ns)) for ns in "ab"}
    queries = spark.createDataFrame([(1, "a", "gates lamp"), (2, "b", "gate k9 lamp"), (3, "c", "gate")], "query_id long, namespace string, text string")
    ranks = [sorted(map(tuple, found.collect())) for found in (retrieval.lexical_topk(queries, docs, 6), retrieval.lexical_index(docs).topk(queries, 6))]
    assert ranks[0] == ranks[1] and [r[0] for r in ranks[0]] == [1] * 6 + [2] * 6 and all(r[1] is not None for r in ranks[0])


def test_texts_are_read_once_for_words_and_phrases(spark, monkeypatch):
    read = spark.sparkContext.accumulator(0)

    def counted(text):
        read.add(1)
        return text

    rng = random.Random(12)
    texts = [(i, rng.choice(["a", "b", None]), " ".join(rng.choices(["of", "the", "Big", "cat,", "category"], k=rng.randrange(9))) if i % 9 else None) for i in range(120)]
    docs = spark.createDataFrame(texts, "id long, namespace string, text string").withColumn("text", F.udf(counted, "string")("text"))
    asked = {1: '"of the"', 2: "cat -the", 3: '-"big cat"', 4: '"the the" OR "cat of"', 5: "the big", 6: "??"}
    queries = spark.createDataFrame([*asked.items()], "query_id long, text string")
    scope = queries.select("query_id", F.explode(F.array(F.lit("a"), F.lit("c"))).alias("namespace"))
    found = lambda: sorted(map(tuple, retrieval.boolean_match(retrieval.parse_terms(queries), docs, scope).collect()))
    got = found()
    assert read.value <= 120
    held = {i: f" {(t or '').lower().replace(',', '')} " for i, ns, t in texts if ns == "a"}
    holds = {1: lambda t: " of the " in t, 2: lambda t: " cat " in t and " the " not in t, 3: lambda t: " big cat " not in t, 4: lambda t: " the the " in t or " cat of " in t, 5: lambda t: " the " in t and " big " in t}
    assert got == sorted((q, i) for q, fits in holds.items() for i, t in held.items() if fits(t))
    monkeypatch.setattr(retrieval, "BROADCAST_QUERIES", 0)
    assert found() == got


def test_neighbours_are_found_in_tasks_of_bounded_size(spark, monkeypatch):
    """Edges of a few hubs and repeated pairs; tasks are dealt by how many edges there are."""
    rng = random.Random(13)
    rows = [(f"n{rng.randrange(4)}", f"m{rng.randrange(60)}", float(rng.randrange(9))) for _ in range(600)] + [("n1", "n1", 99.0), ("n1", "n2", 5.0)]
    edges = spark.createDataFrame(rows, "src string, dst string, weight double")
    seeds = spark.createDataFrame([("n1",), ("m3",), ("n9",)], "node string")
    monkeypatch.setattr(shared, "TASK_ROWS", 50)
    dealt = []
    monkeypatch.setattr(graph, "spread", lambda df, n, *keys: (dealt.append((n, keys)), shared.spread(df, n, *keys))[1])
    near = graph.neighbours(seeds, edges, 5)
    assert dealt == [(1204, ("node", "part"))]
    best = {}
    for a, b, w in rows:
        for x, y in ((a, b), (b, a)):
            if x in ("n1", "m3") and x != y:
                best[x, y] = max(best.get((x, y), 0), w)
    want = {(x, y, w) for n in ("n1", "m3") for (x, y), w in sorted(((k, w) for k, w in best.items() if k[0] == n), key=lambda z: (-z[1], z[0]))[:5]}
    assert {(r["node"], r["other"], r["weight"]) for r in near.collect()} == want
    dealt.clear()
    around = graph.neighbourhood(seeds, edges, 8, hub=200, frontier=3).collect()
    assert dealt[0] == (1204, ("node",)) and dealt[1][0] < 1204 and {r["seed"] for r in around} == {"n1", "m3"} and len(around) == 16
