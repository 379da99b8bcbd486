"""Operators that SQL can't express, or that no query's oracle covers, against plain Python on small fixtures."""

import datetime as dt
import hashlib
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from factlake.functions import text as x
from factlake.operators import anchors, analytics, episodes, graph, lookups, recall, retrieval
from factlake.plans import adapters
from factlake.sources import tables
from factlake.streaming import feeds

T0 = dt.datetime(2024, 1, 1)


def chunks(text, size, overlap):
    done, open_ = [], ""
    for p in (q.strip(" ") for q in re.split(r"\n\s*\n", text)):
        if not p:
            continue
        if len(p) > size:
            if open_:
                done.append(open_)
            step, at = size - overlap, 0
            while True:
                done.append(p[at : at + size])
                if at + size >= len(p):
                    break
                at += step
            open_ = ""
        elif not open_:
            open_ = p
        elif len(open_) + len(p) + 2 <= size:
            open_ += "\n\n" + p
        else:
            done.append(open_)
            open_ = p
    return done + ([open_] if open_ else [])


def test_chunks_and_ingest(spark):
    rng = random.Random(1)
    texts = ["", None, "one", "a" * 500, "\n\n", "x" * 100 + "\n\n" + "y" * 20] + ["\n\n".join("w" * rng.choice([3, 30, 99, 100, 101, 250, 333]) for _ in range(rng.randint(1, 9))) for _ in range(40)]
    texts.append("token = abcdefgh12345678 end")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["chunk"]): r["text"] for r in tables.chunk_text(docs, 100, 15).collect()}
    assert got == {(i, k): c for i, t in enumerate(texts) for k, c in enumerate(chunks(t or "", 100, 15))}
    kept = tables.ingest_documents(docs, 100, 15, most=400).collect()
    long = {i for i, t in enumerate(texts) if t and len(t) > 400}
    assert {r["doc_id"] for r in tables.refused_documents(docs, 400).collect()} == long and long
    assert {r["doc_id"] for r in kept} == {i for (i, _) in got} - long
    assert [r["text"] for r in kept if r["doc_id"] == len(texts) - 1] == ["token = [REDACTED:credential] end"]
    assert tables.ingest_documents(docs, 100, 15, most=None).count() == len(got)


def test_hash_embedding(spark):
    texts = ["Running tests", "", None, "the cat and the cats", "é 42 configs"]
    found = tables.hash_embed(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), dim=16).collect()
    tokens = {r["id"]: r["t"] for r in spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", x.lex_tokens(F.col("text")).alias("t")).collect()}
    for r in found:
        v = np.zeros(16)
        for t in tokens[r["id"]]:
            d = hashlib.sha256(t.encode()).digest()
            v[int.from_bytes(d[:4], "big") % 16] += 1 if d[4] & 1 else -1
        n = np.linalg.norm(v)
        assert np.allclose(r["embedding"], v / n if n else v)


def test_event_segmentation(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for s in range(6):
        at, event, n, total, last = T0, 0, 0, None, None
        for k in range(30):
            at += dt.timedelta(hours=float(rng.choice([0.1, 1, 7])))
            v = None if k % 9 == 4 else rng.normal(size=3)
            unlike = total is not None and v is not None and total @ v / (np.linalg.norm(total) * np.linalg.norm(v)) < 1 - 0.55
            if n and (n >= 8 or at - last > dt.timedelta(hours=6) or unlike):
                event, n, total = event + 1, 0, None
            want[s * 100 + k] = event
            n, last = n + 1, at
            total = v if total is None else total if v is None else total + v
            rows.append((s * 100 + k, "n", f"s{s}", at, None if v is None else v.tolist()))
    rng.shuffle(rows)
    frame = spark.createDataFrame([tuple(r) for r in rows], "id long, namespace string, session_id string, observed_at timestamp_ntz, embedding array<double>")
    assert {r["id"]: r["event"] for r in episodes.segment_events(frame).collect()} == want


def test_handoff_chains(spark):
    rng = random.Random(5)
    allowed = {("", "offered"), ("offered", "accepted"), ("offered", "declined"), ("accepted", "offered"), ("accepted", "done"), ("declined", "offered")}
    rows = [(c, n, rng.choice(["offered", "accepted", "declined", "done"]), rng.choice("ab")) for c in range(20) for n in range(rng.randint(1, 25))]
    want = {}
    for c, _, state, holder in sorted(rows):
        s, h, hops = want.get(c, ("", None, 0))
        want[c] = (state, holder, hops + (state == "accepted")) if (s, state) in allowed else (s, h, hops)
    rng.shuffle(rows)
    got = {r["chain"]: (r["state"], r["holder"], r["hops"]) for r in feeds.handoffs(spark.createDataFrame(rows, "chain long, n long, state string, holder string"), 3).collect()}
    assert got == want


def test_leases(spark):
    rng = random.Random(6)
    rows = [("n", rng.choice("kl"), rng.choice("abc"), rng.choice(["acquire", "acquire", "heartbeat", "release"]), T0 + dt.timedelta(seconds=rng.randint(0, 4000)), i) for i in range(300)]
    want, ttl = [], dt.timedelta(seconds=60)
    for key in "kl":
        held = None
        for _, _, who, action, at, _ in sorted((r for r in rows if r[1] == key), key=lambda r: (r[4], r[5])):
            if held and held[2] <= at:
                want.append((key, *held))
                held = None
            if action == "acquire" and not held:
                held = (who, at, at + ttl)
            elif action == "heartbeat" and held and held[0] == who:
                held = (who, held[1], at + ttl)
            elif action == "release" and held and held[0] == who:
                want.append((key, who, held[1], at))
                held = None
        want += [(key, *held)] if held else []
    spans = feeds.lease_spans(spark.createDataFrame(rows, "namespace string, key string, holder string, action string, ts timestamp_ntz, id long"), 60)
    got = sorted((r["key"], r["holder"], r["acquired_at"], r["ended_at"]) for r in spans.collect())
    assert got == sorted(want)
    at = T0 + dt.timedelta(seconds=2000)
    assert {r["key"]: r["holder"] for r in feeds.lease_holders(spans, F.lit(at).cast("timestamp_ntz")).collect()} == {k: h for k, h, a, e in want if a <= at < e}


def test_delivery_is_repeated_until_it_succeeds_or_is_given_up(spark, tmp_path):
    log = str(tmp_path / "posted")

    def post(rows):
        if rows[0]["subscriber"] == "bad" or (rows[0]["subscriber"] == "late" and not any(r["n"] > 1 for r in rows)):
            raise OSError
        with open(log, "a") as f:
            f.write("".join(json.dumps([r["subscriber"], r["n"]]) + "\n" for r in rows))

    send = feeds.deliver(post, str(tmp_path / "kept"), most=3)
    for epoch in range(6):
        send(spark.createDataFrame([(s, epoch) for s in ("good", "late", "bad")], "subscriber string, n long"), epoch)
    posted = [tuple(json.loads(line)) for line in open(log)]
    assert {n for s, n in posted if s == "good"} == {n for s, n in posted if s == "late"} == set(range(6)) and not [s for s, _ in posted if s == "bad"]
    left = spark.read.parquet(str(tmp_path / "kept" / "epoch-5")).collect()
    assert sorted((r["subscriber"], r["n"]) for r in left) == [("bad", n) for n in range(6)] and max(r["failures"] for r in left) == 3
    assert sorted(p.name for p in (tmp_path / "kept").iterdir()) == ["epoch-4", "epoch-5"]
    fresh = feeds.deliver(post, str(tmp_path / "fresh"), most=3)
    for epoch in (41, 41, 42):  # a new folder in the middle of a stream, and a batch that is run again
        fresh(spark.createDataFrame([("bad", epoch)], "subscriber string, n long"), epoch)
    assert sorted((r["n"], r["failures"]) for r in spark.read.parquet(str(tmp_path / "fresh" / "epoch-42")).collect()) == [(41, 2), (42, 2)]


def test_touched_names(spark):
    """By the rule itself: lines that one side has more copies of, two lines around them, the header above."""
    old = "import a\n\ndef first(x):\n    y = 1\n    return y\n\n\n\n\n\n\nclass Second:\n    z = 2\n"
    rng = random.Random(4)
    cases = [(old, old.replace("y = 1", "y = 3")), (old, old), (old, old + "def third():\n    pass\n"), ("", old), (old, ""), (None, old), (old, old.replace("\n", "\r\n")), ("a\nb", "b\na"), (old, old.replace("x):\n", "x):\n\n"))]
    lines = ["def first(x):", "class Second:", "    y = 1", "    z = 2", "", "pass", "func third() {", "  return y", "t"]
    cases += [("\n".join(rng.choices(lines, k=rng.randint(0, 12))), "\n".join(rng.choices(lines, k=rng.randint(0, 12)))) for _ in range(150)]
    names = ["first", "Second", "third", "y", "z", "first"]
    frame = spark.createDataFrame([(i, a, b, names) for i, (a, b) in enumerate(cases)], "id long, old string, new string, names array<string>")
    got = {r["id"]: r["touched"] for r in anchors.touched_names(frame, ["id"]).collect()}
    for i, texts in enumerate(cases):
        sides = [re.split(r"\r\n|\n", t) if t is not None else [] for t in texts]
        said = set()
        for own, other in (sides, sides[::-1]):
            for at, line in enumerate(own):
                if line and own[: at + 1].count(line) > other.count(line):
                    said |= {*own[max(0, at - 2) : at + 3], *[x for x in own[: at + 1] if re.match(r"\s*(def|class|func) [A-Za-z_]", x)][-1:]}
        assert got.get(i, []) == [w for w in names if any(re.search(rf"\b{w}\b", x) for x in said)], (i, texts)

def test_near_candidates_join_along_chains(spark):
    angle = lambda d: [float(np.cos(np.radians(d))), float(np.sin(np.radians(d)))]
    rows = [(1, i, s, i, c, angle(d)) for i, s, c, d in [(1, 0.9, "a", 0), (2, 0.8, "b", 10), (3, 0.7, "c", 20), (4, 0.6, "d", 30), (5, 0.5, "a ", 90), (6, 0.4, "e", 180)]]
    rows += [(2, 1, 0.5, 1, "x", angle(0)), (2, 2, 0.6, 2, "y", None)]
    cands = spark.createDataFrame(rows, "query_id long, id long, score double, observed_at long, content string, embedding array<double>")
    got = sorted((r["query_id"], r["id"], r["dup_count"]) for r in retrieval.dedupe_near(cands, x.norm_content(F.col("content")), 0.03).collect())
    # 1 and 5 are one content; 1 - 2 - 3 - 4 are a chain of steps of 10 degrees
    assert got == [(1, 1, 5), (1, 6, 1), (2, 1, 1), (2, 2, 1)]


def test_timeline_finds_names_of_several_words(spark):
    facts = spark.createDataFrame([(1, "n", "Acme Corp", "it grew", T0), (2, "n", "x", "We met Acme  corp, today", T0), (3, "n", "x", "Acme and corp", T0), (4, "m", "acme corp", "", T0)], "id long, namespace string, subject string, statement string, observed_at timestamp_ntz")
    queries = spark.createDataFrame([("q", "n", ["ACME Corp", "today"])], "query_id string, namespace string, entities array<string>")
    assert sorted(r["id"] for r in retrieval.timeline(queries, facts, 9).collect()) == [1, 2]


def test_render_context(spark):
    rng = random.Random(7)
    rows = [(q, p, rng.random() < 0.2, "x" * rng.randint(1, 40)) for q in range(5) for p in range(12)]
    got = {r["query_id"]: r["context"] for r in retrieval.render_context(spark.createDataFrame(rows, "query_id long, position long, pinned boolean, line string"), 100).collect()}
    for q in range(5):
        used, kept = 0, []
        for _, _, pinned, line in sorted(r for r in rows if r[0] == q):
            if pinned or used + len(line) + 1 <= 100:
                kept.append(line)
                used += 0 if pinned else len(line) + 1
        assert got[q] == "\n".join(kept)


def test_hybrid_search_is_both_arms_fused(spark):
    rng = np.random.default_rng(8)
    words = "alpha beta gamma delta lamp house river stone".split()
    docs = [(i, f"n{i % 2}", " ".join(rng.choice(words, 6)), rng.normal(size=4).tolist() if i % 5 else None, T0 if i % 7 == 0 else None, None) for i in range(80)]
    table = spark.createDataFrame(docs, "id long, namespace string, text string, embedding array<double>, valid_to timestamp_ntz, expired_at timestamp_ntz")
    queries = spark.createDataFrame([(k, f"n{k % 2}", words[k] + " " + words[k + 1], rng.normal(size=4).tolist()) for k in range(5)], "query_id long, namespace string, text string, embedding array<double>")
    got = {(r["query_id"], r["id"]): r["score"] for r in retrieval.hybrid_search(queries, table, 10, current_only=True).collect()}
    live = table.where("valid_to is null")
    scores = {}
    for arm in (retrieval.vector_topk(queries, live.where("embedding is not null"), 10), retrieval.lexical_topk(queries, live, 10)):
        for r in arm.collect():
            scores[r["query_id"], r["id"]] = scores.get((r["query_id"], r["id"]), 0) + 1 / (60 + r["rank"])
    for q in range(5):
        best = sorted(((round(s, 9), i) for (k, i), s in scores.items() if k == q), key=lambda z: (-z[0], z[1]))[:10]
        assert {i: s for (k, i), s in got.items() if k == q} == pytest.approx({i: s for s, i in best})


def test_approximate_totals(spark):
    found = analytics.approx_total(spark.range(20_000).withColumnRenamed("id", "k"), "k").first()["approx_rows"]
    assert abs(found - 20_000) < 0.1 * 20_000


def test_entity_view_and_reached_facts(spark):
    edges = spark.createDataFrame([("a", "b", 2.0), ("b", "c", 5.0), ("c", "d", 1.0), ("a", "e", 1.0)], "src string, dst string, weight double")
    facts = spark.createDataFrame([(1, T0, None, None), (2, None, None, None), (3, T0, T0, None), (4, T0, None, T0)], "id long, valid_from timestamp_ntz, valid_to timestamp_ntz, expired_at timestamp_ntz")
    mentions = spark.createDataFrame([("a", 1), ("a", 2), ("a", 4), ("c", 3), ("c", 1)], "key string, id long")
    seeds = spark.createDataFrame([("a",)], "node string")
    related, own = graph.entity_view(seeds, edges, mentions, facts, depth=1)
    assert [(r["node"], r["weight"]) for r in related.orderBy("rank").collect()] == [("c", 5.0), ("b", 2.0), ("e", 1.0)]
    assert [r["id"] for r in own.orderBy("rank").collect()] == [1, 2]
    reached = graph.expand_facts(graph.expand(seeds, edges, 2), mentions, facts).collect()
    assert sorted((r["id"], r["hop"]) for r in reached) == [(1, 0), (2, 0)]


def test_files_and_generators(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"caf\xc3\xa9 \xff")
    assert tables.read_text_files(spark, str(tmp_path / "a.txt")).first()["text"] == "café �"
    (tmp_path / "c.json").write_text(json.dumps({"id": "c", "sessions": [{"date": "2024-03-02", "turns": [{"speaker": "A", "text": "hi"}, {"speaker": "B", "text": "ho"}]}, {"date": "??", "turns": [{"speaker": "A", "text": "x"}]}]}))
    turns = tables.load_conversations(spark, str(tmp_path / "c.json"), F.lit(T0).cast("timestamp_ntz")).orderBy("session_id", "n").collect()
    assert [(r["session_id"], r["speaker"], r["observed_at"]) for r in turns] == [("c:0", "A", dt.datetime(2024, 3, 2)), ("c:0", "B", dt.datetime(2024, 3, 2, 0, 1)), ("c:1", "A", T0 + dt.timedelta(days=30))]
    log = str(tmp_path / "log")
    rows = spark.createDataFrame([(1, "n", None), (2, "m", T0)], "id long, namespace string, observed_at timestamp_ntz")
    tables.append_turns(rows, log)
    tables.append_turns(rows.where("id = 2"), log)
    assert spark.read.parquet(log).count() == 3 and spark.read.parquet(log).where("observed_at is null").count() == 0
    made = tables.gen_debt_facts(spark, 4000, 3)
    share = {r["kind_of"]: r["count"] / 4000 for r in made.groupBy("kind_of").count().collect()}
    assert share == pytest.approx({"unrelated": 0.70, "chain": 0.15, "reversal": 0.07, "restatement": 0.08}, abs=0.03)
    assert sorted(map(str, made.collect())) == sorted(map(str, tables.gen_debt_facts(spark, 4000, 3).collect()))

    def twice(batches):
        for pdf in batches:
            yield pdf.assign(embedding=[[float(len(t))] for t in pdf["text"]])

    again = tables.reembed(spark.createDataFrame([(1, "abc", [0.5])], "id long, text string, embedding array<double>"), twice).first()
    assert again["embedding"] == [3.0]


def test_explain_scope_and_filters(spark):
    rows = spark.createDataFrame([("A", "fact", False), ("B", "DECISION", False), ("A", None, True)], "author string, memory_type string, pinned boolean")
    assert lookups.filter_author(rows, []).count() == 3 and lookups.filter_author(rows, ["A"]).count() == 2
    assert lookups.filter_type(rows, []).count() == 3 and lookups.filter_type(rows, ["decision"]).count() == 2
    assert adapters.oracle("SELECT 1", "turns").startswith("WITH turns")
    none = spark.createDataFrame([], "query_id long, id long, kind string, superseded boolean, rank long")
    assert recall.demote_stale(none, F.lit(True)).count() == 0


def test_recall_of_approximate_neighbours(spark):
    """Against the exact form, on vectors with and without clusters."""
    rng = np.random.default_rng(11)
    for x in (rng.normal(size=(1500, 16)), np.repeat(rng.normal(size=(30, 16)), 50, axis=0) + rng.normal(size=(1500, 16)) * 0.3):
        vectors = spark.createDataFrame([(i, f"n{i % 3}", v.tolist()) for i, v in enumerate(x)], "id long, namespace string, embedding array<double>").cache()
        asked = vectors.where("id % 20 = 0").selectExpr("id as query_id", "namespace", "embedding")
        centres = retrieval.vector_cells(vectors, 32)
        exact = {(r["query_id"], r["id"]) for r in retrieval.vector_topk(asked, vectors, 10).collect()}
        found = {(r["query_id"], r["id"]) for r in retrieval.vector_topk_cells(asked, vectors, 10, centres, 20).collect()}
        assert len(found & exact) >= 0.9 * len(exact)
        whole = {(r["query_id"], r["id"]) for r in retrieval.vector_topk_cells(asked, vectors, 10, centres, 32).collect()}
        assert whole == exact


def test_many_queries_are_sent_to_parts(spark, monkeypatch):
    rng = np.random.default_rng(12)
    vectors = spark.createDataFrame([(i, f"n{i % 2}", rng.normal(size=4).tolist()) for i in range(200)], "id long, namespace string, embedding array<double>")
    asked = vectors.where("id % 5 = 0").selectExpr("id as query_id", "namespace", "embedding")
    few = sorted(map(tuple, retrieval.vector_topk(asked, vectors, 5).collect()))
    monkeypatch.setattr(retrieval, "BROADCAST_QUERIES", 3)
    assert sorted(map(tuple, retrieval.vector_topk(asked, vectors, 5).collect())) == few and len(few) == 200


def test_extracted_facts_by_a_callers_function(spark):
    def upper(batches):
        for pdf in batches:
            yield pdf.assign(subject="s", predicate="p", object=pdf["text"].str.upper(), statement=pdf["text"])[["id", "subject", "predicate", "object", "statement"]]

    turns = spark.createDataFrame([(1, "PR #5 at commit abcdef1"), (2, "plain")], "id long, text string")
    assert sorted(r["object"] for r in tables.extract_facts(turns, upper).collect()) == ["PLAIN", "PR #5 AT COMMIT ABCDEF1"]
    assert sorted(r["statement"] for r in tables.extract_facts(turns).collect()) == ["References PR #5", "References commit abcdef1"]
