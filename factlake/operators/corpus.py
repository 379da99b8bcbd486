"""Constraint corpora: rules out of documents, and texts and diffs checked against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factlake.functions.text import content_words, polarity
from factlake.sources.shared import spread

#: Words of constraints that are broadcast to hunks.
BROADCAST_WORDS = 200_000
#: Words that make a sentence a constraint.
NORMATIVE = r"(?<![\p{L}\p{N}_])(SHALL|MUST|SHOULD|REQUIRED|PROHIBITED|FORBIDDEN|MAY NOT)(?![\p{L}\p{N}_])"


def ingest_constraints(docs: DataFrame) -> DataFrame:
    """Normative sentences of ``docs(namespace, source, text)``: markup stripped, eight letters or more, at most a thousand."""
    lines = docs.select("namespace", "source", F.posexplode(F.split("text", r"\n+")).alias("line_no", "line"))
    line = F.trim(F.regexp_replace(F.trim("line"), r"^[#\-*>| ]+", ""))
    sentences = lines.select("namespace", "source", "line_no", F.posexplode(F.split(F.regexp_replace(line, r"([.!?])\s+", "$1\u0001"), "\u0001")).alias("sentence_no", "statement"))
    kept = sentences.withColumn("statement", F.trim("statement")).where((F.length("statement") >= 8) & F.upper("statement").rlike(NORMATIVE))
    return kept.select("namespace", "source", "line_no", "sentence_no", F.substring("statement", 1, 1000).alias("statement"))


def replace_source(existing: DataFrame, new: DataFrame) -> DataFrame:
    """A source's constraints after it is read again: its earlier rows go."""
    again = new.select("namespace", "source").distinct()
    return existing.join(again, ["namespace", "source"], "left_anti").unionByName(new)


def diff_hunks(diffs: DataFrame) -> DataFrame:
    """Hunks of unified diffs: ``(diff_id, hunk, added, removed)``.

    A ``---`` line is a header only if a ``+++`` line follows it, and ``+++`` only after such a line, so
    changed lines that look like headers are kept as content.
    """
    lines = diffs.select("diff_id", F.posexplode(F.split("diff", "\n")).alias("n", "line"))
    w = Window.partitionBy("diff_id").orderBy("n")
    minus = F.col("line").startswith("--- ")
    pair_next = F.coalesce(F.lead("line").over(w).startswith("+++ "), F.lit(False))
    pair_before = F.col("line").startswith("+++ ") & F.coalesce(F.lag("line").over(w).startswith("--- "), F.lit(False))
    rows = lines.withColumn("header", (minus & pair_next) | pair_before)
    rows = rows.withColumn("hunk", F.sum(F.col("line").startswith("@@").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    changed = rows.where(~F.col("header") & F.col("line").rlike(r"^[+-]"))
    text = lambda sign: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("line").startswith(sign), F.struct("n", "line")))), lambda x: F.substr(x.line, F.lit(2), F.length(x.line))), "\n")
    return changed.groupBy("diff_id", "hunk").agg(text("+").alias("added"), text("-").alias("removed"))


def check_diffs(hunks: DataFrame, constraints: DataFrame, overlap: int = 2) -> DataFrame:
    """A verdict for each diff and constraint that shares words with it.

    A hunk that adds ``overlap`` content words of a prohibition, or removes those of a requirement,
    violates it; the other way round satisfies it; a smaller overlap leaves it uncovered. A violation in
    any hunk decides. Constraints and hunks meet by their words, not in all pairs. Common words join very many, so
    diffs are dealt to tasks by how many pairs there can be, and each is judged in its task if the constraints' words
    can be broadcast.
    """
    terms = lambda c, side: F.transform(F.coalesce(content_words(F.col(c)), F.array().cast("array<string>")), lambda w: F.struct(w.alias("word"), F.lit(side).alias("side")))
    rules = constraints.select("constraint_id", F.explode(content_words(F.col("statement"))).alias("word"))
    kinds = constraints.select("constraint_id", polarity(F.col("statement")).alias("polarity"))
    if rules.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS:
        hunks = spread(hunks, hunks.count() * constraints.count(), "diff_id")
        rules, kinds = F.broadcast(rules), F.broadcast(kinds)
    sides = hunks.select("diff_id", "hunk", F.explode(F.concat(terms("added", "added"), terms("removed", "removed"))).alias("x")).select("diff_id", "hunk", "x.*")
    shared = sides.join(rules, "word").groupBy("diff_id", "hunk", "constraint_id").agg(F.count_if(F.col("side") == "added").alias("a"), F.count_if(F.col("side") == "removed").alias("r"))
    votes = shared.join(kinds, "constraint_id")
    enough = F.greatest("a", "r") >= overlap
    adds = F.col("a") >= F.col("r")
    vote = F.when(~enough, 0).when(adds == (F.col("polarity") == "prohibition"), 2).otherwise(1)
    best = votes.groupBy("diff_id", "constraint_id").agg(F.max(vote).alias("v"), F.max("a").alias("added_words"), F.max("r").alias("removed_words"))
    return best.select("diff_id", "constraint_id", F.element_at(F.array(F.lit("uncovered"), F.lit("satisfied"), F.lit("violated")), F.col("v") + 1).alias("verdict"), "added_words", "removed_words")


def compliance(verdicts: DataFrame) -> DataFrame:
    """Share of decided constraints that a diff satisfies; none decided: 1."""
    n = verdicts.groupBy("diff_id").agg(F.count_if(F.col("verdict") == "satisfied").alias("satisfied"), F.count_if(F.col("verdict") == "violated").alias("violated"), F.count(F.lit(1)).alias("checked"))
    decided = F.col("satisfied") + F.col("violated")
    return n.withColumn("score", F.when(decided > 0, F.round(F.col("satisfied") / decided, 6)).otherwise(1.0))


def version_status(rows: DataFrame) -> DataFrame:
    """Where a version stands to a constraint's window: ``rows(since, until, version, deviation_until)`` as arrays.

    Before ``since`` it does not apply; an approved deviation that still holds comes before expiry.
    """
    v = F.col("version")
    applies = rows.where(v.isNull() | F.col("since").isNull() | (v >= F.col("since")))
    status = F.when(F.col("deviation_until").isNotNull() & (v.isNull() | (v < F.col("deviation_until"))), "approved_deviation").when(F.col("until").isNotNull() & (v >= F.col("until")), "expired").otherwise("active")
    return applies.withColumn("status", status)


def extract_rules(docs: DataFrame) -> DataFrame:
    """Rules of instruction documents: bullets and lines with a cue, outside code fences, under their headings, once each."""
    lines = docs.select("path", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    w = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.col("line").rlike(r"^\s*```")
    rows = lines.withColumns({"fenced": F.sum(fence.cast("int")).over(w) % 2 == 1, "heading": F.last(F.when(F.col("line").rlike(r"^#+\s"), F.trim(F.regexp_replace("line", r"^#+\s+", ""))), ignorenulls=True).over(w)})
    rule = F.trim(F.regexp_replace("line", r"^\s*(?:[-*+]|\d+[.)])\s+", ""))
    cue = F.col("line").rlike(r"^\s*(?:[-*+]|\d+[.)])\s+") | F.col("line").rlike(r"(?i)\b(always|never|must|should|do not|don't|avoid|prefer|ensure)\b")
    kept = rows.where(~F.col("fenced") & ~fence & ~F.col("line").rlike(r"^#+\s") & cue).select("path", "n", "heading", rule.alias("rule")).where(F.length("rule").between(15, 600))
    return kept.groupBy("path", "rule").agg(F.min(F.struct("n", "heading")).alias("f")).select("path", "rule", "f.n", "f.heading")


def classify_commits(commits: DataFrame, letters: int | None = 500) -> DataFrame:
    """Commits worth remembering and what they are: fix, then decision, then fact; with the first ``letters`` of the body (None: all)."""
    s, body = F.trim("subject"), F.trim(F.coalesce("body", F.lit("")))
    trivial = s.rlike(r"(?i)^(merge|wip|bump|typo|fmt|lint|format|chore: release)\b") | (F.length(s) < 10)
    conventional = s.rlike(r"(?i)^(feat|fix|perf|refactor|docs|test|build|ci|chore|revert)(\([^)]*\))?!?:")
    signal = s.rlike(r"(?i)\b(fix|decide|choose|switch|migrate|remove|add|replace|because|instead)\b")
    kind = F.when(s.rlike(r"(?i)^fix|\b(fix(es|ed)?|bug|regression)\b"), "fix").when(s.rlike(r"(?i)\b(decide|choose|switch|migrate|replace|instead)\b"), "decision").otherwise("fact")
    kept = commits.where(~trivial & (conventional | signal | (F.length(body) >= 25)))
    return kept.withColumns({"memory_type": kind, "text": F.concat_ws("\n", s, F.nullif(body if letters is None else F.substring(body, 1, letters), F.lit("")))})


def drift_windows(diffs: DataFrame, size: int, overlap: int, most: int | None = 25) -> DataFrame:
    """A long diff in windows of fixed size; ``truncated`` counts those beyond ``most``, which a report names. None: all windows."""
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.length("diff") - overlap) / step)).cast("int")
    rows = diffs.withColumn("__n", n)
    most = 2**31 - 1 if most is None else most
    return rows.select("diff_id", F.explode(F.sequence(F.lit(0), F.least("__n", F.lit(most)) - 1)).alias("window"), F.greatest(F.col("__n") - most, F.lit(0)).alias("truncated"), "diff").select(
        "diff_id", "window", "truncated", F.substr("diff", F.col("window") * step + 1, F.lit(size)).alias("text")
    )


def overlaps(left: DataFrame, right: DataFrame, least: int) -> DataFrame:
    """Pairs ``(a, b, n)`` of sets that share ``least`` words or more: ``left(a, words)``, ``right(b, words)`` with distinct words.

    Words are ordered by how often they occur on both sides. Of two sets that share so many, the rarest word they
    share is not among the ``least - 1`` most frequent ones of either, so those are no keys of the join; what it
    finds is counted by whole sets.
    """
    each = lambda df, key: df.select(key, F.explode("words").alias("word"))
    count = lambda df: df.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    often = count(each(left, "a")).join(count(each(right, "b")).withColumnRenamed("n", "m"), "word").select("word", (F.col("n") + F.col("m")).alias("often"))
    rare = lambda df, key: (
        each(df, key).join(often, "word").withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("often"), "word"))).where(F.col("k") >= least).select(key, "word")
    )
    found = rare(left, "a").join(rare(right, "b"), "word").select("a", "b").distinct()
    shared = F.size(F.array_intersect("words", "others"))
    both = found.join(left, "a").join(right.withColumnRenamed("words", "others"), "b")
    return both.select("a", "b", shared.alias("n")).where(F.col("n") >= least)


def drift_matches(windows: DataFrame, constraints: DataFrame, least: int = 2) -> DataFrame:
    """Constraints that any window of a diff touches, each once: ``(diff_id, constraint_id, first_window, words)``.

    A window touches a constraint if they share ``least`` content words; ``words`` is the most that one
    window shares. They meet by their rarer words, see :func:`overlaps`.
    """
    left = windows.select(F.struct("diff_id", "window").alias("a"), content_words(F.col("text")).alias("words"))
    right = constraints.select(F.col("constraint_id").alias("b"), content_words(F.col("statement")).alias("words"))
    shared = overlaps(left, right, least)
    return shared.groupBy(F.col("a.diff_id").alias("diff_id"), F.col("b").alias("constraint_id")).agg(F.min("a.window").alias("first_window"), F.max("n").cast("long").alias("words"))


def flow_constraints(diagrams: DataFrame) -> DataFrame:
    """Sequence diagrams ``(diagram, text)`` as constraints ``(diagram, n, statement)``.

    An arrow gives "X SHALL send ... to Y", with participants by their aliases; a note counts if it forbids
    something. Inside an alt block the statement holds under the block's condition, which else changes.
    What stands in opt and loop blocks, and in alt blocks inside any of them, is left out; a box only groups.
    Blocks are matched by their depth: an ``end`` closes the last block that was opened at its depth, and one
    that has nothing to close is passed over.
    """
    lines = diagrams.select("diagram", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("line", F.trim("line")).where("line <> '' and line not like '\\%\\%%'")
    word = F.lower(F.regexp_extract("line", r"^(\w+)", 1))
    opens = F.when(word.isin("alt", "opt", "loop", "box"), word)
    is_end = F.col("line").rlike("(?i)^end$")
    w = Window.partitionBy("diagram").orderBy("n")
    upto, earlier = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    running = lambda c, frame=upto: F.coalesce(F.sum(c).over(frame), F.lit(0))
    rows = lines.withColumns({"opens": opens, "step": F.when(opens.isNotNull(), 1).when(is_end, -1).otherwise(0)}).withColumn("sum", running(F.col("step")))
    rows = rows.withColumn("low", F.least(F.lit(0), F.min("sum").over(upto))).withColumn("low_before", F.coalesce(F.lag("low").over(w), F.lit(0)))
    closes = (F.col("step") == -1) & (F.col("low") == F.col("low_before"))
    # the depth that a block has once it is open, and that it had when it is closed
    rows = rows.withColumns({"closes": closes, "level": F.when(F.col("opens").isNotNull(), F.col("sum") - F.col("low")).when(closes, F.col("sum") - F.col("low") + 1)})
    same = Window.partitionBy("diagram", "level").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    last_open = lambda c: F.when(F.col("closes"), F.last(F.when(F.col("opens").isNotNull(), c), ignorenulls=True).over(same))
    rows = rows.withColumn("shut", last_open(F.col("opens")))
    flow = lambda kind: kind.isNotNull() & (kind != "box")
    depth = running(F.when(flow(F.col("opens")), 1).when(flow(F.col("shut")), -1).otherwise(0), earlier)
    rows = rows.withColumn("bad", F.col("opens").isin("opt", "loop") | ((F.col("opens") == "alt") & (depth > 0)))
    rows = rows.withColumn("shut_bad", F.coalesce(last_open(F.col("bad")), F.lit(False)))
    hidden = lambda opened, shut: running(F.when(F.col("bad") & opened, 1).when(F.col("shut_bad") & shut, -1).otherwise(0))
    rows = rows.withColumns({"hidden": hidden(F.lit(True), F.lit(True)), "hidden_alts": hidden(F.col("opens") == "alt", F.col("shut") == "alt")})
    said = lambda default: F.coalesce(F.nullif(F.trim(F.regexp_replace("line", r"(?i)^(alt|else)\b", "")), F.lit("")), F.lit(default))
    event = F.when((F.col("opens") == "alt") & ~F.col("bad"), F.struct(said("the following condition").alias("c")))
    event = event.when((F.lower(F.regexp_extract("line", r"^(\w+)", 1)) == "else") & (F.col("hidden_alts") == 0), F.struct(said("otherwise").alias("c")))
    event = event.when((F.col("shut") == "alt") & ~F.col("shut_bad"), F.struct(F.lit(None).cast("string").alias("c")))
    rows = rows.withColumn("condition", F.last(event, ignorenulls=True).over(upto)["c"]).where("hidden = 0")
    part = r"(?i)^(?:participant|actor)\s+(\S+?)(?:\s+as\s+(.+))?$"
    named = rows.where(F.col("line").rlike(part)).select("diagram", "n", F.regexp_extract("line", part, 1).alias("id"), F.trim(F.regexp_extract("line", part, 2)).alias("alias"))
    names = named.groupBy("diagram", "id").agg(F.max_by("alias", "n").alias("alias")).where("alias <> ''")
    arrow = r"^([A-Za-z0-9_.]+)\s*(?:-->>|--x|--\)|->>|-->|-x|-\)|->)\s*[+-]?([A-Za-z0-9_.]+)[+-]?\s*:\s*(.+)$"
    note = r"(?i)^note\s+(?:over|left of|right of)\s+[^:]+:\s*(.+)$"
    sent = rows.where(F.col("line").rlike(arrow)).select("diagram", "n", "condition", *(F.regexp_extract("line", arrow, k).alias(c) for k, c in ((1, "a"), (2, "b"), (3, "label"))))
    alias = lambda c: names.select("diagram", F.col("id").alias(c), F.col("alias").alias(f"{c}_name"))
    sent = sent.join(alias("a"), ["diagram", "a"], "left").join(alias("b"), ["diagram", "b"], "left")
    shall = F.concat(F.coalesce("a_name", "a"), F.lit(' SHALL send "'), F.trim("label"), F.lit('" to '), F.coalesce("b_name", "b"), F.lit("."))
    text = F.trim(F.regexp_extract("line", note, 1))
    forbids = rows.where(F.col("line").rlike(note) & text.rlike(r"(?i)\b(must not|shall not|should not|may not)\b"))
    forbids = forbids.select("diagram", "n", "condition", F.when(text.rlike("[.!?]$"), text).otherwise(F.concat(text, F.lit("."))).alias("s"))
    both = sent.select("diagram", "n", "condition", shall.alias("s")).unionByName(forbids)
    return both.select("diagram", "n", F.when(F.col("condition").isNotNull(), F.concat(F.lit("When "), "condition", F.lit(", "), "s")).otherwise(F.col("s")).alias("statement"))
