"""Secret scans (operator 1), in DataFrame functions only.

Three fixed patterns give the base spans. Beside them, character Markov models of random strings and
of ordinary identifiers are compared: a token whose transitions are much likelier under the first is a
span as well. The models are tables of letter pairs counted by Spark over labelled samples; the table
of log ratios has a bounded size (alphabet squared) and is applied as a literal array.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.llm.common import carried, restored

#: Patterns of the base spans, with the group and the length that make a match count.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a match of AKIA[A-Z0-9]+ is a whole run, so its length can be asked for here
HEX = r"[0-9a-f]{24,}"  # likewise
KINDS = ("assign", "access", "hex", "random")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: What the models judge: tokens of the alphabet from this length on; and the log-likelihood ratio that makes them
#: spans, in all and for each pair of letters.
LEAST, THRESHOLD, EACH = 12, 12.0, 1.8
#: How many pairs the kinds of letters count as beside a letter's own pairs, and a letter's share of its kind as.
BY_KIND, BY_LETTER = 1000.0, 50.0
#: Matches of a text that are walked together.
STEP = 256


def _found(text: Column, pattern: str, group: int | None = None, least: int = 1) -> Column:
    """All leftmost matches of ``pattern``: array of ``(begin, end, ok, token)``, in code points.

    ``split`` gives what lies between the matches, so a match begins after the gaps and matches so far.
    """
    p = F.lit(pattern)
    hits, gaps = F.regexp_extract_all(text, p, F.lit(0)), F.split(text, pattern, -1)
    checked = F.regexp_extract_all(text, p, F.lit(group)) if group is not None else hits
    kind = "array<struct<begin:int,end:int,ok:boolean,token:string>>"
    empty = F.array().cast(kind)
    zipped = F.arrays_zip(hits.alias("hit"), checked.alias("checked"), F.slice(gaps, 1, F.size(hits)).alias("gap"))
    one = lambda at, x: F.struct(
        (at + F.length(x["gap"])).alias("begin"), (at + F.length(x["gap"]) + F.length(x["hit"])).alias("end"), (F.length(x["checked"]) >= least).alias("ok"), x["hit"].alias("token")
    )
    # arrays grow by copying, so a step's matches are put together by themselves and then added as a whole
    some = lambda start, part: F.aggregate(
        part, start, lambda acc, x: F.struct((acc.at + F.length(x["gap"]) + F.length(x["hit"])).alias("at"), F.concat(acc.found, F.array(one(acc.at, x))).alias("found"))
    )
    walked = F.aggregate(
        F.sequence(F.lit(0), F.floor((F.size(hits) - 1) / STEP).cast("int")),
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), empty.alias("found")),
        lambda acc, k: F.aggregate(
            F.array(some(F.struct(acc.at.alias("at"), empty.alias("found")), F.slice(zipped, k * STEP + 1, STEP))),
            acc,
            lambda acc, own: F.struct(own.at.alias("at"), F.lit(0).alias("n"), F.concat(acc.found, F.filter(own.found, lambda m: m.ok)).alias("found")),
        ),
        lambda acc: acc.found,
    )
    return F.when(F.regexp_like(text, p), walked).otherwise(empty)


def base_matches(docs: DataFrame) -> DataFrame:
    """Add the arrays ``assign``, ``access`` and ``hex`` to ``docs(…, text)``."""
    text = F.col("text")
    return docs.select("*", _found(text, ASSIGN, 2, 6).alias("assign"), _found(text, ACCESS).alias("access"), _found(text, HEX).alias("hex"))


def _pairs(tokens: DataFrame) -> DataFrame:
    """Counts of letter pairs of ``tokens(token, random)``."""
    at = F.explode(F.sequence(F.lit(1), F.length("token") - 1)).alias("at")
    letters = tokens.where(F.length("token") > 1).select("random", "token", at)
    return letters.select("random", F.substr("token", F.col("at"), F.lit(2)).alias("pair")).groupBy("random", "pair").agg(F.count(F.lit(1)).alias("n"))


def log_ratios(docs: DataFrame, documents: int = 3000, random_strings: int = 4000) -> list[float]:
    """``ln P(b | a, random) - ln P(b | a, ordinary)`` for all pairs of the alphabet, row by row.

    The labelled samples are bounded at every size of the corpus: about ``documents`` documents drawn
    by hash, whose base matches are labelled random and whose other tokens, by themselves and joined to
    identifiers, are labelled ordinary, and ``random_strings`` digests in hexadecimal and base64, labelled random.
    """
    spark = docs.sparkSession
    n = docs.count()
    drawn = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int(min(1.0, documents / max(n, 1)) * (1 << 40)))
    drawn = base_matches(drawn.select(F.coalesce("text", F.lit("")).alias("text")))
    hits = F.flatten(F.array(F.col("access"), F.col("hex")))
    random = drawn.select(F.explode(hits).alias("hit")).select(F.col("hit.token").alias("token"))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    ordinary = drawn.select(F.explode(F.regexp_extract_all(rest, F.lit("[A-Za-z0-9+/_=-]{2,}"), F.lit(0))).alias("token"))
    # identifiers join words by capitals and underscores
    joins = [F.col("token"), F.concat(F.lower("token"), F.initcap("token")), F.concat(F.upper("token"), F.lit("_"), F.upper("token"))]
    ordinary = ordinary.select(F.explode(F.array(*joins)).alias("token"))
    digest = F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 256)
    made = spark.range(random_strings).select(F.explode(F.array(F.base64(F.unhex(digest)), F.substring(digest, 1, 40), F.upper(F.substring(F.base64(F.unhex(digest)), 1, 24)))).alias("token"))
    labelled = random.unionAll(made).withColumn("random", F.lit(True)).unionAll(ordinary.withColumn("random", F.lit(False)))
    counts = {(r["random"], r["pair"]): r["n"] for r in _pairs(labelled).collect()}
    return table_of(counts)


def _kind(letter: str) -> int:
    return 0 if letter.isupper() else 1 if letter.islower() else 2 if letter.isdigit() else 3


def table_of(counts: Mapping[tuple[bool, str], int]) -> list[float]:
    """The log ratios from counts of ``(random, pair)``.

    What a model knows of a letter's successors is smoothed by what it knows of kinds of letters: how often
    capitals, small letters and digits follow one another, and each letter's share of its kind. So a pair that
    neither sample has tells about as much as its kinds do, and a foreign word stays a word. Pairs with one of
    ``+/_=-`` tell nothing: paths and joined names are judged by their parts.
    """
    kinds = [_kind(a) for a in ALPHABET]
    chance: dict[tuple[bool, str, str], float] = {}
    for random in (True, False):
        pair = lambda a, b: counts.get((random, a + b), 0)
        single = {b: sum(pair(a, b) for a in ALPHABET) + BY_LETTER for b in ALPHABET}
        of_kind = [sum(single[b] for b in ALPHABET if _kind(b) == k) for k in range(4)]
        follows = [[1.0 + sum(pair(a, b) for a in ALPHABET if _kind(a) == j for b in ALPHABET if _kind(b) == k) for k in range(4)] for j in range(4)]
        for a, j in zip(ALPHABET, kinds):
            after = sum(pair(a, b) for b in ALPHABET)
            for b, k in zip(ALPHABET, kinds):
                back = follows[j][k] / sum(follows[j]) * single[b] / of_kind[k]
                chance[random, a, b] = (pair(a, b) + BY_KIND * back) / (after + BY_KIND)
    return [0.0 if 3 in (j, k) else math.log(chance[True, a, b] / chance[False, a, b]) for a, j in zip(ALPHABET, kinds) for b, k in zip(ALPHABET, kinds)]


def scan_secrets(docs: DataFrame, ratios: list[float], threshold: float = THRESHOLD, keep: Sequence[str] = ("doc_id",), least: int = LEAST, each: float = EACH) -> DataFrame:
    """``(*keep, text, spans)`` of every row of ``docs(*keep, text)``.

    ``spans`` is an array of ``(begin, end, kind)`` in code points with the end exclusive, by begin and
    then kind in the order of :data:`KINDS`. Base spans are always there; a token that touches one is
    not judged again. A token of at least ``least`` letters (1 or more) is ``random`` when its
    log-likelihood ratio, summed over its different letter pairs (so that runs and rules don't add up), is
    at least ``threshold`` and at least ``each`` for each letter after the first. A null text counts as
    empty: no spans. Texts are read whole, however long. Repeated rows give repeated results; an empty table
    gives no rows. Kept columns may have any name, but ``text`` and ``spans`` are the results.
    """
    table = F.array(*map(F.lit, ratios))
    rows = base_matches(carried(docs, keep, F.coalesce("text", F.lit("")).alias("text")))

    def judged(token: Column) -> Column:
        n = len(ALPHABET)
        place = lambda i: F.instr(F.lit(ALPHABET), F.substr(token, i, F.lit(1)))
        pairs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(token) - 1), lambda i: (place(i) - 1) * n + place(i + 1)))
        return F.aggregate(pairs, F.lit(0.0), lambda acc, i: acc + F.element_at(table, i))

    base = F.concat("assign", "access", "hex")
    free = lambda m: ~F.exists(base, lambda b: (b.begin < m.end) & (m.begin < b.end))
    candidate = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{least},}}+"
    rows = rows.withColumn("candidates", _found(F.col("text"), candidate))
    likely = F.filter("candidates", lambda m: free(m) & (judged(m.token) >= F.greatest(F.lit(threshold), each * (F.length(m.token) - 1))))
    likely = F.when(F.size("candidates") > 0, likely).otherwise(F.col("candidates"))
    ranked = lambda c, k: F.transform(c, lambda m: F.struct(m.begin.alias("begin"), F.lit(k).alias("rank"), m.end.alias("end")))
    named = [ranked(c, k) for k, c in enumerate((F.col("assign"), F.col("access"), F.col("hex"), likely))]
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1)
    spans = F.transform(F.array_sort(F.concat(*named)), lambda s: F.struct(s.begin.alias("begin"), s.end.alias("end"), kind(s).alias("kind")))
    return restored(rows.select("kept", "text", spans.alias("spans")))


def joined(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.begin.cast("string"), s.end.cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each stretch that spans cover replaced by ``[REDACTED]``; spans as of :func:`scan_secrets`."""
    cut = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc.at, s.end).alias("at"),
            F.when(s.begin >= acc.at, F.concat(acc.out, F.substr(text, acc.at + 1, s.begin - acc.at), F.lit("[REDACTED]"))).otherwise(acc.out).alias("out"),
        ),
        lambda acc: F.concat(acc.out, F.substr(text, acc.at + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, cut).otherwise(text)
