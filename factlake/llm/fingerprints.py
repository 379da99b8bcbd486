"""Document fingerprints by consistent weighted sampling (operator 10), in DataFrame functions only.

A text is a bag of words, each with its count as weight. For each of the signature's places, every
word draws ``r`` and ``c`` from Gamma(2, 1) and ``b`` from (0, 1) by its hash, rounds its weight to
``y = exp(r (t - b))`` with ``t = floor(ln w / r + b)``, and takes ``a = c / (y exp(r))``; the word
and ``t`` of the least ``a`` are the sample. Two bags share a sample with a probability equal to their
generalised Jaccard similarity (sum of minima over sum of maxima of the weights).

The gamma variates are sums of two exponentials, drawn from 24 bits of hash each, all in generated code. A text
and its edited form share the draws of their words.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlake.llm.common import stored

#: Samples of a signature. A likeness has a standard error of at most 0.5 / sqrt(SAMPLES), here 0.0625.
SAMPLES = 64
#: Samples that one row draws: so few that generated code stays small enough to be compiled to machine code.
TOGETHER = 4
#: Documents of a stretch of ids that are put in order together, on the average.
STRETCH = 2000
#: Parts of a stretch of one id, as powers of two that make room in its number; and hot ids that are broadcast.
PARTS, BROADCAST_IDS = 1 << 20, 100_000
#: Stretches at most; beyond, they grow. Bounds the cuts in the plan and the rows that are ordered in one task.
MOST_STRETCHES = 65_536


def _draws(term: Column, place: Column) -> dict[str, Column]:
    """What a word draws at a place: a hash, and from it ``r``, ``ln c`` and ``b``."""
    g = F.xxhash64(term, place)
    h = F.xxhash64(g)
    # 24 bits from a place of a hash, inside (0, 1)
    u = lambda x, at: (F.shiftrightunsigned(x, at).bitwiseAND(F.lit(0xFFFFFF).cast("long")).cast("double") + 0.5) * (1.0 / (1 << 24))
    b = h.bitwiseAND(F.lit(0xFFFF).cast("long")).cast("double") * (1.0 / (1 << 16))
    return {"g": g, "r": -F.log(u(g, 40) * u(g, 16)), "c": F.log(-F.log(u(h, 40) * u(h, 16))), "b": b}


def _sample(g: Column, r: Column, log_c: Column, b: Column, log_weight: Column) -> Column:
    """``a`` in the upper 31 bits, in an order-keeping form, and a hash of the word and ``t`` in the lower 32."""
    t = F.floor(log_weight / r + b)
    log_a = log_c - r * (t - b + 1)
    ordered = F.least(F.greatest((log_a + 64.0) * float(1 << 24), F.lit(0.0)), F.lit(float((1 << 31) - 1))).cast("long")
    packed = F.shiftleft(ordered, 32).bitwiseOR(F.hash(g, t).cast("long").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    return F.when(log_weight.isNotNull(), packed)


def signatures(words: DataFrame, keys: list[str], names: Sequence[str] = ("fingerprint",), samples: int = SAMPLES) -> DataFrame:
    """``(*keys, *names)`` of ``words(*keys, side, term)``, with a row for each word as often as it stands in a text.

    ``term`` is a 64-bit hash of the word. The texts of a key, one for each of ``names``, are told apart
    by ``side``, the place of the name; they share their draws, as do the texts whose keys are equal but for the
    last: a word draws once for all of them. So the last key is to tell apart a bounded number of texts where there
    are several keys. A text without words gets null. All aggregations group by ``keys`` first; where ``words`` is
    partitioned by those before the last, nothing is shuffled.
    """
    sides, each = range(len(names)), range(min(TOGETHER, samples))
    # the logarithm of 0 is null: nothing is sampled there
    weights = [F.log(F.count_if(F.col("side") == k).cast("double")).alias(f"__w{k}") for k in sides]
    rows = words.groupBy(*keys, "term").agg(*weights)
    shared = len(keys) > 1
    if shared:
        rows = rows.groupBy(*keys[:-1], "term").agg(F.collect_list(F.struct(keys[-1], *(f"__w{k}" for k in sides))).alias("__texts"))
    rows = rows.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(-(-samples // len(each)) - 1))))
    for j in each:
        rows = rows.withColumns({f"__{k}{j}": v for k, v in _draws(F.col("term"), F.col("__block") * len(each) + j).items()})
    if shared:
        drawn = [c for c in rows.columns if c != "__texts"]
        rows = rows.select(*drawn, F.explode("__texts").alias("__t")).select(*drawn, "__t.*")
    sample = lambda k, j: _sample(*(F.col(f"__{x}{j}") for x in "grcb"), F.col(f"__w{k}"))
    least = rows.groupBy(*keys, "__block").agg(*(F.min(sample(k, j)).alias(f"__m{k}_{j}") for k in sides for j in each))
    low = lambda k, j: F.lpad(F.lower(F.hex(F.col(f"__m{k}_{j}").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))), 8, "0")
    part = lambda k: F.struct("__block", F.concat(*(low(k, j) for j in each)).alias("part"))
    parts = least.groupBy(*keys).agg(*(F.collect_list(part(k)).alias(f"__p{k}") for k in sides))
    whole = lambda k: F.substring(F.array_join(F.transform(F.array_sort(f"__p{k}"), lambda p: p.part), ""), 1, 8 * samples)
    return parts.select(*keys, *(F.when(F.element_at(f"__p{k}", 1).part.isNotNull(), whole(k)).alias(n) for k, n in enumerate(names)))


def words_of(text: Column) -> Column:
    """The words of a text, lower-cased, between white space; an empty text has one empty word."""
    return F.split(F.lower(text), r"\s+")


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of places at which two fingerprints agree: an estimate of the generalised Jaccard similarity."""
    same = lambda n, i: n + F.when(F.substr(a, i * 8 + 1, F.lit(8)) == F.substr(b, i * 8 + 1, F.lit(8)), 1).otherwise(0)
    return F.aggregate(F.sequence(F.lit(0), F.lit(samples - 1)), F.lit(0), same) / F.lit(float(samples))


def fingerprint(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """``(doc_id, fingerprint)`` of ``docs(doc_id, text)``: one row for each id.

    A null text counts as empty. Rows that share an id make up one bag of words; other columns are
    ignored. Equal bags have equal fingerprints. Texts are read whole; an empty table gives no rows.
    """
    words = docs.select("doc_id", F.explode(words_of(F.coalesce("text", F.lit("")))).alias("word"))
    return signatures(words.select("doc_id", F.lit(0).alias("side"), F.xxhash64("word").alias("term")), ["doc_id"], samples=samples)


def quantiles(docs: DataFrame, parts: int) -> list[int]:
    """The ids, each once and in order, that cut ``docs`` into about ``parts`` parts of as many rows."""
    if parts < 2:
        return []
    at = F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], max(10_000, 20 * parts))
    return sorted(set(docs.agg(at).first()[0] or []))


def stretch_of(doc_id: Column, cuts: list[int]) -> Column:
    """How many of ``cuts`` are not above an id, found by halving; -1 for a null id."""
    if not cuts:
        return F.when(doc_id.isNull(), F.lit(-1)).otherwise(F.lit(0)).cast("long")
    table = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")  # folded into a literal array
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))))
    up = lambda n, step: F.when((n + step <= len(cuts)) & (F.get(table, n + step - 1) <= doc_id), n + step).otherwise(n)
    return F.when(doc_id.isNull(), F.lit(-1)).otherwise(F.aggregate(steps, F.lit(0), up)).cast("long")


def edited_halves(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of all texts and of their edited forms, and how alike they are.

    For each row of ``docs(doc_id, text)``: ``(doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next)``. The edited text is the text with its last
    ``floor(n_chars / 2)`` code points replaced by the first as many (or all) of the next document in
    descending order of ``doc_id``; after the last comes the first. Rows that share an id follow one
    another by a hash of their texts; null ids come last. A null text counts as empty. A document that
    is alone is its own successor.

    Ids are cut into stretches at their quantiles, with some :data:`STRETCH` documents each, and an id (or null)
    that has many more is cut into parts by the hashes of its texts, which are their order. All that is done to a
    document happens in the partition of its part, so texts are shuffled once; the first document of each part is
    fetched for the last one of the part above. Rows that are equal in id and text stay together. Texts are read
    whole, however long; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    span = rows.agg(F.count("doc_id").alias("n"), F.min("doc_id").alias("low")).first()
    low = span["low"] or 0
    # at most as many hot ids as stretches; each is a stretch of its own
    many = max(2 * STRETCH, span["n"] // MOST_STRETCHES)
    hot = stored(rows.groupBy("doc_id").agg(F.least(F.ceil(F.count(F.lit(1)) / STRETCH), F.lit(PARTS)).alias("__parts"), F.count(F.lit(1)).alias("__n")).where(F.col("__n") > many).drop("__n"))
    own = [r["doc_id"] for r in hot.where("doc_id is not null").select("doc_id").collect()]
    cuts = sorted({*quantiles(rows, min(span["n"] // STRETCH, MOST_STRETCHES)), *own, *(i + 1 for i in own if i < (1 << 63) - 1)})
    rows = rows.withColumn("__stretch", stretch_of(F.col("doc_id"), cuts) * PARTS)
    n_hot = hot.limit(BROADCAST_IDS + 1).count()
    if n_hot:  # what an id has too many of is dealt by ranges of the hash that orders it
        hot = hot.withColumnRenamed("doc_id", "__hot")
        rows = rows.join(F.broadcast(hot) if n_hot <= BROADCAST_IDS else hot, F.col("doc_id").eqNullSafe(F.col("__hot")), "left")
        part = F.floor((F.xxhash64("text") / float(1 << 64) + 0.5) * F.col("__parts"))
        rows = rows.withColumn("__stretch", F.col("__stretch") + F.coalesce(F.least(part, F.col("__parts") - 1), F.lit(0))).select("doc_id", "text", "__stretch")
    # the first document of each stretch, as successor of the last one of the stretch above
    heads = rows.groupBy("__stretch").agg(F.max(F.struct(F.coalesce("doc_id", F.lit(low - 1)).alias("id"), F.xxhash64("text").alias("h"))).alias("head"))
    down, top = Window.orderBy(F.desc("__stretch")), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = stored(heads.select("__stretch", "head.id", "head.h"))  # one row for some STRETCH documents
    heads = heads.withColumn("__above", F.coalesce(F.lag("__stretch").over(down), F.min("__stretch").over(top)))
    texts = rows.select("__stretch", F.coalesce("doc_id", F.lit(low - 1)).alias("id"), F.xxhash64("text").alias("h"), "text")
    heads = texts.join(heads, ["__stretch", "id", "h"]).groupBy("__above", "__stretch").agg(F.first("text").alias("__head"))
    heads = stored(heads.select(F.col("__above").alias("__stretch"), F.col("__stretch").alias("__below"), "__head"))

    order = Window.partitionBy("__stretch").orderBy(F.desc_nulls_last("doc_id"), F.desc(F.xxhash64("text")))
    placed = rows.select("*", F.row_number().over(order).alias("__at"), F.lead("text").over(order).alias("__lead"))
    placed = placed.join(heads, "__stretch")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr(F.coalesce("__lead", "__head"), F.lit(1), half))
    placed = placed.withColumn("__edited", edited)

    halves = F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("t")), F.struct(F.lit(1).alias("side"), F.col("__edited").alias("t")))
    both = placed.select("__stretch", "__at", F.explode(halves).alias("x"))
    words = both.select("__stretch", "__at", F.col("x.side").alias("side"), F.explode(words_of(F.col("x.t"))).alias("word"))
    words = words.select("__stretch", "__at", "side", F.xxhash64("word").alias("term"))
    signed = signatures(words, ["__stretch", "__at"], ["fingerprint", "edited_fingerprint"], samples)
    signed = signed.withColumns({c: F.unhex(c) for c in ("fingerprint", "edited_fingerprint")})  # half as wide on the way
    facts = placed.select(
        "__stretch", "__at", "doc_id", n.cast("long").alias("n_chars"), F.unhex(F.sha2(F.col("__edited").cast("binary"), 256)).alias("edited_sha256"),
        F.when(F.col("__lead").isNull(), F.col("__below")).otherwise(F.col("__stretch")).alias("__next_stretch"),
        F.when(F.col("__lead").isNull(), F.lit(1)).otherwise(F.col("__at") + 1).alias("__next_at"),
    )
    found = stored(facts.join(signed, ["__stretch", "__at"]))
    following = found.select(F.col("__stretch").alias("__next_stretch"), F.col("__at").alias("__next_at"), F.col("fingerprint").alias("__next"))
    both = found.join(following, ["__next_stretch", "__next_at"])
    both = both.withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint", "__next")})
    return both.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"), likeness(F.col("fingerprint"), F.col("__next"), samples).alias("near_next"),
    )
