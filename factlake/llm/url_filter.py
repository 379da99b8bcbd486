"""URL filters: rules by host and path, and a Bloom filter cascade (operator 8), in DataFrame functions only.

The cascade answers "is this key listed?" exactly for every key of the corpus. Its first level encodes
the listed keys; the next encodes those other keys that the first lets through by mistake; the next
those listed keys that the second lets through, and so on until a level makes no mistake. A page walks
the levels in literal bit arrays, so pages are never joined with a list. Levels that are too long for the
plan are cut by hash into a cascade for each shard of the keys, and keys meet the bits of their shard.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.llm.common import stored

#: (host, path, verdict); a rule fits its host and all subdomains where the path starts with the rule's.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Listed domains; subdomains are listed with them.
LISTED = tuple(f"{name}.example.{end}" for name in ("casino-win", "free-bets", "cheap-pills", "ads-track", "spam-farm", "adult-x") for end in ("com", "net", "org"))
#: Bits that all levels together may take in the plan, or in a shard (4 MB).
MOST_BITS = 1 << 25


def host_of(url: Column) -> Column:
    """From after the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return _lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def _lower(host: Column) -> Column:
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From after the host to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise("")


def suffixes(host: Column) -> Column:
    """The host and its parent domains, all of them."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    words: str  # the 64-bit words, joined by commas

    def holds(self, key: Column, number: int) -> Column:
        """Whether the level, the ``number``-th of the cascade, lets ``key`` through."""
        words = F.split(F.lit(self.words), ",").cast("array<bigint>")  # folded into a literal array
        found = F.lit(True)
        for place in self.places(key, number):
            word = F.element_at(words, (F.floor(place / 64) + 1).cast("int"))
            found = found & (F.call_function("bit_get", word, (place % 64).cast("int")) == 1)
        return found

    def places(self, key: Column, number: int) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(number * 16 + j)), F.lit(self.bits)) for j in range(self.hashes)]


def _bits_a_key(number: int) -> int:
    return 8 if number == 0 else 2


def _hashes(number: int) -> int:
    return 4 if number == 0 else 1


def _level(keys: DataFrame, n: int, number: int) -> Level:
    """A level that encodes the ``n`` rows of ``keys(key)``. Its words are or-ed together by Spark."""
    bits, hashes = max(64, -(-_bits_a_key(number) * n // 64) * 64), _hashes(number)
    blank = Level(bits, hashes, "")
    places = keys.select(F.explode(F.array(*blank.places(F.col("key"), number))).alias("place"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("place") % 64).cast("int"))
    words = places.groupBy(F.floor(F.col("place") / 64).alias("word")).agg(F.bit_or(one).alias("mask"))
    masks = {r["word"]: r["mask"] for r in words.collect()}  # bits / 64 rows at most
    return Level(bits, hashes, ",".join(str(masks.get(i, 0)) for i in range(bits // 64)))


def build_cascade(universe: DataFrame) -> list[Level] | None:
    """The levels for ``universe(key, listed)``, all keys once; None if they would take too many bits."""
    levels: list[Level] = []
    alive = universe
    while True:
        encoded = len(levels) % 2 == 0
        own = alive.where(F.col("listed") == encoded)
        n = own.count()
        if not n:
            return levels
        if sum(x.bits for x in levels) + 8 * n > MOST_BITS:
            return None
        levels.append(_level(own, n, len(levels)))
        # those that should not be let through and are
        alive = alive.where((F.col("listed") == encoded) | levels[-1].holds(F.col("key"), len(levels) - 1))


def in_cascade(levels: Sequence[Level], key: Column) -> Column:
    """Whether a key of the universe is listed: the first level that stops it decides."""
    answer = F.lit(len(levels) % 2 == 1)
    for number in range(len(levels) - 1, -1, -1):
        answer = F.when(levels[number].holds(key, number), answer).otherwise(F.lit(number % 2 == 1))
    return answer


def build_shards(universe: DataFrame) -> tuple[DataFrame, int]:
    """Cascades for ``universe(key, listed)``, all keys once: ``(shard, levels)`` and the number of shards.

    ``levels`` is an array of ``(number, bits, words)``; a shard whose keys are all unlisted has no row.
    """
    shards = max(1, -(-_bits_a_key(0) * universe.where("listed").count() // MOST_BITS))
    alive = stored(universe.withColumn("shard", _shard(F.col("key"), shards)))
    tables, number = [], 0
    while True:
        own = alive.where(F.col("listed") == (number % 2 == 0))
        if own.isEmpty():
            break
        sizes = own.groupBy("shard").agg((F.ceil(F.count(F.lit(1)) * _bits_a_key(number) / 64) * 64).cast("long").alias("bits"))
        sizes = stored(sizes)
        places = [F.pmod(F.xxhash64("key", F.lit(number * 16 + j)), F.col("bits")) for j in range(_hashes(number))]
        set_bits = own.join(sizes, "shard").select("shard", F.explode(F.array(*places)).alias("place"))
        one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("place") % 64).cast("int"))
        masks = set_bits.groupBy("shard", F.floor(F.col("place") / 64).alias("word")).agg(F.bit_or(one).alias("mask"))
        blank = sizes.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("bits") / 64).cast("long") - 1)).alias("word"))
        words = blank.join(masks, ["shard", "word"], "left").groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("word", F.coalesce("mask", F.lit(0).cast("long")).alias("mask")))).alias("w"))
        level = words.join(sizes, "shard").select("shard", F.lit(number).alias("number"), "bits", F.transform("w", lambda x: x.mask).alias("words"))
        tables.append(stored(level))
        walked = alive.join(tables[-1], "shard").withColumn("through", _holds(F.struct("number", "bits", "words"), F.col("key")))
        alive = stored(walked.where((F.col("listed") == (number % 2 == 0)) | F.col("through")).select("key", "listed", "shard"))
        number += 1
    if not tables:
        return universe.select(F.lit(0).cast("long").alias("shard"), F.array().cast("array<struct<number:int,bits:bigint,words:array<bigint>>>").alias("levels")).limit(0), shards
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t)
    return stored(rows.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("number", "bits", "words"))).alias("levels"))), shards


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(shards))


def _holds(level: Column, key: Column) -> Column:
    """Whether a level ``(number, bits, words)`` lets ``key`` through."""

    def bit(j: Column) -> Column:
        place = F.pmod(F.xxhash64(key, level["number"] * 16 + j), level["bits"])
        return F.call_function("bit_get", F.element_at(level["words"], (F.floor(place / 64) + 1).cast("int")), (place % 64).cast("int")) == 1

    return F.forall(F.sequence(F.lit(0), F.when(level["number"] == 0, _hashes(0) - 1).otherwise(_hashes(1) - 1)), bit)


def in_shards(keys: DataFrame, cascades: DataFrame, shards: int) -> DataFrame:
    """Those of ``keys(key, …)``, all of the universe, that are listed: the first level of their shard that stops one decides."""
    walked = keys.withColumn("shard", _shard(F.col("key"), shards)).join(cascades, "shard")
    stop = F.array_position(F.transform("levels", lambda level: _holds(level, F.col("key"))), False)
    return walked.where(F.when(stop > 0, stop % 2 == 0).otherwise(F.size("levels") % 2 == 1)).select(*keys.columns)


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, listed: DataFrame | Sequence[str] = LISTED) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` of every row of ``pages(page_id, url)``.

    The longest rule that fits decides (``rule`` is its host and path); where none fits ``rule`` is null
    and the verdict is ``block`` if the host or a parent domain is listed, else ``allow``. ``listed`` is a
    sequence of domains or a table with a column ``key``, of any size. A url that is null or has no
    ``://`` has an empty host and path. Urls are read whole, however long. Repeated rows give repeated
    results; other columns are ignored; an empty table gives no rows.
    """
    if not isinstance(listed, DataFrame):  # made in the JVM
        listed = pages.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, listed)).cast("array<string>")).alias("key"))
    listed = listed.where("key is not null").select(_lower(F.col("key")).alias("key")).distinct().withColumn("listed", F.lit(True))
    found = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    found = found.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})
    hosts = found.select("host").distinct()
    keys = hosts.select(F.explode(suffixes(F.col("host"))).alias("key")).distinct()
    universe = stored(keys.join(listed, "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed")))
    levels = build_cascade(universe)
    if levels is not None:
        blocked = F.exists(suffixes(F.col("host")), lambda k: in_cascade(levels, k)) if levels else F.lit(False)
        found = found.withColumn("__listed", blocked)
    else:  # hosts ask the shards, and pages their hosts
        flags = in_shards(hosts.select("host", F.explode(suffixes(F.col("host"))).alias("key")), *build_shards(universe)).select("host").distinct()
        found = found.join(stored(flags).withColumn("__listed", F.lit(True)), "host", "left").withColumn("__listed", F.coalesce("__listed", F.lit(False)))
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("__listed"), "block").otherwise("allow")
    for host, path, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return found.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


_LISTED_SQL = ", ".join(f"('{k}')" for k in LISTED)
#: The same result in DuckDB: rules and listed domains by comparison.
ORACLE = rf"""
WITH cut AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), parsed AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM parsed
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN EXISTS (SELECT 1 FROM (VALUES {_LISTED_SQL}) l(key) WHERE host = key OR ends_with(host, '.' || key)) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
