"""Exact similarity join on sets of word n-grams, and the groups that its links form (operator 4).

Documents with equal sets form a class, and classes are joined. Candidates come from *size-banded
tiles*: band ``b`` of sizes meets itself and band ``b + 1``, sets that can link lie in one such tile,
and within a tile two sets of at most ``d`` differing elements, cut into more than ``d`` segments by
hash range, have the other segments in common. Classes that share a segment, the most frequent ones
aside, form a *cluster*.
Inside clusters, blocks of bounded size ordered by set size are compared: *hashed bitmap signatures*
bound each overlap from above by bit counts, and pairs that pass are settled by intersecting sorted
arrays. Pairs that are already connected are skipped, so a group of near copies takes about as many
exact comparisons as it has members.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factlake.llm.common import connected_components, short_batches, sorted_groups, stored

#: Texts that are hashed together at most, and bytes of them.
TOGETHER, TOGETHER_BYTES = 64, 500_000
#: Classes in a block of a cluster.
BLOCK = 512
#: N-grams in a block at most, on the average.
BLOCK_ELEMENTS = 1_000_000
#: Words of 64 bits in a bitmap signature.
BITMAP = 16
#: Ids up to this many are broadcast to fetch the texts of clustered classes; more are joined by shuffle.
BROADCAST_IDS = 200_000

#: Classes, about, among which hot keys are looked for, and how many of these there may be.
HOT_SAMPLE, HOT_KEYS = 6_000, 2_000
#: Tasks that a hot key is dealt to.
SALTS = 32

#: ASCII white space; masks that keep the first bytes of a lane of eight; words of more lanes than this are hashed one by one.
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
LANES = 16
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def _word_values(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of UTF-8 bytes begin, and a hash of each: A-Z in lower case, words between ASCII blanks.

    Lanes of eight bytes are scrambled into the hashes one after the other, for all words that reach so far at
    once; long words are hashed by themselves.
    """
    raw = raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)
    inside = np.concatenate([[False], ~_BLANK[raw], [False]])
    begin, end = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    lanes = np.lib.stride_tricks.sliding_window_view(padded, 8)
    size = end - begin
    value = _mix(size.astype(np.uint64) + _M3)
    left = np.flatnonzero(size <= 8 * LANES)
    for k in range(LANES):
        lane = lanes[begin[left] + 8 * k].view(np.uint64)[:, 0] & _FIRST[np.minimum(size[left] - 8 * k, 8)]
        value[left] = _mix(value[left] * _M1 + lane)
        left = left[size[left] > 8 * (k + 1)]
        if not len(left):
            break
    for i in np.flatnonzero(size > 8 * LANES).tolist():
        value[i] = xxhash.xxh3_64_intdigest(raw[begin[i] : end[i]].tobytes())
    return begin, value


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct 64-bit hashes of word n-grams; of the whole if it has fewer words. A null has none.

    Texts are hashed some together, by numpy alone, so that nothing is remembered from one to the next.
    """
    for at in range(0, len(texts), TOGETHER):
        some = [(t.as_buffer() if t.is_valid else None) for t in texts.slice(at, TOGETHER).cast(pa.large_binary())]
        few: list = []
        for k, t in enumerate(some):
            few.append(t)
            if k + 1 == len(some) or sum(x.size for x in few if x) > TOGETHER_BYTES:
                yield from _sets_of(few, width)
                few = []


def _sets_of(texts: list, width: int) -> Iterator[np.ndarray]:
    sizes = np.array([(t.size if t else 0) + 1 for t in texts])  # a blank ends each text
    raw = np.frombuffer(b" ".join([t.to_pybytes() if t else b"" for t in texts]) + b" ", np.uint8)
    begin, h = _word_values(raw)
    edges = np.searchsorted(begin, np.concatenate([[0], np.cumsum(sizes)]))
    grams = np.full(max(0, len(h) - width + 1), width, np.uint64)
    for i in range(width):
        grams = _mix(grams * _M1 + h[i : i + len(grams)])
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if high - low >= width:
            yield np.unique(grams[low : high - width + 1])
        else:
            x = np.full(min(1, high - low), high - low, np.uint64)
            for i in range(low, high):
                x = _mix(x * _M1 + h[i : i + 1])
            yield x


def most_differing(size: int, share: int) -> int:
    """The most elements by which two linked sets differ, when the smaller has ``size``.

    With a, b the sizes, c the common part: ``100 c >= share (a + b - c)``, so
    ``a + b - 2 c <= (a + b) (100 - share) / (100 + share)``, and ``b <= 100 a / share``.
    """
    return (size + size * 100 // share) * (100 - share) // (100 + share)


def band_of(size: int, share: int) -> int:
    """Bands of sizes such that a set links only within its band and the neighbouring ones."""
    band, low = 0, 1
    while low <= size:
        low = low * 100 // share + 1
        band += 1
    return band - 1


def band_top(band: int, share: int) -> int:
    low = 1
    for _ in range(band + 1):
        low = low * 100 // share + 1
    return low - 1


@functools.lru_cache(maxsize=4096)
def _segments(band: int, share: int) -> tuple[int, int]:
    """How many segments a tile's sets are cut into, and how many of them two linked sets have in common at least."""
    d = most_differing(band_top(band, share), share)
    if not d:
        return 0, 0
    low = band_top(band - 1, share) + 1 if band else 1
    common = 2
    for _ in range(12):  # room for the segments that are likely to be empty, and for frequent ones
        empty = (d + common) * math.exp(-low / (d + common))
        common = 2 + math.ceil(empty + 4 * math.sqrt(empty) + d / 12)
        common = min(common, 3 * d + 8)
    return d + common, common


def signatures(sh: np.ndarray, share: int) -> tuple[list[int], list[int]]:
    """Keys of which two linked, unequal sets have at least one in common, also after each set has left
    out some of its most frequent ones; and for each key its lot.

    A lot is a tile times 4096 plus how many of its keys may be left out. Two linked sets have ``common``
    segments alike. Let every set leave out ``common - 1`` segments, the most frequent first by one order
    for all: the least frequent one that two sets have in common stays in both. Empty segments count as
    the most frequent ones and give no key; where a set has ``common`` of them or more, each choice of
    ``common`` gives a key, which is never left out.
    """
    keys: list[int] = []
    lots: list[int] = []
    own = band_of(len(sh), share)
    for tile in (own - 1, own):
        n, common = _segments(tile, share) if tile >= 0 else (0, 0)
        if not n:
            continue
        # top 32 bits scaled to a segment: ranges of the sorted hashes
        at = np.searchsorted(((sh >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32), np.arange(n + 1, dtype=np.uint64))
        full = np.flatnonzero(at[1:] > at[:-1])
        sums = np.add.reduceat(_mix(sh * _M3), at[full])
        keys += _mix(sums * _M1 + _mix(np.full(1, tile, np.uint64) * _M2 + full.astype(np.uint64))).astype(np.int64).tolist()
        empty = np.flatnonzero(at[1:] == at[:-1]).tolist()
        lots += [tile * 4096 + max(0, min(4095, common - 1 - len(empty)))] * len(full)
        if len(empty) >= common:
            chosen = [hash_of(tile, *some) for some in combinations(empty, common)]
            keys += chosen
            lots += [-1] * len(chosen)
    return keys, lots


def hash_of(*numbers: int) -> int:
    return xxhash.xxh3_64_intdigest(",".join(map(str, numbers)).encode()) - 2**63


def bitmap(sh: np.ndarray) -> np.ndarray:
    """A bitmap with one hashed bit for each element."""
    bits = np.zeros(64 * BITMAP, np.uint8)
    bits[(sh & np.uint64(64 * BITMAP - 1)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.uint64)


class _Union:
    """Labels of a block's members, joined as links are found."""

    def __init__(self, labels: np.ndarray):
        self.label = np.unique(labels, return_inverse=True)[1]

    def join(self, i: int, j: int) -> None:
        self.label[self.label == self.label[j]] = self.label[i]


def spanning_links(sizes: np.ndarray, maps: np.ndarray, sets: list[np.ndarray], labels: np.ndarray, first: int, share: int) -> list[tuple[int, int]]:
    """Links that connect all that links among the members connect, as pairs of places.

    Members before ``first`` are compared with those from ``first`` on, and with one another only if
    ``first`` is 0. Members of equal label count as connected.
    """
    found, union = [], _Union(labels)
    n = len(sizes)
    for i in range(first or n):
        rest = np.arange(max(first, i + 1), n)
        rest = rest[union.label[rest] != union.label[i]]
        a, b = sizes[i], sizes[rest]
        rest = rest[(100 * np.minimum(a, b) >= share * np.maximum(a, b))]
        if not len(rest):
            continue
        b = sizes[rest]
        # an element of one set whose bit the other lacks is not common
        over = np.minimum(
            a - np.bitwise_count(maps[i] & ~maps[rest]).sum(axis=1, dtype=np.int64), b - np.bitwise_count(maps[rest] & ~maps[i]).sum(axis=1, dtype=np.int64)
        )
        rest = rest[100 * over >= share * (a + b - over)]
        for j in rest.tolist():
            if union.label[i] != union.label[j]:
                c = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * c >= share * (len(sets[i]) + len(sets[j]) - c):
                    found.append((i, j))
                    union.join(i, j)
    return found


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of a few documents, so that what is made of them stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        pa.default_memory_pool().release_unused()


def _without(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """The ``rows`` that are not among ``copies(doc_id, print)``, which are broadcast if they are few."""
    few = copies.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(copies) if few else copies, ["doc_id", "print"], "left_anti")


def _hot_keys(rows: DataFrame, n: int, width: int, share: int) -> np.ndarray:
    """Keys that so many of the ``n`` classes have that they should not meet in one task, in order.

    They are those of a thousandth of about :data:`HOT_SAMPLE` classes drawn by hash, at most
    :data:`HOT_KEYS`. What a sample misses or adds changes how the work is dealt out, never the result.
    """
    drawn = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int(min(1.0, HOT_SAMPLE / max(n, 1)) * (1 << 40)))
    often = _keyed(drawn, width, share, np.empty(0, np.int64)).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    found = often.where(F.col("n") > HOT_SAMPLE / 1000).orderBy(F.desc("n"), "key").limit(HOT_KEYS)
    return np.array(sorted(r["key"] for r in found.collect()), np.int64)


def _keyed(rows: DataFrame, width: int, share: int, hot: np.ndarray) -> DataFrame:
    """``(key, cls, lot, salt)`` of all keys of ``rows``; the salt is -1 but for keys among ``hot``."""

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            found, lots, n = [np.empty(0, np.int64)], [np.empty(0, np.int32)], []
            for sh in shingle_sets(batch.column(1), width):
                own = signatures(sh, share) if len(sh) else ([], [])
                found.append(np.array(own[0], np.int64))
                lots.append(np.array(own[1], np.int32))
                n.append(len(own[0]))
            key, cls = np.concatenate(found), np.repeat(np.array(batch.column(0), np.int64), n)
            salt = np.full(len(key), -1, np.int32)
            if len(hot):
                at = np.flatnonzero(hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key)
                salt[at] = _mix(cls[at].astype(np.uint64)) % np.uint64(SALTS)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(cls), pa.array(np.concatenate(lots)), pa.array(salt)], ["key", "cls", "lot", "salt"])

    return rows.select("doc_id", "text").mapInArrow(keys_of, "key long, cls long, lot int, salt int")


def _candidates(rows: DataFrame, n: int, width: int, share: int) -> DataFrame:
    """Edges ``(a, b)`` from each class to the smallest class that shares a key with it.

    ``rows`` holds one document of each of the ``n`` classes, which names it. The keys are dealt out once,
    hot ones over :data:`SALTS` tasks; both sides of the join read that exchange. Keys of a single class,
    by far the most, end in the aggregation. Of the others each class leaves out as many of the most
    frequent as :func:`signatures` allows, so that passages that many documents share do not tie them together.
    """
    keyed = _keyed(rows, width, share, _hot_keys(rows, n, width, share)).where("key is not null and salt is not null").repartition("key", "salt")
    # all columns are asked for, and hot keys are told by an aggregate, so that all readers need the same exchange
    parts = keyed.groupBy("key", "salt").agg(
        F.count(F.lit(1)).alias("n"), F.min("cls").alias("low"), F.max("cls").alias("high"), F.max("lot").alias("top"), F.max("salt").alias("hot")
    )
    parts = parts.where("top is not null")
    hot = parts.where("hot >= 0").groupBy("key").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    hot = hot.where("low < high").select("key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), "n")
    often = parts.where("hot < 0 and low < high").select("key", "salt", "n").unionAll(hot)
    shared = keyed.join(often.hint("shuffle_hash"), ["key", "salt"])
    rank = F.row_number().over(Window.partitionBy("cls", "lot").orderBy(F.desc("n"), "key"))
    kept = stored(shared.withColumn("rank", rank).where("lot < 0 or rank > lot % 4096").select("key", "cls"))
    low = stored(kept.groupBy("key").agg(F.min("cls").alias("low")))  # a scan, so that Spark can split skewed keys of the join
    return kept.join(low, "key").where("cls <> low").select(F.col("cls").alias("a"), F.col("low").alias("b")).distinct()


def _members(rows: DataFrame, clusters: DataFrame, width: int, share: int) -> DataFrame:
    """The clusters' classes with all that a comparison needs, in blocks of bounded size."""

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets = list(shingle_sets(batch.column(2), width))
            columns = [
                batch.column(0),
                batch.column(1),
                pa.array([len(x) for x in sets], pa.int64()),
                pa.array([band_of(len(x), share) for x in sets], pa.int32()),
                pa.array([bitmap(x).tobytes() for x in sets], pa.binary()),
                pa.array([x.tobytes() for x in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["cls", "cluster", "size", "band", "bits", "sh"])

    clusters = stored(clusters.select(F.col("node").alias("cls"), F.col("component").alias("cluster")))
    few = clusters.count() <= BROADCAST_IDS
    texts = rows.withColumnRenamed("doc_id", "cls").join(F.broadcast(clusters) if few else clusters, "cls").select("cls", "cluster", "text")
    found = texts.mapInArrow(described, "cls long, cluster long, size long, band int, bits binary, sh binary")
    return stored(found.where("size > 0"))


def _links(members: DataFrame, share: int) -> DataFrame:
    """Edges ``(a, b)`` that connect what the links among ``members`` connect."""
    blocks = lambda: F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") / BLOCK_ELEMENTS)).cast("long")
    whole = stored(members.groupBy("cluster").agg(blocks().alias("blocks")))
    small = members.join(whole.where("blocks = 1").select("cluster"), "cluster").withColumn("label", F.col("cls"))
    links = _compared(small.withColumn("side", F.lit(0)), ["cluster"], share)
    large = whole.where("blocks > 1").select("cluster")
    if large.isEmpty():
        return links
    # blocks of one band, dealt by hash, so that none grows with its cluster
    large = members.join(large, "cluster")
    banded = large.groupBy("cluster", "band").agg(blocks().alias("n"))
    large = stored(large.join(banded, ["cluster", "band"]).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("n"))).drop("n"))
    banded = stored(banded)
    # each block with itself and with the first block of its band: linear in the cluster
    own = large.withColumn("side", F.lit(1)).withColumn("to", F.col("block"))
    hub = large.where("block = 0").join(banded.where("n > 1"), ["cluster", "band"]).withColumn("side", F.lit(0))
    hub = hub.withColumn("to", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n") - 1))).drop("n")
    star = own.unionByName(hub).withColumn("label", F.col("cls"))
    links = stored(links.unionAll(_compared(star, ["cluster", "band", "to"], share)))
    # what is left: pairs of blocks of one band or of neighbouring ones, unless all their members are connected by now
    labels = connected_components(links).withColumnRenamed("node", "cls").withColumnRenamed("component", "label")
    large = large.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    pure = large.groupBy("cluster", "band", "block").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    left, right = pure.alias("l"), pure.alias("r")
    pairs = left.join(right, F.expr("l.cluster = r.cluster and r.band between l.band and l.band + 1 and (l.band < r.band or l.block < r.block)"))
    pairs = pairs.where("not (l.low = l.high and r.low = r.high and l.low = r.low)")
    pairs = stored(pairs.selectExpr("l.cluster", "l.band", "l.block", "r.band as band2", "r.block as block2"))
    near = large.join(pairs, ["cluster", "band", "block"]).withColumn("side", F.lit(1))
    far = large.withColumnsRenamed({"band": "band2", "block": "block2"}).join(pairs, ["cluster", "band2", "block2"]).withColumn("side", F.lit(2))
    return links.unionAll(_compared(near.unionByName(far), ["cluster", "band", "block", "band2", "block2"], share))


def _compared(members: DataFrame, keys: list[str], share: int) -> DataFrame:
    """Compare each group ``keys`` of ``members``: ``(a, b)``. Side 2 is compared with the others only."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in sorted_groups(batches, keys):
            sets = [np.frombuffer(x, np.uint64) for x in g["sh"]]
            maps = np.frombuffer(b"".join(g["bits"]), np.uint64).reshape(-1, BITMAP)
            second = g["side"].to_numpy() == 2
            first = int((~second).sum()) if second.any() else 0
            links = spanning_links(g["size"].to_numpy(), maps, sets, g["label"].to_numpy(), first, share)
            cls = g["cls"].to_numpy()
            yield pd.DataFrame({"a": [cls[i] for i, _ in links], "b": [cls[j] for _, j in links]}, dtype="int64")

    columns = list(dict.fromkeys([*keys, "side", "cls", "label", "size", "bits", "sh"]))
    return members.select(columns).repartition(*keys).sortWithinPartitions(*keys, "side").mapInPandas(compare, "a long, b long")


def ngram_join(docs: DataFrame, width: int = 3, share: int = 90) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row of ``docs(doc_id, text)``.

    Two documents link when ``100 * |common| >= share * |union|`` of their distinct word n-grams
    (lower-cased A-Z, words between ASCII blanks; with fewer words the whole sequence is one n-gram).
    ``component_id`` is the smallest ``doc_id`` that links reach. A text that is null, empty or blank
    has no n-grams and links with nothing. Repeated rows are equal documents; rows that share an id but
    not a text are judged each by its own text. Rows whose ``doc_id`` is null can't be named: they link with nothing
    and their component is null. Texts are read whole, however long; other columns are ignored; an empty
    table gives no rows. N-grams are compared by 64-bit hashes.
    """
    short_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("print", F.xxhash64("text"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets = list(shingle_sets(batch.column(1), width))
            digests = [xxhash.xxh3_128_digest(sh.tobytes()) if len(sh) else None for sh in sets]
            columns = [batch.column(0), batch.column(2), pa.array([len(sh) for sh in sets], pa.int64()), pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "print", "n_shingles", "digest"])

    digested = stored(rows.mapInArrow(digest, "doc_id long, print long, n_shingles long, digest binary"))
    linked = digested.where("digest is not null and doc_id is not null")
    # classes are written, so that joins with them are of two scans, whose skewed digests Spark splits
    classes = stored(linked.groupBy("digest").agg(F.min(F.struct("doc_id", "print")).alias("first")).select("digest", "first.*"))
    first = classes.select("digest", F.col("doc_id").alias("cls"), F.col("print").alias("own"))
    copies = stored(linked.join(first, "digest").where("doc_id <> cls or print <> own").select("doc_id", "print").distinct())
    single = _without(rows.where("doc_id is not null"), copies)
    clusters = connected_components(_candidates(single, classes.count(), width, share))
    labels = connected_components(_links(_members(single, clusters, width, share), share))
    named = stored(first.join(labels.select(F.col("node").alias("cls"), "component"), "cls", "left").select("digest", F.coalesce("component", "cls").alias("component_id")))
    alone = digested.where("digest is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.join(named, "digest").select("doc_id", "n_shingles", "component_id").unionAll(alone)
