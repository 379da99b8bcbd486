"""Best-fit packing of tokenised documents into fixed-length sequences (operator 5).

Documents longer than a sequence are cut into full pieces and a rest. The plan is made over the
histogram of piece lengths: best-fit decreasing places *counts* of equal lengths into *runs* of
equally filled sequences, so its size depends on the sequence length and not on the corpus. Pieces
then take planned slots by their rank within their length.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factlake.llm.common import byte_letters, carried, held_by_worker, restored, short_batches, stored

#: Words and other chunks whose identifiers one worker remembers.
CACHE = 700_000
#: Bytes of text that are encoded together.
AT_ONCE = 3_000_000
#: Identifiers in one Arrow column at most.
MOST_IDS = 1 << 28
#: A plain word and the marks after it. The letters (Latin up to U+017F) are in normal form and change case one by
#: one, but for the dotted I; the marks are split from a word whatever they are, but for those that begin a special
#: token or a contraction.
_PLAIN = r"""^(?P<word>[A-Za-zªµºÀ-ÖØ-öø-įı-ſ]+)(?P<marks>[!"#$%&()*+,\-./:;=?@\[\\\]^_`{|}~]*)$"""
#: Rows of one length that are ranked together at most; a length with more is ranked in parts.
RANK_ROWS = 20_000


def _gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches ``values[start : start + length]``, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(values)) < 1 << 31 else np.int64
    at = np.repeat((starts - ends + lengths).astype(kind), lengths)
    at += np.arange(total, dtype=kind)
    return values.take(at)


class ChunkEncoder:
    """Identifiers of whole texts, as unsigned 32-bit integers.

    Chunks between blanks do not influence one another, so the distinct ones among many texts are
    encoded once, and Arrow and numpy lay their identifiers out. A plain word before marks, by far the
    commonest chunk, goes straight to the library's merges. What a word or another chunk gives is
    remembered as a stretch of one array.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merge = self.tokenizer.model.tokenize
        spec = json.loads(self.tokenizer.to_str())
        split = str((spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex"))
        # the short way holds for byte-level vocabularies that lower-case and take runs of letters and of marks apart
        self.short = "Lowercase" in str(spec["normalizer"]) and "ByteLevel" in str(spec["pre_tokenizer"]) and r"|[\p{L}]+|" in split
        self.letters = dict(enumerate(byte_letters()))
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}  # the number of a word or chunk; its stretch is starts[number] to starts[number + 1]
        self.starts, self.ids = np.zeros(1 << 16, np.int64), np.empty(1 << 18, np.uint32)

    def _word(self, low: str) -> list[int]:
        plain = low if low.isascii() else low.encode("utf-8").decode("latin-1").translate(self.letters)
        return [t.id for t in self.merge(plain)]

    def _long(self, chunk: str) -> list[int]:
        return self.tokenizer.encode(chunk, add_special_tokens=False).ids

    def _numbers(self, parts: pa.Array, encode: Callable[[str], list[int]]) -> np.ndarray:
        """The numbers of ``parts``, all different; those that are new are encoded."""
        names = parts.to_numpy(zero_copy_only=False).tolist()
        first, used = len(self.known), int(self.starts[len(self.known)])
        found = []
        for p in names:
            if p not in self.known:
                self.known[p] = len(self.known)
                found.append(encode(p))
        if found:
            ends = used + np.cumsum([len(x) for x in found])
            while len(self.known) >= len(self.starts):
                self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            while ends[-1] > len(self.ids):
                self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
            self.starts[first + 1 : first + 1 + len(found)] = ends
            self.ids[used : ends[-1]] = np.fromiter(chain.from_iterable(found), np.uint32, int(ends[-1]) - used)
        return np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many identifiers each text has, none of them null, and the identifiers of all, one text after the other."""
        if len(self.known) > CACHE:
            self.forget()
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        chunks = split.flatten().dictionary_encode()
        code = chunks.indices.to_numpy(zero_copy_only=False)
        distinct = chunks.dictionary
        parts = pc.extract_regex(distinct, _PLAIN)
        plain = parts.is_valid() if self.short else pa.array(np.zeros(len(distinct), bool))
        is_plain = plain.to_numpy(zero_copy_only=False)
        # each chunk is up to two stretches: a word and the marks after it, or the chunk as it is and nothing
        number = np.zeros((len(distinct), 2), np.int64)
        there = np.ones((len(distinct), 2), bool)
        number[~is_plain, 0] = self._numbers(distinct.filter(pc.invert(plain)), self._long)
        words = pc.utf8_lower(pc.struct_field(parts, "word").filter(plain)).dictionary_encode()
        marks = pc.struct_field(parts, "marks").filter(plain).dictionary_encode()
        for column, of, how in ((0, words, self._word), (1, marks, self._long)):
            known = self._numbers(of.dictionary, how)
            number[is_plain, column] = known[of.indices.to_numpy(zero_copy_only=False)]
        there[~is_plain, 1] = False
        starts = self.starts[number]
        lengths = np.where(there, self.starts[number + 1] - starts, 0)
        own = _gather(self.ids, starts.ravel(), lengths.ravel())
        size = lengths.sum(axis=1)
        begin = np.cumsum(size) - size
        ids = _gather(own, begin[code], size[code])
        at = np.concatenate([[0], np.cumsum(size[code])])
        edges = split.offsets.to_numpy() - split.offsets[0].as_py()
        return np.diff(at[edges]), ids


def encoder_of(path: str) -> ChunkEncoder:
    """The encoder of this worker; what it has cached serves the tasks that follow."""
    return held_by_worker(("encoder", path), lambda: ChunkEncoder(path))


def token_pieces(docs: DataFrame, tokenizer_path: str, max_len: int = 2048, end_id: int = 0) -> DataFrame:
    """``(doc_id, piece, start, length, ids)`` of every row of ``docs(doc_id, text)``.

    ``ids`` holds the piece's identifiers as little-endian unsigned 32-bit integers; each document
    ends with ``end_id``. Only documents longer than ``max_len`` are cut. A null text counts as empty
    and gives one piece that holds ``end_id`` alone. Repeated rows give repeated pieces; other columns
    are ignored; an empty table gives no rows.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path)
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:  # a text longer than AT_ONCE is encoded by itself
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + AT_ONCE)))
                some = batch.slice(at, to - at)
                yield from as_batches(some.column(0), *encoder.encode(some.column(1)))
                at = to

    def as_batches(docs: pa.Array, n: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids = np.insert(ids, np.cumsum(n), end_id).astype("<u4", copy=False)
        n = n + 1
        pieces = -(-n // max_len)
        first = np.cumsum(pieces) - pieces
        owner = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(owner)) - first[owner]
        start = piece * max_len
        length = np.minimum(n[owner] - start, max_len)
        ends = np.cumsum(length)
        row = 0
        while row < len(piece):
            to = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + MOST_IDS, side="right")))
            low = int(ends[row - 1]) if row else 0
            edges = np.concatenate([[0], ends[row:to] - low]).astype(np.int32) * 4
            binary = pa.Array.from_buffers(pa.binary(), to - row, [None, pa.py_buffer(edges), pa.py_buffer(ids[low : ends[to - 1]])])
            columns = [docs.take(pa.array(owner[row:to])), pa.array(piece[row:to], pa.int32()), pa.array(start[row:to]), pa.array(length[row:to]), binary]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids"])
            row = to

    short_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary")


def best_fit_plan(counts: dict[int, int], max_len: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows ``(length, first_rank, n, first_sequence, offset)``.

    The pieces of ``length`` ranked ``first_rank`` to ``first_rank + n - 1`` go to the sequences from
    ``first_sequence`` on, one each, at ``offset``. A run is a stretch of sequence numbers that are
    filled alike; it is split only where a length's count ends inside it, so there are at most a few
    runs for each length, however many documents there are.
    """
    runs: list[list[tuple[int, int]]] = [[] for _ in range(max_len + 1)]  # by room left: (first sequence, how many)
    plan, sequences = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = next((r for r in range(length, max_len) if runs[r]), max_len)
            if room < max_len:
                first, have = runs[room].pop()
            else:
                first, have = sequences, -(-left // (max_len // length))
                sequences += have
            each = min(room // length, left)
            use = min(have, left // each)
            if use < have:
                runs[room].append((first + use, have - use)) if room < max_len else None
                sequences -= (have - use) * (room == max_len)
            for k in range(each):
                plan.append((length, rank, use, first, max_len - room + k * length))
                rank += use
            left -= use * each
            runs[room - each * length].append((first, use))
    return plan


def with_slots(pieces: DataFrame, max_len: int = 2048) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``pieces``; all other columns stay, whatever their names.

    ``pieces`` needs ``doc_id``, ``piece`` and ``length`` (1 to ``max_len``) and must be cheap to read
    twice (a stored table). The histogram of at most ``max_len`` rows is all that the driver sees. Repeated rows and
    rows without an id get slots of their own; an empty table stays empty.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = np.array(best_fit_plan(counts, max_len), dtype=np.int64).reshape(-1, 5)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    # a length that has more than a task's share of the rows is ranked in parts
    tasks = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = min(RANK_ROWS, max(200, sum(counts.values()) // tasks))
    parts = F.lit(",".join(str(-(-counts.get(n, 1) // each)) for n in range(1, max_len + 1)))
    of_length = lambda c: F.element_at(F.split(parts, ",").cast("array<bigint>"), F.col(c).cast("int"))
    spread = carried(pieces, pieces.columns, F.col("doc_id").alias("id"), F.col("piece").alias("p"), F.col("length").cast("long").alias("len"))
    # rows without an id are told apart by all their columns
    salt = F.xxhash64("id", "p", F.when(F.col("id").isNull(), F.to_json("kept")))
    spread = spread.withColumn("part", F.pmod(salt, of_length("len")))
    # where each part of a length begins; a few rows for each task, and one for each length
    begins = (
        spread.groupBy("len", "part").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("begin", F.sum("n").over(Window.partitionBy("len").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
        .select("len", "part", F.coalesce("begin", F.lit(0)).alias("begin"))
    )
    ranked = (
        spread.withColumn("at", F.row_number().over(Window.partitionBy("len", "part").orderBy("id", "p")))
        .join(begins, ["len", "part"])
        .withColumn("rank", F.col("begin") + F.col("at") - 1)
    )
    held = pieces.sparkSession.sparkContext.broadcast(plan)

    @F.pandas_udf("sequence_id long, offset long")
    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        p, key = held.value, length.to_numpy() * 2**40 + rank.to_numpy()
        row = np.searchsorted(p[:, 0] * 2**40 + p[:, 1], key, side="right") - 1
        return pd.DataFrame({"sequence_id": p[row, 3] + rank.to_numpy() - p[row, 1], "offset": p[row, 4]})

    return restored(ranked.select("kept", slot("len", "rank").alias("slot")).select("kept", "slot.sequence_id", "slot.offset"))


def pack(docs: DataFrame, tokenizer_path: str, max_len: int = 2048, end_id: int = 0) -> DataFrame:
    """Tokenise and pack ``docs``: the columns of :func:`token_pieces` with ``sequence_id`` and ``offset``."""
    return with_slots(stored(token_pieces(docs, tokenizer_path, max_len, end_id)), max_len)
