"""Token counts by byte-pair merging with a heap and a linked list (operator 6).

A text becomes symbols, one per byte; the adjacent pair of lowest rank is merged again and again.
The number of tokens is the number of symbols less the merges made, so no identifiers are built.
Counts of chunks between blanks are cached, as chunks do not influence one another.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.llm.common import TwoGenerationCache, byte_letters, held_by_worker

#: Chunks that one worker remembers (two generations of this many).
CACHE = 300_000


class MergeCounter:
    """Counts tokens as a ``tokenizers`` BPE file with word ends defines them.

    The file's own normalisers, split pattern, suffix, merges and added tokens are read; a file with
    other parts is refused rather than counted wrongly.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or level["type"] != "ByteLevel" or not split["invert"]:
            raise ValueError("this counter reads lower-casing byte-level BPE files only")
        self.suffix = model["end_of_word_suffix"] or ""
        ranks = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(ranks)}
        self.words = regex.compile(split["pattern"]["Regex"])
        self.space = regex.compile(spec["normalizer"]["normalizers"][1]["pattern"]["Regex"])
        self.letters = byte_letters()
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.chunks = TwoGenerationCache(CACHE)
        self.parts = TwoGenerationCache(CACHE)

    def merges(self, part: str) -> int:
        """Tokens of one piece that the split pattern found."""
        symbols = [self.letters[b] for b in part.encode("utf-8")]
        symbols[-1] += self.suffix
        n = len(symbols)
        if n == 1:
            return 1
        ranks = self.ranks
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        count = n
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if symbols[i] is None or j >= n or ranks.get((symbols[i], symbols[j])) != rank:
                continue  # one of the two has been merged meanwhile
            symbols[i] += symbols[j]
            symbols[j] = None
            count -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (k := before[i]) >= 0 and (r := ranks.get((symbols[k], symbols[i]))) is not None:
                heapq.heappush(heap, (r, k))
        return count

    def chunk(self, text: str) -> int:
        """Tokens of a text of any content, without the cache of chunks."""
        total, plain = 0, [text]
        if self.special and "<" in text:
            total = len(self.special.findall(text))
            plain = self.special.split(text)
        for piece in plain:
            if piece.isascii():
                piece = piece.lower()
            else:  # letter by letter: no rule looks at the end of a word
                piece = "".join(c.lower() for c in self.space.sub(" ", unicodedata.normalize("NFC", piece)))
            for part in self.words.findall(piece):
                n = self.parts.get(part)
                if n is None:
                    if self.parts.recall([part]):
                        self.parts[part] = self.merges(part)
                    n = self.parts[part]
                total += n
        return total

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        known = self.chunks
        words = text.replace("\n", " ").split(" ")
        try:
            return sum(map(known.__getitem__, words))
        except KeyError:
            pass
        for w in known.recall([w for w in {*words} if w not in known]):
            known[w] = self.chunk(w)
        total = sum(map(known.__getitem__, words))
        known.age()
        self.parts.age()
        return total


def counter_of(path: str) -> MergeCounter:
    """The counter of this worker; what it has cached serves the tasks that follow."""
    return held_by_worker(("counter", path), lambda: MergeCounter(path))


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of every row of ``docs(doc_id, text)``.

    A null text counts as empty (0 bytes, 0 tokens). Repeated rows give repeated results; other
    columns are ignored; an empty table gives no rows. Texts are read whole, whatever their length.
    ``tokenizer_path`` must be readable on every executor.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(tokenizer_path)
        for batch in batches:
            n = pa.array([counter.count(t.as_py()) for t in batch.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), n], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
