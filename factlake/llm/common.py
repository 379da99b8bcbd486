"""Helpers that several operators share."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.operators.components import connected_components  # noqa: F401
from factlake.sources.shared import drop_stored, shared_dir, sorted_groups, stored  # noqa: F401

#: Rows that a Python worker gets at once.
BATCH_ROWS = 2_000


def short_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Send at most ``rows`` rows to a Python worker at once in this session.

    Rows here carry whole texts, and what is sent is held several times, in the JVM and in the worker. A
    session that sends fewer keeps its own setting.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


def carried(docs: DataFrame, keep: Sequence[str], *own: Column) -> DataFrame:
    """The caller's columns ``keep`` as one struct ``kept``, beside an operator's ``own``: whatever theirs are called, they don't clash."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("kept"), *own)


def restored(rows: DataFrame) -> DataFrame:
    """Kept columns as they came, and all others of ``rows``; a kept one that is called like a result gives way to it."""
    results = [c for c in rows.columns if c != "kept"]
    taken = {c.lower() for c in results}
    kept = [F.col("kept")[f.name].alias(f.name) for f in rows.schema["kept"].dataType.fields if f.name.lower() not in taken]
    return rows.select(*kept, *results)


def byte_letters() -> list[str]:
    """The letter of each byte in byte-level vocabularies: printable bytes stand for themselves,
    the others for the letters from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class TwoGenerationCache(dict):
    """A dict that forgets what has not been used for a while.

    ``fresh`` entries are kept; when they fill the limit they become the old generation and the
    former old one is dropped. Old entries that are used again come back.
    """

    def __init__(self, limit: int):
        super().__init__()
        self.limit = limit
        self.old: dict = {}

    def recall(self, keys: Iterable) -> list:
        """Move those of ``keys`` that the old generation has back, and return the unknown ones."""
        unknown = []
        for k in keys:
            v = self.old.get(k)
            if v is None:
                unknown.append(k)
            else:
                self[k] = v
        return unknown

    def age(self) -> None:
        """Call between batches: start a new generation when this one is full."""
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()


_HELD: dict = {}


def held_by_worker(key: tuple, make: Callable):
    """What this Python worker keeps from task to task: one object at a time.

    Workers are used again for other operators, whose caches must not add up in their memory.
    """
    if key not in _HELD:
        _HELD.clear()
        gc.collect()
        _HELD[key] = make()
    return _HELD[key]
