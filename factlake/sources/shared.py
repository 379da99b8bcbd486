"""Tables that a job writes for itself in the folder that all machines share, and groups of sorted partitions."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Rows that a task makes, about, where a join makes many more than it reads.
TASK_ROWS = 500_000
#: Folders of local sessions without ``spark.checkpoint.dir``, by application.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: ``spark.checkpoint.dir``.

    Only where it is unset, a session on one machine (as in tests) gets a temporary folder of its own,
    removed at exit; a session on a cluster gets an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return _OWN[app]


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage in a way that outlives any executor, and keeps work that is used more than
    once from being done again. The tables of an application lie in one folder below the shared
    one, which :func:`drop_stored` removes when their results have been read.
    """
    spark = df.sparkSession
    path = f"{_run_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def one_scan(*tables: DataFrame) -> DataFrame:
    """Tables of equal columns that :func:`stored` wrote, as one scan."""
    paths = sorted({unquote(file).rpartition("/")[0] for df in tables for file in df.inputFiles()})
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*paths)


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Deal ``df`` by ``keys`` so that each task makes about :data:`TASK_ROWS` of the ``rows`` that follow from it.

    For joins that make many more rows than they read: Spark sizes tasks by what they read. A number of
    partitions that is given stays as it is, also under adaptive execution.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), *keys)


def _run_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/stored-{spark.sparkContext.applicationId}"


def drop_stored(spark: SparkSession) -> None:
    """Remove all tables that :func:`stored` wrote for this application; frames that read them end with it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_run_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sorted_groups(batches: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of a partition that is sorted by ``keys``, one after the other.

    Holds one group and one batch at a time; callers bound the size of a group.
    """
    held: list[pd.DataFrame] = []
    last = None
    for pdf in batches:
        if not len(pdf):
            continue
        new = (pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy()
        new[0] = False
        cuts = [0, *new.nonzero()[0].tolist(), len(pdf)]
        for start, end in zip(cuts, cuts[1:]):
            part = pdf.iloc[start:end]
            key = tuple(part[keys].iloc[0])
            if held and key != last:
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(part)
            last = key
    if held:
        yield pd.concat(held, ignore_index=True)
