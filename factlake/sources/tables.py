"""Sources, sinks and the movement of namespaces between them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factlake.functions.text import ancestors, developer_signals, lex_tokens, redact

#: A document's letters that are taken in at most (2 MB).
MOST_LETTERS = 2_000_000


def append_turns(turns: DataFrame, path: str) -> None:
    """Append to the log, partitioned by namespace; a missing time is the time of the batch."""
    turns.withColumn("observed_at", F.coalesce("observed_at", F.localtimestamp())).write.mode("append").partitionBy("namespace").parquet(path)


def namespace_registry(data: list[DataFrame], explicit: DataFrame) -> DataFrame:
    """Namespaces that hold data and those registered by hand, once each."""
    seen = data[0].select("namespace")
    for df in data[1:]:
        seen = seen.union(df.select("namespace"))
    seen = seen.distinct().withColumn("__seen", F.lit(True))
    named = explicit.select("namespace", "kind").withColumn("__named", F.lit(True))
    rows = seen.join(named, "namespace", "full_outer")
    return rows.select("namespace", F.coalesce("kind", F.lit("default")).alias("kind"), F.col("__named").isNull().alias("auto_registered"))


def turns_by_type(turns: DataFrame, namespace: str, memory_type: str, limit: int) -> DataFrame:
    return turns.where((F.col("namespace") == namespace) & (F.col("memory_type") == memory_type)).orderBy("id").limit(limit)


def memory_feed(turns: DataFrame, limit: int = 50, offset: int = 0, namespace: str | None = None, memory_type: str | None = None) -> DataFrame:
    """The newest first, a page at a time (at most 200 rows)."""
    for column, value in (("namespace", namespace), ("memory_type", memory_type)):
        turns = turns if value is None else turns.where(F.col(column) == value)
    return turns.orderBy(F.desc("id")).offset(offset).limit(min(limit, 200))


def keyset_page(df: DataFrame, before: tuple[Column, Column], n: int) -> DataFrame:
    """The ``n`` rows before (observed_at, id), the newest first."""
    at, i = before
    return df.where((F.col("observed_at") < at) | ((F.col("observed_at") == at) & (F.col("id") < i))).orderBy(F.desc("observed_at"), F.desc("id")).limit(n)


def ingest_sessions(sessions: DataFrame) -> DataFrame:
    """``sessions(session_id, session_date, texts)`` as turns, one a minute from the session's date."""
    rows = sessions.select("session_id", "session_date", F.posexplode("texts").alias("n", "text"))
    return rows.withColumn("observed_at", F.col("session_date") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("n")))


def chunk_text(docs: DataFrame, size: int = 1200, overlap: int = 150) -> DataFrame:
    """Chunks of ``docs(doc_id, text)``: paragraphs packed up to ``size`` letters; a longer one is cut with an overlap.

    The paragraphs of a document are folded in order, which keeps the packing greedy.
    """
    step = size - overlap
    paragraphs = F.filter(F.transform(F.split("text", r"\n\s*\n"), F.trim), lambda p: p != "")
    starts = lambda p: F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.length(p) - overlap) / step).cast("int") - 1))
    cut = lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(F.transform(starts(p), lambda k: F.substr(p, k * step + 1, F.lit(size))))
    state = lambda done, open_: F.struct(done.alias("done"), open_.alias("open"))
    empty = F.array().cast("array<string>")

    def pack(acc: Column, p: Column) -> Column:
        closed = F.when(acc.open == "", acc.done).otherwise(F.concat(acc.done, F.array(acc.open)))
        fits = F.length(acc.open) + F.length(p) + 2 <= size
        return (
            F.when(F.length(p) > size, state(F.concat(closed, cut(p)), F.lit("")))
            .when(acc.open == "", state(acc.done, p))
            .when(fits, state(acc.done, F.concat(acc.open, F.lit("\n\n"), p)))
            .otherwise(state(closed, p))
        )

    chunks = F.aggregate(paragraphs, state(empty, F.lit("")), pack, lambda acc: F.when(acc.open == "", acc.done).otherwise(F.concat(acc.done, F.array(acc.open))))
    return docs.select("doc_id", F.posexplode(chunks).alias("chunk", "text"))


def ingest_documents(docs: DataFrame, size: int = 1200, overlap: int = 150, most: int | None = MOST_LETTERS) -> DataFrame:
    """Documents as turns: chunked and with known secrets redacted. Documents of more than ``most`` letters
    (None: any) are refused, not cut; :func:`refused_documents` names them."""
    rows = docs.select("doc_id", "text") if most is None else docs.where(F.length("text") <= most).select("doc_id", "text")
    return chunk_text(rows, size, overlap).select("doc_id", "chunk", redact(F.col("text")).alias("text"))


def refused_documents(docs: DataFrame, most: int = MOST_LETTERS) -> DataFrame:
    """``(doc_id, letters)`` of the documents that :func:`ingest_documents` refuses."""
    return docs.select("doc_id", F.length("text").alias("letters")).where(F.col("letters") > most)


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: ``(path, text)``; bytes that are not UTF-8 are replaced."""
    return spark.read.format("binaryFile").load(path).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def load_conversations(spark: SparkSession, path: str, base: Column) -> DataFrame:
    """Conversation files ``{id, sessions: [{date, turns: [{speaker, text}]}]}`` as turns; an unreadable date is 30 days a session from ``base``."""
    schema = "id string, sessions array<struct<date: string, turns: array<struct<speaker: string, text: string>>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select("id", F.posexplode("sessions").alias("k", "s"))
    day = F.coalesce(*(F.try_to_timestamp(F.col("s.date"), F.lit(f)).cast("timestamp_ntz") for f in ("yyyy-MM-dd", "d MMMM, yyyy", "h:mm a 'on' d MMMM, yyyy")), base + F.make_dt_interval(F.col("k") * 30))
    turns = rows.select("id", "k", day.alias("day"), F.posexplode("s.turns").alias("n", "t"))
    return turns.select("id", F.concat_ws(":", "id", "k").alias("session_id"), "n", "t.speaker", "t.text", (F.col("day") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("n"))).alias("observed_at"))


def tool_usage(events: DataFrame, since: Column) -> DataFrame:
    return events.where(F.col("ts") >= since).groupBy("kind", "name").agg(F.count(F.lit(1)).alias("uses"))


def last_exchange(events: DataFrame) -> DataFrame:
    """The last human text of each transcript and all the assistant said after it: ``events(transcript, n, role, text)``."""
    w = Window.partitionBy("transcript").orderBy("n")
    human = (F.col("role") == "user") & (F.trim("text") != "")
    rows = events.withColumn("__k", F.sum(human.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("__last", F.max("__k").over(Window.partitionBy("transcript"))).where("__k = __last and __k > 0")
    said = F.array_sort(F.collect_list(F.when((F.col("role") == "assistant") & (F.trim("text") != ""), F.struct("n", "text"))))
    return rows.groupBy("transcript").agg(F.max(F.when(human, F.col("text"))).alias("user_text"), F.array_join(F.transform(said, lambda x: x.text), "\n").alias("reply"))


def copy_namespace(df: DataFrame, src: str, dst: str, like: str | None = None) -> DataFrame:
    """The table with a copy of a namespace's rows (of those that hold ``like``) under new ids."""
    rows = df.where(F.col("namespace") == src)
    if like is not None:
        rows = rows.where(F.contains(F.lower("text"), F.lit(like.lower())))
    return df.unionByName(rows.withColumns({"namespace": F.lit(dst), "id": F.xxhash64(F.lit(dst), F.col("id"))}))


def move_namespace(df: DataFrame, src: str, dst: str) -> DataFrame:
    return df.withColumn("namespace", F.when(F.col("namespace") == src, dst).otherwise(F.col("namespace")))


def purge_namespace(df: DataFrame, namespace: str) -> DataFrame:
    return df.where((F.col("namespace") != namespace) | F.col("namespace").isNull())


def rebuild_graph(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and weighted edges of subject–object facts."""
    pairs = facts.where("subject is not null and object is not null and subject <> '' and object <> ''").select(F.lower("subject").alias("s"), F.lower("object").alias("o")).where("s <> o")
    entities = pairs.select(F.col("s").alias("name")).union(pairs.select("o")).distinct()
    return entities, pairs.groupBy(F.least("s", "o").alias("src"), F.greatest("s", "o").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("weight"))


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by one aggregation with map-side combine."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def hash_embed(df: DataFrame, column: str = "text", dim: int = 64) -> DataFrame:
    """A deterministic embedding by hashing: each token adds its sign at its index; unit length. Adds ``embedding``."""

    def embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for tokens in pdf["__tokens"]:
                v = np.zeros(dim)
                for token in tokens:
                    d = hashlib.sha256(token.encode()).digest()
                    v[int.from_bytes(d[:4], "big") % dim] += 1.0 if d[4] & 1 else -1.0
                n = np.linalg.norm(v)
                out.append((v / n if n else v).tolist())
            yield pdf.drop(columns="__tokens").assign(embedding=out)

    rows = df.withColumn("__tokens", lex_tokens(F.col(column)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.drop("embedding").schema)
    return rows.drop("embedding").mapInPandas(embed, f"{schema}, embedding array<double>")


def reembed(df: DataFrame, embed: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], column: str = "embedding") -> DataFrame:
    """Replace embeddings through a caller's batch function over the table's other columns."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.drop(column).schema)
    return df.drop(column).mapInPandas(embed, f"{schema}, {column} array<double>")


def gen_debt_facts(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """Synthetic facts: 70 % unrelated, 15 % chains of values, 7 % reversals, 8 % restatements, by hash of the number."""
    u = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(100))
    kind = F.when(u < 70, "unrelated").when(u < 85, "chain").when(u < 92, "reversal").otherwise("restatement")
    rows = spark.range(n).withColumn("kind_of", kind)
    subject = F.concat(F.lit("svc_"), F.when(F.col("kind_of") == "unrelated", F.col("id")).otherwise(F.floor(F.col("id") / 10)).cast("string"))
    obj = F.when(F.col("kind_of") == "restatement", "100 rps").otherwise(F.concat(F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(9)).cast("string"), F.lit(" rps")))
    statement = F.when(F.col("kind_of") == "reversal", F.concat(subject, F.lit(" no longer serves traffic"))).otherwise(F.concat(subject, F.lit(" rate_limit is "), obj))
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.expr("make_dt_interval(0, 0, 0, id)")
    return rows.select("id", F.lit("debt").alias("namespace"), "kind_of", subject.alias("subject"), F.lit("rate_limit").alias("predicate"), obj.alias("object"), statement.alias("statement"), at.alias("observed_at"), at.alias("valid_from"))


def corpus_sources(ingests: DataFrame) -> DataFrame:
    """The last ingest of each (namespace, name): ``ingests(namespace, name, kind, git_sha, constraint_count, ingested_at, id)``."""
    last = F.max_by(F.struct("kind", "git_sha", "constraint_count", "ingested_at"), F.struct("ingested_at", "id"))
    return ingests.groupBy("namespace", "name").agg(last.alias("l")).select("namespace", "name", "l.*")


def corpus_descendants(sources: DataFrame, changed: DataFrame) -> DataFrame:
    """Namespaces below each ``changed(namespace)`` that hold documents of their own, and how many.

    A namespace is exploded into its ancestors, so prefixes meet by equality.
    """
    docs = sources.groupBy("namespace").agg(F.count(F.lit(1)).alias("docs"))
    up = docs.select(F.col("namespace").alias("descendant"), "docs", F.explode(ancestors(F.col("namespace"))).alias("namespace"))
    return up.join(changed.select("namespace").distinct(), "namespace")


def copy_log(log: DataFrame, namespaces: DataFrame) -> DataFrame:
    """Copies from or to each of ``namespaces(namespace)``, the newest first: ``log(id, dst_ns, src_ns, mode, copied_at)``."""
    sides = log.withColumn("namespace", F.explode(F.array_distinct(F.array("dst_ns", "src_ns")))).join(namespaces.select("namespace").distinct(), "namespace")
    order = Window.partitionBy("namespace").orderBy(F.desc("copied_at"), F.desc("id"))
    return sides.withColumn("rank", F.row_number().over(order))


def extract_facts(turns: DataFrame, extract: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]] | None = None) -> DataFrame:
    """Facts of ``turns(id, text, …)`` by a caller's batch function, which gives ``(id, subject, predicate, object, statement)``.

    Without one, the references that developers write (trailers, issues, commits, versions) are facts without a subject.
    """
    if extract is not None:
        return turns.mapInPandas(extract, "id long, subject string, predicate string, object string, statement string")
    none = F.lit(None).cast("string")
    return turns.select("id", none.alias("subject"), none.alias("predicate"), none.alias("object"), F.explode(developer_signals(F.col("text"))).alias("statement"))
