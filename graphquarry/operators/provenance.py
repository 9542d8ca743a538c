"""Provenance: where an indexed entity stands in the present sources, and whether what is stored still agrees with them."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphquarry.functions import text as T

#: Kinds of entities in the order in which an identifier is looked up.
KINDS = ("chunk", "symbol", "relationship", "node")
FIELDS = {"snapshot_id": "string", "file_id": "string", "source_hash": "string", "start_line": "int", "end_line": "int", "start_byte": "int", "end_byte": "int"}
#: What a payload repeats of its chunk.
PAYLOAD = {"file_path": "path", "file_hash": "source_hash", "snapshot_id": "snapshot_id", "file_id": "file_id", "symbol_id": "symbol_id", "chunk_id": "id", "chunk_index": "chunk_index", "content_hash": "content_hash", "start_line": "start_line", "end_line": "end_line"}
CONTEXT = ("language", "module", "symbol_kind", "symbol_name", "qualified_name", "signature", "comments", "chunk_kind", "parent_symbol_key", "embedding_model")
EXCERPTS = 14_000


def trace(ids: DataFrame, entities: dict[str, DataFrame], snapshots: DataFrame, files: DataFrame) -> DataFrame:
    """id, kind, path, start_line, end_line, status for each identifier (id).

    `entities` has a frame for each of KINDS (id and FIELDS; what a kind doesn't have is null). files: file_id, path, content.
    status: missing; not_ready; structural (no file); unavailable; changed; invalid_location; lines_disagree; ok. Without
    lines an entity is all of its file. A file's content is looked at once.
    """
    parts = None
    for rank, kind in enumerate(KINDS):
        rows = entities[kind]
        have = {c: F.col(c).cast(t) if c in rows.columns else F.lit(None).cast(t) for c, t in FIELDS.items()}
        rows = rows.select("id", F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), *(c.alias(n) for n, c in have.items()))
        parts = rows if parts is None else parts.unionByName(rows)
    first = Window.partitionBy("id").orderBy("rank", "snapshot_id")
    known = parts.join(ids.select("id").distinct(), "id", "left_semi").withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "rank")
    ready = snapshots.where("state = 'ready'").select(F.col("id").alias("snapshot_id"), F.lit(True).alias("ready"))
    # only offsets that are asked for are looked up in a file; its text goes no further
    lines = T.unix_lines(F.decode("content", "UTF-8"))
    n_lines = F.greatest(F.size(F.split(F.regexp_replace(lines, "\n$", ""), "\n", -1)), F.lit(1))
    line = lambda at: F.size(F.split(F.decode(F.substring(F.col("content"), F.lit(1), at), "ISO-8859-1"), "\n", -1))
    looked = known.join(files.select("file_id", "path", "content"), "file_id", "left").select(
        *known.columns, "path", F.sha2("content", 256).alias("now"), F.when(F.col("content").isNotNull(), n_lines).alias("n_lines"), F.octet_length("content").alias("n_bytes"), line(F.col("start_byte")).alias("first"), line(F.col("end_byte")).alias("last")
    )
    rows = ids.select("id").join(looked, "id", "left").join(ready, "snapshot_id", "left")
    start, end = F.coalesce("start_line", F.lit(1)), F.coalesce("end_line", F.when(F.col("start_line").isNull(), F.col("n_lines")).otherwise(F.col("start_line")))
    bounded = (start >= 1) & (start <= end) & (end <= F.col("n_lines"))
    bytes_ = F.col("start_byte").isNull() | ((F.col("start_byte") >= 0) & (F.col("start_byte") <= F.col("end_byte")) & (F.col("end_byte") <= F.col("n_bytes")))
    agree = F.col("start_byte").isNull() | ((start == F.col("first")) & (F.col("end_line").isNull() | (end == F.col("last"))))
    status = (
        F.when(F.col("kind").isNull(), "missing")
        .when(F.col("ready").isNull(), "not_ready")
        .when(F.col("file_id").isNull(), "structural")
        .when(F.col("path").isNull(), "unavailable")
        .when(~F.col("source_hash").eqNullSafe(F.col("now")), "changed")
        .when(~bounded | ~bytes_, "invalid_location")
        .when(~agree, "lines_disagree")
        .otherwise("ok")
    )
    return rows.select("id", "kind", "path", start.alias("start_line"), end.alias("end_line"), status.alias("status"), "snapshot_id", "file_id", "source_hash")


def payload_valid(chunk: str, payload: str, context=()) -> Column:
    """Whether a vector's payload agrees with its chunk in all of PAYLOAD and `context`, and its snippet with its hash."""
    same = [F.col(f"{payload}.{theirs}").eqNullSafe(F.col(f"{chunk}.{ours}")) for theirs, ours in PAYLOAD.items()]
    same += [F.col(f"{payload}.{c}").eqNullSafe(F.col(f"{chunk}.{c}")) for c in context]
    snippet = F.sha2(F.coalesce(F.col(f"{payload}.code_snippet"), F.lit("")), 256)
    return reduce(and_, same, snippet == F.col(f"{chunk}.content_hash"))


def health(chunks: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One row: the number of collections and of models, chunks of snapshots that aren't ready, and whether the index serves."""
    ready = snapshots.where("state = 'ready'").select(F.col("id").alias("snapshot_id"), F.lit(1).alias("ready"))
    rows = chunks.join(ready, "snapshot_id", "left")
    out = rows.agg(F.count_distinct("collection_name").alias("collections"), F.count_distinct("embedding_model").alias("models"), F.count_if(F.col("ready").isNull()).alias("unready"))
    good = (F.col("collections") == 1) & (F.col("models") == 1) & (F.col("unready") == 0)
    return out.withColumn("status", F.when(F.col("collections") == 0, "unavailable").when(good, "available").otherwise("stale"))


def freshness(indexed: DataFrame, now: DataFrame) -> DataFrame:
    """One row: files that changed, went or came since an index was made, and whether it is fresh."""
    a, b = indexed.select("path", F.col("content_sha256").alias("was")), now.select("path", F.col("content_sha256").alias("is"), F.lit(1).alias("there"))
    both = a.withColumn("had", F.lit(1)).join(b, "path", "full_outer")
    out = both.agg(F.count_if(F.expr("had = 1 AND there = 1 AND NOT (was <=> `is`)")).alias("changed"), F.count_if(F.col("there").isNull()).alias("deleted"), F.count_if(F.col("had").isNull()).alias("added"))
    return out.withColumn("fresh", (F.col("changed") + F.col("deleted") + F.col("added")) == 0)


def excerpts(rows: DataFrame, budget: int = EXCERPTS) -> DataFrame:
    """rank, path, start_line, end_line, excerpt of an answer's places (rank, path, start_line, end_line, source_hash, content):
    numbered lines of sources that still have their hash, redacted, in the order of rank, cut where the budget ends. A place
    that repeats counts once, and one outside its file not at all."""
    text = T.redact(F.decode("content", "UTF-8"))
    lines = F.split(F.regexp_replace(T.unix_lines(text), "\n$", ""), "\n", -1)
    good = rows.where((F.sha2("content", 256) == F.col("source_hash")) & (F.col("start_line") >= 1) & (F.col("start_line") <= F.col("end_line"))).withColumn("lines", lines)
    good = good.where(F.col("end_line") <= F.size("lines"))
    numbered = F.transform(F.slice("lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), lambda line, i: F.concat((F.col("start_line") + i).cast("string"), F.lit(": "), line))
    once = Window.partitionBy("path", "start_line", "end_line", "source_hash").orderBy("rank")
    good = good.withColumn("excerpt", T.without_controls(F.array_join(numbered, "\n"))).withColumn("n", F.row_number().over(once)).where("n = 1")
    before = F.coalesce(F.sum(F.length("excerpt")).over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # the places of one answer
    cut = good.withColumn("left", F.lit(budget) - before).where("left > 0 AND excerpt != ''")
    return cut.select("rank", "path", "start_line", "end_line", F.substring("excerpt", F.lit(1), F.col("left").cast("int")).alias("excerpt"))
