"""A journal of vectors with payloads: upsert, delete, set_payload, scroll, retrieve, count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphquarry.functions import vectors
from graphquarry.functions.identity import vector_id
from graphquarry.operators.filters import payload_filter


def upsert(journal: DataFrame, rows: DataFrame, dimensions: int) -> DataFrame:
    """The journal with `rows` (chunk_id, embedding, payload, and seq if a chunk may come twice): valid vectors at length one; the
    new row wins, of several the one with the greatest seq, and of those the one with the greatest payload."""
    if not rows.where(~vectors.is_valid(F.col("embedding"), dimensions)).isEmpty():
        raise ValueError("a vector is of another size, not finite or zero")
    new = rows.select("chunk_id", vector_id(F.col("chunk_id")).alias("vector_id"), vectors.unit(F.col("embedding")).alias("embedding"), "payload", F.struct(F.lit(1), F.col("seq").cast("long") if "seq" in rows.columns else F.lit(0).cast("long")).alias("_new"))
    both = journal.withColumn("_new", F.struct(F.lit(0), F.lit(0).cast("long"))).unionByName(new)
    last = Window.partitionBy("chunk_id").orderBy(F.desc("_new"), F.desc("payload"))
    return both.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_new")


def delete(journal: DataFrame, ids: DataFrame) -> DataFrame:
    return journal.join(ids.select("chunk_id"), "chunk_id", "left_anti")


def set_payload(journal: DataFrame, payloads: DataFrame) -> DataFrame:
    new = payloads.select("chunk_id", F.col("payload").alias("_payload"))
    return journal.join(new, "chunk_id", "left").withColumn("payload", F.coalesce("_payload", "payload")).drop("_payload")


def scroll(journal: DataFrame, limit: int, offset: int | None = None) -> tuple[DataFrame, int | None]:
    """Rows from an id on, and the first id that is not among them."""
    rows = journal if offset is None else journal.where(F.col("vector_id") >= offset)
    page = rows.orderBy("vector_id").limit(limit + 1)
    ids = [r["vector_id"] for r in page.select("vector_id").collect()]  # at most limit + 1
    return page.orderBy("vector_id").limit(limit), ids[limit] if len(ids) > limit else None


def retrieve(journal: DataFrame, ids: list[int]) -> DataFrame:
    return journal.where(F.col("vector_id").isin(ids))


def count(journal: DataFrame, condition: dict | None = None) -> int:
    field = lambda key: F.get_json_object("payload", f"$.{key}")
    return journal.where(payload_filter(condition or {}, field)).count()


def search(journal: DataFrame, query: list[float], limit: int, condition: dict | None = None) -> DataFrame:
    field: Column = lambda key: F.get_json_object("payload", f"$.{key}")
    rows = journal.where(payload_filter(condition or {}, field))
    score = vectors.dot(F.col("embedding"), vectors.unit(F.array(*(F.lit(float(x)) for x in query))))
    return rows.withColumn("score", score).orderBy(F.desc("score"), "vector_id").limit(limit)
