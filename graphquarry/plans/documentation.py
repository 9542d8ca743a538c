"""Deterministic documentation pages from facts, and which of them have to be written anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_FILES, MOST_PAGES = 500, 120


def overview(docs: DataFrame) -> DataFrame:
    """One row for each source: its size, its languages and its first document."""
    return docs.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum("n_chars").alias("chars"),
        F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("languages"),
        F.min("doc_id").alias("first"),
    )


def modules(symbols: DataFrame) -> DataFrame:
    """module (first part of the path), files and symbols."""
    return symbols.groupBy(F.substring_index("path", "/", 1).alias("module")).agg(F.count_distinct("path").alias("files"), F.count(F.lit(1)).alias("symbols"))


def symbol_pages(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """id, page, facts_hash for the symbols with most callers. Each page lists at most twenty callers."""
    some = calls.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("calls"), F.slice(F.array_sort(F.collect_set("source")), 1, 20).alias("callers"))
    rows = symbols.join(some, "id", "left").orderBy(F.desc_nulls_last("calls"), "id").limit(MOST_PAGES)
    page = F.concat_ws("\n", F.concat(F.lit("# "), F.col("qualified_name")), F.concat(F.lit("Defined in "), F.col("path")), F.concat(F.lit("Callers: "), F.array_join(F.coalesce("callers", F.array().cast("array<string>")), ", ")))
    return rows.select("id", page.alias("page"), F.sha2(page, 256).alias("facts_hash"))


def to_write(pages: DataFrame, stored: DataFrame) -> DataFrame:
    """Pages whose facts differ from those that are stored."""
    return pages.join(stored.select("id", "facts_hash"), ["id", "facts_hash"], "left_anti")
