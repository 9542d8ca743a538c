"""Evaluation metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def precision_recall(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    a, b = expected.select(key, F.lit(1).alias("e")).distinct(), actual.select(key, F.lit(1).alias("a")).distinct()
    both = a.join(b, key, "full_outer")
    hit = F.count_if(F.col("e").isNotNull() & F.col("a").isNotNull())
    return both.agg(
        (hit / F.greatest(F.count("a"), F.lit(1))).alias("precision"),
        (hit / F.greatest(F.count("e"), F.lit(1))).alias("recall"),
        F.count_if(F.col("a").isNull()).alias("missing"),
        F.count_if(F.col("e").isNull()).alias("unexpected"),
    )


def recall_mrr(ranks: DataFrame, at: int = 5) -> DataFrame:
    """Of (query_id, relevant, rank): the share of queries with a relevant row within `at`, and the mean of 1 / rank of
    the first one."""
    first = ranks.groupBy("query_id").agg(F.min(F.when(F.col("relevant") & (F.col("rank") <= at), F.col("rank"))).alias("first"))
    return first.agg(F.avg(F.col("first").isNotNull().cast("int")).alias("recall"), F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"))


def nearest_rank(rows: DataFrame, value: Column, shares: dict[str, float], group: list[str] | None = None) -> DataFrame:
    """Percentiles by nearest rank: the ceil(n * p)-th smallest value, by counts of distinct values, so that no list of
    values is gathered."""
    from pyspark.sql import Window

    by = group or []
    counts = rows.where(value.isNotNull()).groupBy(*by, value.alias("v")).agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy(*by).orderBy("v")
    upto = counts.withColumns({"upto": F.sum("c").over(order), "n": F.sum("c").over(Window.partitionBy(*by))})
    return upto.groupBy(*by).agg(*(F.min(F.when(F.col("upto") >= F.greatest(F.ceil(F.col("n") * p), F.lit(1)), F.col("v"))).alias(name) for name, p in shares.items()))


def accuracy(rows: DataFrame, category: str, correct: Column) -> DataFrame:
    return rows.groupBy(category).agg(F.count(F.lit(1)).alias("n"), F.avg(correct.cast("int")).alias("accuracy"))


def repeated_names(rows: DataFrame, name: str, most: int = 8) -> DataFrame:
    return rows.groupBy(name).agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), name).limit(most)
