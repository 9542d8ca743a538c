"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: the blank, and tab to carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names. A folder of our own only for a master within this machine (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/graphquarry-scratch"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def small_batches(spark: SparkSession, most: int = 2 << 20) -> None:
    """Arrow batches of at most `most` bytes for the Python operators of this session: a batch lies in memory several
    times (in the JVM, in Python, as arrays), and long texts would make the usual ones large."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or int(re.sub(r"\D", "", now) or 0) > most or not now.rstrip("bB").isdigit():
        spark.conf.set(key, str(most))


def materialise(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it back: the plan is cut, and a lost executor costs nothing
    that was finished."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """As materialise(), in buckets of `key` as many as a shuffle has partitions: a join on `key` then moves the other
    side only. The table's name is taken out of the catalog again; its files stay in the shared folder."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    writer = df.write.format("parquet").mode("errorifexists").option("path", f"{scratch_root(spark)}/{table}")
    writer.bucketBy(shuffle_partitions(spark), key).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a whole text: maximal runs of characters outside SPACES. A null text has none."""
    return F.array_remove(F.split(text_or_empty(text), SPACE_CLASS, -1), "")


def fresh(docs: DataFrame, name: str) -> str:
    """The name, with underscores before it until the table has no such column."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = "_" + name
    return name


#: Keys of one or two longs up to which a set of them is broadcast: at most some twenty megabytes.
BROADCAST_KEYS = 300_000


def if_small(keys: DataFrame, limit: int = BROADCAST_KEYS) -> DataFrame:
    """Keys with a broadcast hint if they are counted and at most `limit`; beyond that they are joined by a shuffle."""
    return F.broadcast(keys) if keys.limit(limit + 1).count() <= limit else keys
