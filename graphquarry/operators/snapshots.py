"""Snapshots: differences, merges, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph


def difference(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """key, change (added, deleted, changed) of rows that differ."""
    a, b = old.select(key, F.col(digest).alias("before"), F.lit(1).alias("had")), new.select(key, F.col(digest).alias("after"), F.lit(1).alias("has"))
    both = a.join(b, key, "full_outer").where("had IS NULL OR has IS NULL OR NOT (before <=> after)")
    return both.select(key, F.when(F.col("had").isNull(), "added").when(F.col("has").isNull(), "deleted").otherwise("changed").alias("change"))


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """The next inventory: rows of the new one; parse_status stays where the content did, and starts anew elsewhere."""
    was = old.select("path", F.col("content_sha256").alias("was"), F.col("parse_status").alias("kept"))
    same = F.col("was").eqNullSafe(F.col("content_sha256")) & F.col("kept").isNotNull()
    return new.drop("parse_status").join(was, "path", "left").withColumn("parse_status", F.when(same, F.col("kept")).otherwise("pending")).drop("was", "kept")


def statistics(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("kind", "status").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))


def observed_digest(inventory: DataFrame) -> DataFrame:
    """One digest of all rows that doesn't depend on their order: the sum of row digests by 64-bit halves, so that no
    list of rows is gathered."""
    row = F.sha2(F.to_json(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("path", "kind", "status", "reason", "content_sha256")))), 256)
    part = lambda at: F.conv(F.substring(row, at, 12), 16, 10).cast("decimal(38,0)")
    sums = inventory.agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(part(1 + 12 * k)), F.lit(0)).alias(f"s{k}") for k in range(5)))
    return sums.select(F.sha2(F.concat_ws(":", "n", "s0", "s1", "s2", "s3", "s4"), 256).alias("digest"))


def orphans(rows: DataFrame, parents: DataFrame, on: str, parent_key: str) -> DataFrame:
    """The rows without a parent. Both sides are counted, and meet in as many tasks as their number asks for."""
    keys = parents.select(F.col(parent_key).alias(on))
    n = graph.tasks(rows, keys)
    return rows.repartition(n, on).join(keys.repartition(n, on).hint("merge"), on, "left_anti")


def audit(checks: dict[str, tuple[DataFrame, DataFrame, str, str]]) -> DataFrame:
    """check, violations: for each name (rows, parents, column, parent column), the rows without a parent."""
    out = None
    for name, (rows, parents, on, key) in checks.items():
        one = orphans(rows.where(F.col(on).isNotNull()), parents, on, key).agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("violations"))
        out = one if out is None else out.unionByName(one)
    return out


def memberships_equal(a: DataFrame, b: DataFrame, key: str) -> bool:
    return a.join(b, key, "left_anti").isEmpty() and b.join(a, key, "left_anti").isEmpty()


def to_embed(chunks: DataFrame, known: DataFrame, digest: str = "embedding_hash") -> DataFrame:
    """Of each unseen text one chunk: what has to be embedded."""
    return chunks.join(known.select(digest), digest, "left_anti").groupBy(digest).agg(F.min("id").alias("id"))


def unparsed(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """Files whose present content has no ready parse."""
    return files.join(parsed.where("state = 'ready'").select("path", "content_sha256"), ["path", "content_sha256"], "left_anti")
