"""Exact duplicate detection by an extendible-hash index on shared files. DataFrame operations only.

Texts are equal when they are identical after each run of white space became one blank.

1. Every row becomes a fingerprint: a 64-bit key of the normalised text, its SHA-256 and its length.
2. The directory is doubled until no bucket holds more than `capacity` distinct keys. Buckets that are not overfull keep a
   smaller local depth, so several slots of the directory point at them. It is looked up for every fingerprint.
3. Each bucket has an owner: the directory deals the fingerprints to the owners' tasks. An owner sorts its keys, chains the
   fingerprints of one text, finds the row that stays, and writes the chains to the index files.
4. A key that more than `hot` rows have isn't dealt to an owner: its rows are aggregated where they are, and the few
   entries of such keys are looked up by broadcast (there are at most HOT_KEYS of them, by the choice of `hot`).
5. Chains are compared byte by byte with their first text. A long chain is salted: each salt has the first text once.
   Contents that differ although key, digest and length agree are chained by their bytes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, SPACE_CLASS, fresh, if_small, materialise, shuffle_partitions, text_or_empty

ENTRY = ["key", "text_sha256", "n_bytes"]
#: Distinct keys of a bucket; with fewer keys buckets are smaller, so that each task owns several of them.
CAPACITY, BUCKETS_PER_TASK, MOST_BUCKETS = 200_000, 16, 50_000
#: A key is hot if more rows have it than LEAST_HOT and than a HOT_KEYS-th of all rows; so at most HOT_KEYS keys are.
LEAST_HOT, HOT_KEYS = 500, 50_000
#: Copies that are compared with one repetition of their first text.
SALTED = 256


def normalise(text: Column) -> Column:
    return F.regexp_replace(text_or_empty(text), SPACE_CLASS, " ")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=None, key=None, with_text: bool = False) -> DataFrame:
    """doc_id, key, text_sha256, n_bytes of each row, and norm if wanted."""
    digest = digest or (lambda text: F.sha2(text, 256))
    key = key or (lambda text: F.xxhash64(text))
    norm = docs.select(F.col(id_col).alias("doc_id"), normalise(F.col(text_col)).alias("norm"))
    more = ["norm"] if with_text else []
    return norm.select("doc_id", key(F.col("norm")).alias("key"), digest(F.col("norm")).alias("text_sha256"), F.octet_length("norm").alias("n_bytes"), *more)


def split_directory(counts: dict[int, int], max_depth: int, capacity: int) -> tuple[int, list[tuple[int, int]]]:
    """Double the directory while a bucket is overfull. `counts` has the keys by their lowest max_depth bits.

    Returns the global depth and, for each of its slots in order, (bucket, local depth); a bucket's name is its lowest
    slot.
    """
    work = [(0, 0, counts)]
    leaves: list[tuple[int, int]] = []
    while work:
        slot, depth, inside = work.pop()
        if depth == max_depth or sum(inside.values()) <= capacity:
            leaves.append((slot, depth))
            continue
        for bit in (0, 1):
            half = {k: v for k, v in inside.items() if (k >> depth) & 1 == bit}
            work.append((slot | (bit << depth), depth + 1, half))
    depth_of = dict(leaves)
    top = max(depth_of.values())
    slots = []
    for slot in range(1 << top):
        bucket = next(slot & ((1 << d) - 1) for d in range(top + 1) if depth_of.get(slot & ((1 << d) - 1)) == d)
        slots.append((bucket, depth_of[bucket]))
    return top, slots


def build_directory(keys: DataFrame, capacity: int) -> tuple[int, list[tuple[int, int]]]:
    """The directory over distinct keys. A count for each slot reaches the driver: some times the number of buckets."""
    depth = max(1, math.ceil(math.log2(max(1, keys.count()) / capacity + 1)) + 3)
    while True:
        slot = F.col("key").bitwiseAND(F.lit((1 << depth) - 1))
        counts = {r["slot"]: r["n"] for r in keys.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n")).collect()}
        if depth >= 40 or max(counts.values(), default=0) <= capacity:
            return split_directory(counts, depth, capacity)
        depth += 4


def capacity_for(n_keys: int, n_tasks: int) -> int:
    wanted = min(max(n_keys // CAPACITY, BUCKETS_PER_TASK * n_tasks), MOST_BUCKETS)
    return max(1, -(-n_keys // wanted))


def build_index(prints: DataFrame, keys: DataFrame, capacity: int | None = None) -> DataFrame:
    """The index, as files in the shared folder, a row for each fingerprint: bucket, local_depth, doc_id, key, text_sha256,
    n_bytes, keep_id, group_size. `prints` holds no hot key."""
    spark, n = prints.sparkSession, shuffle_partitions(prints.sparkSession)
    top, slots = build_directory(keys, capacity or capacity_for(keys.count(), n))
    directory = spark.createDataFrame([(i, b, d) for i, (b, d) in enumerate(slots)], "slot long, bucket long, local_depth int")
    slot = F.col("key").bitwiseAND(F.lit((1 << top) - 1))
    dealt = prints.withColumn("slot", slot).join(F.broadcast(directory), "slot").drop("slot")  # a small multiple of MOST_BUCKETS at most
    chain = Window.partitionBy("bucket", *ENTRY)  # an owner's task has whole buckets, so this moves nothing
    owned = dealt.repartition(n, "bucket").withColumns({"keep_id": F.min("doc_id").over(chain), "group_size": F.count(F.lit(1)).over(chain)})
    return materialise(owned, "dedup-index")


def attached(rows: DataFrame, chains: DataFrame) -> DataFrame:
    """The rows of chained texts, with their chain. Hot ones are looked up by broadcast, whatever the number of others."""
    if chains.limit(HOT_KEYS + 1).count() <= HOT_KEYS:
        return rows.join(F.broadcast(chains), ENTRY)
    hot = F.broadcast(chains.where("hot"))
    return rows.join(hot, ENTRY).unionByName(rows.join(hot, ENTRY, "left_anti").join(chains.where("NOT hot"), ENTRY))


def having(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The documents of these ids (doc_id) if the ids can be broadcast, so that other texts aren't read again; else all."""
    ids = ids.distinct()
    few = ids.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    if not few:
        return docs
    of = fresh(docs, "_of")
    return docs.join(F.broadcast(ids.withColumnRenamed("doc_id", of)), docs[id_col].eqNullSafe(F.col(of)), "left_semi")


def differing(members: DataFrame, firsts: DataFrame, chains: DataFrame) -> DataFrame:
    """Entries (key, digest, length) of which some member's bytes differ from the chain's first text. Both have norm;
    `firsts` holds the rows whose id is a chain's keep_id, and may hold others."""
    chains = chains.withColumn("salts", F.ceil(F.col("group_size") / SALTED).cast("int"))
    members, firsts = attached(members, chains), attached(firsts, chains)
    first = firsts.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).dropDuplicates(ENTRY)
    first = first.select(*ENTRY, F.col("norm").alias("first"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    salted = members.select(*ENTRY, "norm", F.pmod(F.xxhash64(F.monotonically_increasing_id()), "salts").cast("int").alias("salt"))
    return salted.join(first, [*ENTRY, "salt"]).where("norm != first").select(*ENTRY).distinct()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None, least_hot: int = LEAST_HOT, digest=None, key=None) -> DataFrame:
    """Groups of equal texts: doc_id, keep_id (the smallest id of the group), group_size (rows), kept, text_sha256.

    One row per row of the table; rows that repeat id and text are members each, and share their verdict, and an id may have
    several texts. A null text counts as the empty text. A null id sorts after every other id: such a row stays only if its
    whole group has no id. An empty table gives an empty result. Very long texts are read whole, by hashes and comparisons
    of the JVM. Other columns of the table are ignored, whatever their names.
    """
    prints = materialise(fingerprints(docs, id_col, text_col, digest, key), "dedup-prints")
    keys = materialise(prints.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "dedup-keys")
    hot = max(least_hot, (keys.agg(F.sum("n").alias("n")).first()["n"] or 0) // HOT_KEYS)
    hot_keys = F.broadcast(keys.where(F.col("n") > hot).select("key"))  # at most HOT_KEYS rows
    index = build_index(prints.join(hot_keys, "key", "left_anti"), keys.where(F.col("n") <= hot), capacity)
    hot_rows = prints.join(hot_keys, "key", "left_semi")
    hot_entries = materialise(hot_rows.groupBy(*ENTRY).agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "dedup-hot")
    shape = ["doc_id", *ENTRY, "keep_id", "group_size"]
    result = index.select(shape).unionByName(hot_rows.join(F.broadcast(hot_entries), ENTRY).select(shape))
    chains = index.where("group_size > 1").groupBy(*ENTRY).agg(F.first("keep_id").alias("keep_id"), F.first("group_size").alias("group_size"))
    chains = materialise(chains.withColumn("hot", F.lit(False)).unionByName(hot_entries.where("group_size > 1").withColumn("hot", F.lit(True))), "dedup-chains")
    chained = result.where("group_size > 1").select("doc_id")
    rows = fingerprints(having(docs, chained, id_col), id_col, text_col, digest, key, with_text=True)
    firsts = fingerprints(having(docs, chains.select(F.col("keep_id").alias("doc_id")), id_col), id_col, text_col, digest, key, with_text=True)
    odd = materialise(differing(rows, firsts, chains), "dedup-odd")
    if not odd.isEmpty():
        same = Window.partitionBy(*ENTRY, "norm")
        split = rows.join(if_small(odd), ENTRY, "left_semi").withColumns({"keep_id": F.min("doc_id").over(same), "group_size": F.count(F.lit(1)).over(same)})
        result = result.join(if_small(odd), ENTRY, "left_anti").unionByName(split.select(shape))
    return result.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with their own columns. Documents without an id all stay, as nothing tells them apart. Of an
    id with several texts the rows of those texts stay that are kept."""
    verdict = exact_dedup(docs, id_col, text_col).where(F.col("doc_id").isNotNull())
    gone = F.collect_set(F.when(~F.col("kept"), F.col("text_sha256")))  # one for each text of an id
    of_id = verdict.groupBy(F.col("doc_id").alias(id_col)).agg(F.bool_or("kept").alias("some"), gone.alias("gone")).where(F.size("gone") > 0)
    of_id = materialise(of_id, "dedup-gone")
    left = docs.join(if_small(of_id.where("NOT some").select(id_col)), id_col, "left_anti").select(*docs.columns)
    of, sha = fresh(docs, "_of"), fresh(docs, "_sha")
    parts = of_id.where("some").select(F.col(id_col).alias(of), F.explode("gone").alias(sha))  # ids with several texts
    if parts.isEmpty():
        return left
    same = (left[id_col] == F.col(of)) & (F.sha2(normalise(left[text_col]), 256) == F.col(sha))
    return left.join(if_small(parts), same, "left_anti").select(*docs.columns)
