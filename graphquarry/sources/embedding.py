"""Files that are worth indexing, and vectors for them without a model: signed hashes of their tokens."""

from __future__ import annotations

import json
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphquarry.functions import text as T

from . import inventory

#: Extensions of files that are indexed, their largest size, the size of a vector, and directories left out
#: besides those of the inventory.
EXTENSIONS = "json yaml yml toml ini py js cjs mjs ts mts cts jsx tsx java go rs rb php scala swift md markdown html htm c h cpp hpp cs".split()
MOST_BYTES, DIMENSIONS = 1_000_000, 384


def indexable(files: DataFrame) -> DataFrame:
    """Files (path, content, and target if links were resolved) with a known extension, outside of directories that are left out,
    not empty and not too large. A link that leads out of the repository (its target is no relative path) is left out."""
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    size = F.octet_length("content")
    keep = suffix.isin(*EXTENSIONS) & ~inventory.is_excluded(F.col("path")) & (size > 0) & (size <= MOST_BYTES)
    if "target" in files.columns:
        keep = keep & (F.col("target").isNull() | ~F.col("target").rlike(r"^/|(^|/)\.\.(/|$)"))
    return files.where(keep)


def embed_text(text: str, size: int = DIMENSIONS) -> list[float]:
    """The vector of one text; the same as embedded() gives."""
    terms = [t for w in text.split() for t in T.phrase_of(w)]
    return vector([zlib.crc32(t.encode()) for t in terms], size).tolist()


def vector(hashes, size: int) -> np.ndarray:
    """Signed counts of hashes at length 1; the first axis for a text without tokens."""
    h = np.asarray(hashes, np.int64)
    out = np.bincount(h % size, np.where((h >> 16) & 1, 1.0, -1.0), size)
    length = np.sqrt((out * out).sum())
    if not length:
        out[0] = length = 1.0
    return (out / length).astype(np.float32)


def embedded(docs: DataFrame, id_col: str = "id", text_col: str = "text", size: int = DIMENSIONS) -> DataFrame:
    """id, embedding of texts. Tokens are made and hashed in Spark; a batch of numbers goes to Python."""
    hashes = F.transform(T.tokens(F.col(text_col)), lambda t: F.crc32(t.cast("binary")))
    rows = docs.select(F.col(id_col).alias("id"), hashes.alias("hashes"))

    def vectors(batches):
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(1)
            flat, edges = lists.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
            made = [vector(flat[a:b], size) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.record_batch({"id": batch.column(0), "embedding": pa.array(made, pa.list_(pa.float32()))})

    return rows.mapInArrow(vectors, f"id {dict(rows.dtypes)['id']}, embedding array<float>")


def dimensions(vectors: DataFrame) -> int:
    row = vectors.select(F.size("embedding").alias("n")).first()
    return row["n"] if row else DIMENSIONS


def fingerprint(model: str, size: int, overlap: int, schema: int, chunking: int, backend: str) -> str:
    """What an index depends on besides its files: if it differs, all files are indexed anew."""
    return json.dumps([model, size, overlap, schema, chunking, backend])


def to_index(files: DataFrame, indexed: DataFrame, now: str, before: str | None) -> DataFrame:
    """The files (path, content_sha256) that have to be indexed: all if the fingerprint is another, else those that changed."""
    return files if now != before else files.join(indexed.select("path", "content_sha256"), ["path", "content_sha256"], "left_anti")
