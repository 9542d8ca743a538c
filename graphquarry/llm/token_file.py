"""Token ids as directly addressable codes on shared files.

An id is split into chunks of LEVELS bits, lowest first. Level 1 has one chunk for every token; the tokens whose id has
more bits are marked in the level's continuation bitmap, and their next chunks follow one another in level 2. A rank
directory (ones before each run of RANK_STEP bits) turns a token's place in one level into its place in the next, so any
token can be read without decoding those before it.

A file is a Parquet data set whose rows are blocks of whole documents in ascending order of doc_id: `part` and `block`
give the order, `before` the ids of the part before the block, `payload` is the block in the format above. `directory`
has the number of ids before each part.
"""

from __future__ import annotations

import json
import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import materialise, shuffle_partitions, small_batches

#: Fixed values of the format.
MAGIC = b"DAC1"
LEVELS = (12, 4, 16)
RANK_STEP = 512
END_ID = 2
BLOCK_TOKENS = 1 << 20
#: Ids that are read at once, and readers that share the places wanted from one block.
SLICE_TOKENS, READERS = 1 << 16, 8
#: Texts of these characters split alike in both tokenizer libraries; others go to the slower one, which is the measure.
PLAIN = re.compile("[^\t\n\r\x20-\x7e¡-¬®-ɏ‐-‧€]")


def pack(values: np.ndarray, bits: int) -> bytes:
    """Chunks of a multiple of four bits, as nibbles, lowest first."""
    if bits == 16:
        return values.astype("<u2").tobytes()
    per = bits // 4
    nibbles = np.empty((len(values), per), np.uint8)
    for k in range(per):
        nibbles[:, k] = (values >> (4 * k)) & 15
    flat = nibbles.ravel()
    if len(flat) % 2:
        flat = np.append(flat, np.uint8(0))
    return (flat[0::2] | (flat[1::2] << 4)).tobytes()


def unpack_at(data: np.ndarray, bits: int, at: np.ndarray) -> np.ndarray:
    """The chunks at the given places."""
    out = np.zeros(len(at), np.uint32)
    for k in range(bits // 4):
        nibble = at * (bits // 4) + k
        out |= ((data[nibble >> 1] >> ((nibble & 1) << 2).astype(np.uint8)) & 15).astype(np.uint32) << np.uint32(4 * k)
    return out


def unpack_all(data: np.ndarray, bits: int, n: int) -> np.ndarray:
    nibbles = np.empty(2 * len(data), np.uint8)
    nibbles[0::2], nibbles[1::2] = data & 15, data >> 4
    table = nibbles[: n * (bits // 4)].reshape(n, bits // 4)
    out = table[:, 0].astype(np.uint32)
    for k in range(1, bits // 4):
        out |= table[:, k].astype(np.uint32) << np.uint32(4 * k)
    return out


def encode_block(ids: np.ndarray, doc_ids, lengths) -> bytes:
    """ids: of all documents of the block. A doc_id may be None."""
    known = np.array([d is not None for d in doc_ids], np.uint8)
    parts = [MAGIC, struct.pack("<IQ", len(doc_ids), len(ids)), known.tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.asarray(lengths, "<u4").tobytes()]
    values = ids.astype(np.uint32)
    for bits in LEVELS:
        more = values >= (1 << bits)
        bitmap = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(more, np.arange(0, len(more), RANK_STEP), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
        ranks = np.concatenate([[0], np.cumsum(ones)[:-1]]) if len(ones) else ones
        chunk = pack(values & ((1 << bits) - 1), bits)
        parts += [struct.pack("<QQ", len(values), len(chunk)), chunk, bitmap.tobytes(), ranks.astype("<u4").tobytes()]
        values = values[more] >> bits
    return b"".join(parts)


class Block:
    """A block of the file: documents, and random access to the ids."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a block of token ids")
        n_docs, self.n_tokens = struct.unpack_from("<IQ", payload, 4)
        at = 16
        known = np.frombuffer(payload, np.uint8, n_docs, at)
        at += n_docs
        numbers = np.frombuffer(payload, "<i8", n_docs, at)
        self.doc_ids = [int(d) if k else None for d, k in zip(numbers, known, strict=True)]
        at += 8 * n_docs
        self.lengths = np.frombuffer(payload, "<u4", n_docs, at).astype(np.int64)
        at += 4 * n_docs
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.levels = []
        for bits in LEVELS:
            n, size = struct.unpack_from("<QQ", payload, at)
            at += 16
            chunk = np.frombuffer(payload, np.uint8, size, at)
            at += size
            bitmap = np.frombuffer(payload, np.uint8, (n + 7) // 8, at)
            at += (n + 7) // 8
            ranks = np.frombuffer(payload, "<u4", -(-n // RANK_STEP), at)
            at += 4 * len(ranks)
            self.levels.append((bits, n, chunk, bitmap, ranks))

    def get(self, positions) -> np.ndarray:
        """The ids at any places, each read through the rank directories alone."""
        at = np.asarray(positions, np.int64)
        out, mine, shift = np.zeros(len(at), np.uint32), np.arange(len(at)), 0
        for bits, _, chunk, bitmap, ranks in self.levels:
            if not len(at):
                break
            out[mine] |= unpack_at(chunk, bits, at) << np.uint32(shift)
            more = (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            mine, at = mine[more], at[more]
            at = ranked(bitmap, ranks, at)
            shift += bits
        return out

    def all(self) -> np.ndarray:
        """All ids at once."""
        values = None
        for bits, n, chunk, bitmap, _ in reversed(self.levels):
            own = unpack_all(chunk, bits, n)
            if values is not None and len(values):
                more = np.unpackbits(bitmap, count=n, bitorder="little").view(bool)
                own[more] |= values << np.uint32(bits)
            values = own
        return values

    def document(self, k: int) -> np.ndarray:
        return self.get(np.arange(self.starts[k], self.starts[k + 1]))


ONES = np.array([bin(b).count("1") for b in range(256)], np.int64)


def ranked(bitmap: np.ndarray, ranks: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The ones of a bitmap before each place: the directory's, and those of the place's own run before it."""
    size = RANK_STEP // 8
    runs, own = np.unique(at // RANK_STEP, return_inverse=True)
    places = runs[:, None] * size + np.arange(size)
    counts = np.where(places < len(bitmap), ONES[bitmap[np.minimum(places, len(bitmap) - 1)]], 0).astype(np.int64)
    before = np.cumsum(counts, 1) - counts
    byte = at >> 3
    inside = ONES[bitmap[byte] & ((1 << (at & 7)) - 1)]
    return ranks[runs][own].astype(np.int64) + before[own, byte % size] + inside


class ByteEncoder:
    """Ids of the byte-level vocabulary in a tokenizers JSON file (given as text), equal to that library's."""

    def __init__(self, spec: str):
        import tiktoken
        from tokenizers import Tokenizer

        model = json.loads(spec)
        self.slow = Tokenizer.from_str(spec)
        self.slow.no_padding()
        self.slow.no_truncation()
        self.special = [t["content"] for t in model["added_tokens"]]
        ranks = {unshown(piece): i for piece, i in model["model"]["vocab"].items() if piece not in self.special}
        self.fast = tiktoken.Encoding("bytes", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if PLAIN.search(text) or any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=())


#: How the vocabulary splits text, and how its file shows bytes as characters.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_OF = {chr(b): b for b in SHOWN} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in SHOWN)}


def unshown(piece: str) -> bytes:
    return bytes(BYTE_OF[c] for c in piece)


def write_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Encode all documents and write the file to the shared folder; returns its rows: part, block,
    before (ids of the part before the block), n_tokens, payload.

    A null text counts as empty and leaves the end id alone. Documents without an id come first. Repeated rows are
    written each. An empty table gives a file without blocks.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())  # a vocabulary file: its size doesn't depend on the data

    def blocks(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode, part, block, before = ByteEncoder(spec.value), TaskContext.get().partitionId(), 0, 0
        ids, names, lengths, waiting = [], [], [], 0

        def flush():
            flat = np.concatenate(ids)
            return pa.record_batch({"part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()), "before": pa.array([before], pa.int64()), "n_tokens": pa.array([len(flat)], pa.int64()), "payload": pa.array([encode_block(flat, names, lengths)], pa.binary())})

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                own = np.append(encode(text.as_py() or ""), np.uint32(end_id))
                ids.append(own)
                names.append(doc_id.as_py())
                lengths.append(len(own))
                waiting += len(own)
                if waiting >= BLOCK_TOKENS:
                    yield flush()
                    block, before = block + 1, before + waiting
                    ids, names, lengths, waiting = [], [], [], 0
        if ids:
            yield flush()

    order = F.col("doc_id").asc_nulls_first()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(shuffle_partitions(spark), order).sortWithinPartitions(order, "text")
    return materialise(rows.mapInArrow(blocks, "part int, block int, before long, n_tokens long, payload binary"), "token-file")


def directory(file: DataFrame) -> DataFrame:
    """part, base: the ids before each part. As many rows as the file was written in parts, which is bounded by the number
    of shuffle partitions."""
    parts = file.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(W.Window.orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    return parts.select("part", before.alias("base"))


def slices(edges: np.ndarray, most: int):
    """Runs of documents that hold about `most` ids each."""
    k = 0
    while k < len(edges) - 1:
        stop = max(k + 1, int(np.searchsorted(edges, edges[k] + most, "right")) - 1)
        yield k, stop
        k = stop


def read_documents(file: DataFrame, slice_tokens: int = SLICE_TOKENS) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, from the file alone. Ids are read by their addresses, some documents at a time."""

    def digests(batches):
        import pyarrow as pa

        for batch in batches:
            for start, payload in zip(batch.column(0), batch.column(1), strict=True):
                block, first = Block(payload.as_py()), start.as_py()
                edges = block.starts
                for k, stop in slices(edges, slice_tokens):
                    raw = memoryview(block.get(np.arange(edges[k], edges[stop])).astype("<u4").tobytes())
                    own = edges[k : stop + 1] - edges[k]
                    yield pa.record_batch(
                        {
                            "doc_id": pa.array(block.doc_ids[k:stop], pa.int64()),
                            "start": pa.array(edges[k:stop] + first, pa.int64()),
                            "n_tokens": pa.array(block.lengths[k:stop], pa.int64()),
                            "ids_crc32": pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(own[:-1], own[1:], strict=True)], pa.int64()),
                        }
                    )

    rows = file.select("part", "before", "payload").join(F.broadcast(directory(file)), "part")
    return rows.select((F.col("base") + F.col("before")).alias("start"), "payload").mapInArrow(digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_at(file: DataFrame, wanted: DataFrame, position_col: str = "position") -> DataFrame:
    """position, id of single tokens anywhere in the file. Only the blocks that hold a wanted place are read, and in them only
    what its address needs. Places before 0 or after the end, and null, give no row; a place asked for twice gives two."""
    blocks = file.select("part", "before", "n_tokens", "payload").join(F.broadcast(directory(file)), "part").withColumn("begin", F.col("base") + F.col("before"))
    cell = lambda c: F.floor(c / BLOCK_TOKENS)
    blocks = blocks.where("n_tokens > 0").withColumn("cell", F.explode(F.sequence(cell(F.col("begin")), cell(F.col("begin") + F.col("n_tokens") - 1))))
    asked = wanted.select(F.col(position_col).cast("long").alias("position")).withColumn("cell", cell(F.col("position")))
    inside = (F.col("position") >= F.col("begin")) & (F.col("position") < F.col("begin") + F.col("n_tokens"))
    places = blocks.select("part", "before", "begin", "n_tokens", "cell").join(asked, "cell").where(inside)
    places = places.groupBy("part", "before", "begin", F.floor(F.rand(1) * READERS).alias("reader")).agg(F.collect_list("position").alias("positions"))
    found = places.join(file.select("part", "before", "payload"), ["part", "before"])

    def tokens(batches):
        import pyarrow as pa

        for batch in batches:
            for begin, positions, payload in zip(*(batch.column(k) for k in range(3)), strict=True):
                at = np.array(positions.as_py(), np.int64)
                yield pa.record_batch({"position": pa.array(at), "id": pa.array(Block(payload.as_py()).get(at - begin.as_py()).astype(np.int64))})

    return found.select("begin", "positions", "payload").mapInArrow(tokens, "position long, id long")
