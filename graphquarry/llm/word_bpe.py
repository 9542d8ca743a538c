"""BPE encoding and decoding through a table of distinct words.

1. Spark splits every text at white space, which no token crosses. Documents of one task are packed into chunks: the
   distinct words, and for each position the place of its word among them.
2. The distinct words of all chunks are dealt by a hash to buckets. The task that has a bucket encodes each of its
   distinct words once, however rare, and sends the ids back to the chunks.
3. A cogroup by chunk puts the ids back by position. Texts are decoded through a join of the ids of distinct words with
   the table of pieces (a hash join in Arrow, as large as the vocabulary).

Texts don't move, nor do places, which are written in buckets of chunks; only distinct words and their ids do. A word occurs once per chunk, so a frequent one makes no hot key.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, shuffle_partitions, small_batches, words_of
from .token_file import BYTE_OF

#: How the vocabulary splits text within a word, and the mark of a word's end.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
#: Words of these characters are normalised alike everywhere; others are given to the library as they are.
PLAIN = re.compile("[\x21-\x7e¡-¬®-ÿ]+")
#: Words of a chunk: a task holds one chunk at a time (a longer text is a chunk by itself).
CHUNK_WORDS = 1 << 21
#: Distinct words of chunks that a bucket takes on average. A task holds the different ones of one bucket; beyond
#: MOST_BUCKETS buckets grow instead of their number, so that rows of a chunk don't become single words.
BUCKET_WORDS = 250_000
MOST_BUCKETS = 1 << 16
#: Level of compression of what is written and shuffled.
LEVEL = 6
#: Words that are taken from a batch at once.
SLICE_WORDS = 1 << 17


def library(spec: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(spec)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def vocabulary_rows(spec: str):
    """An Arrow table of id, piece, special: all that encoding needs of a tokenizers JSON text."""
    import pyarrow as pa

    model = json.loads(spec)
    special = {t["id"]: t["content"] for t in model["added_tokens"]}
    pieces = {i: p for p, i in model["model"]["vocab"].items()} | special
    ids = sorted(pieces)
    return pa.table({"id": pa.array(ids, pa.int32()), "piece": pa.array([pieces[i] for i in ids], pa.string()), "special": pa.array([i in special for i in ids])})


class WordEncoder:
    """Ids of single words, equal to those of the tokenizers library for the given JSON text.

    A word's end is a byte that UTF-8 never has; joined to the last byte first, it stands for the vocabulary's own mark.
    """

    END = b"\xff"

    def __init__(self, spec, rows=None):
        """spec: the JSON text, or a function that gives it once a word asks for the library; rows: its vocabulary_rows()."""
        import regex
        import tiktoken

        self.spec, self.slow = spec, None
        rows = vocabulary_rows(spec) if rows is None else rows
        ids, pieces, special = (rows.column(c).to_pylist() for c in ("id", "piece", "special"))
        self.special = tuple(p for p, s in zip(pieces, special, strict=True) if s)
        ranks = {}
        for piece, i, added in zip(pieces, ids, special, strict=True):
            ended = piece.endswith(WORD_END) and piece != WORD_END
            body = bytes(BYTE_OF[c] for c in (piece[: -len(WORD_END)] if ended else piece) if c in BYTE_OF)
            if added or 0xFF in body and len(body) > 1 or 0xFF in body and ended:
                continue
            ranks[body + self.END * ended] = i
        self.fast = tiktoken.Encoding("words", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}, explicit_n_vocab=None)._core_bpe
        self.split = regex.compile(SPLIT).findall

    def __call__(self, word: str) -> list[int]:
        if not PLAIN.fullmatch(word) or any(s in word for s in self.special):
            self.slow = self.slow or library(self.spec if isinstance(self.spec, str) else self.spec())
            return self.slow.encode(word, add_special_tokens=False).ids
        out: list[int] = []
        for part in self.split(word.lower()):
            out += self.fast.encode_single_piece(part.encode() + self.END)
        return out


def pieces_table(spark, spec_broadcast) -> DataFrame:
    """id, piece, special of a vocabulary; as many rows as it has. A task reads the vocabulary, not the driver."""

    def rows(batches):
        for batch in batches:
            if batch.num_rows:
                yield from vocabulary_rows(spec_broadcast.value).to_batches()

    return spark.range(1).coalesce(1).mapInArrow(rows, "id int, piece string, special boolean")


def packed(data: bytes) -> bytes:
    import pyarrow as pa

    return len(data).to_bytes(8, "little") + pa.Codec("zstd", LEVEL).compress(data, asbytes=True)


def unpacked(data: bytes) -> bytes:
    import pyarrow as pa

    return pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def pack_numbers(numbers: np.ndarray) -> bytes:
    """Non-negative 32-bit integers, byte by byte of their four, which packs well where most are small."""
    return packed(np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack_numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(unpacked(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def chunks(docs: DataFrame, id_col: str, text_col: str, chunk_words: int) -> DataFrame:
    """Rows of documents of one task, about chunk_words words together: their ids and numbers of words, the distinct
    words in order of appearance, and for each position the place of its word among them. Words are split in Spark."""

    def pack(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        held, n, made = [], 0, 0

        def chunk():
            nonlocal held, n, made
            sizes = np.concatenate([words.value_lengths().to_numpy(zero_copy_only=False) for _, words in held])
            code = pa.concat_arrays([words.flatten() for _, words in held]).dictionary_encode()
            row = {
                "chunk": pa.array([first + made], pa.int64()),
                "doc_ids": pa.array([[i for ids, _ in held for i in ids.to_pylist()]], pa.list_(pa.int64())),
                "sizes": pa.array([sizes.tolist()], pa.list_(pa.int32())),
                "places": pa.array([pack_numbers(code.indices.to_numpy(zero_copy_only=False))], pa.binary()),
                "words": pa.array([packed(" ".join(code.dictionary.to_pylist()).encode())], pa.binary()),
                "n_words": pa.array([len(code.dictionary)], pa.int32()),
            }
            held, n, made = [], 0, made + 1
            return pa.record_batch(row)

        for batch in (part for whole in batches for part in parts(whole)):
            held.append((batch.column(0), batch.column(1)))
            n += len(batch.column(1).flatten())
            if n >= chunk_words:
                yield chunk()
        if held:
            yield chunk()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    return rows.mapInArrow(pack, "chunk long, doc_ids array<long>, sizes array<int>, places binary, words binary, n_words int")


def deal_words(packs: DataFrame, buckets: int) -> DataFrame:
    """bucket, chunk, at, words: the distinct words of each chunk, dealt by a hash; `at` are their places in the chunk."""

    def deal(batches):
        import pyarrow as pa

        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = unpacked(data).split(b" ")
                bucket = np.fromiter((zlib.crc32(w) for w in words), np.uint32, len(words)) % buckets
                order = np.argsort(bucket, kind="stable")
                names, begins = np.unique(bucket[order], return_index=True)
                slices = np.split(order, begins[1:])
                yield pa.record_batch({
                    "bucket": pa.array(names, pa.int32()),
                    "chunk": pa.array([chunk] * len(names), pa.int64()),
                    "at": pa.array([pack_numbers(np.diff(at, prepend=0)) for at in slices], pa.binary()),
                    "words": pa.array([packed(b" ".join([words[i] for i in at])) for at in slices], pa.binary()),
                })

    return packs.where("n_words > 0").select("chunk", "words").mapInArrow(deal, "bucket int, chunk long, at binary, words binary")


def encode_words(dealt: DataFrame, buckets: int, spec_broadcast, pieces_broadcast) -> DataFrame:
    """chunk, at, sizes, ids: a bucket's rows meet in one task, which encodes each of its distinct words once. It holds
    these words and reads the chunks one after the other."""

    def encode(batches):
        import pyarrow as pa

        to_ids = WordEncoder(lambda: spec_broadcast.value, pieces_broadcast.value)
        now, table = None, {}
        for batch in batches:
            sizes, ids = [], []
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if bucket != now:
                    now, table = bucket, {}
                found = []
                for word in unpacked(data).split(b" "):
                    code = table.get(word)
                    if code is None:
                        code = table[word] = np.array(to_ids(word.decode()), "<u4").tobytes()
                    found.append(code)
                sizes.append(pack_numbers(np.fromiter(map(len, found), np.int64, len(found)) // 4))
                ids.append(pack_numbers(np.frombuffer(b"".join(found), "<u4")))
            yield pa.record_batch({"chunk": batch.column(1), "at": batch.column(2), "sizes": pa.array(sizes, pa.binary()), "ids": pa.array(ids, pa.binary())})

    apart = dealt.repartition(min(buckets, 4 * shuffle_partitions(dealt.sparkSession)), "bucket").sortWithinPartitions("bucket")
    return apart.mapInArrow(encode, "chunk long, at binary, sizes binary, ids binary")


def parts(batch):
    """Slices of a batch (doc_id, words) that hold about SLICE_WORDS words each, so that memory doesn't follow the batch."""
    edges = batch.column(1).offsets.to_numpy()
    k = 0
    while k < batch.num_rows:
        stop = max(k + 1, int(np.searchsorted(edges, edges[k] + SLICE_WORDS, "right")) - 1)
        yield batch.slice(k, stop - k)
        k = stop


def chunk_table(n_words: int, coded, pieces):
    """Of a chunk's distinct words: where their ids begin and how many there are, all ids, and the decoded texts, which
    come from joining the ids with the pieces."""
    import pyarrow as pa
    import pyarrow.compute as pc

    rows = [[unpack_numbers(x) for x in coded.column(c).to_pylist()] for c in ("at", "sizes", "ids")]
    one = lambda arrays: np.concatenate(arrays).astype(np.int64) if arrays else np.zeros(0, np.int64)
    at, n, ids = one([np.cumsum(a, dtype=np.int64) for a in rows[0]]), one(rows[1]), one(rows[2])
    sizes, begins, decoded = np.zeros(n_words, np.int64), np.zeros(n_words, np.int64), np.full(n_words, "", object)
    edges = np.concatenate([[0], np.cumsum(n)])
    found = pc.take(pieces.column("piece"), pc.index_in(pa.array(ids, pa.int32()), pieces.column("id")))
    found = found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found
    sizes[at], begins[at] = n, edges[:-1]
    decoded[at] = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), found), " ").to_numpy(zero_copy_only=False)
    return sizes, begins, ids, decoded


def encode_documents(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, chunk_words: int = CHUNK_WORDS, bucket_words: int = BUCKET_WORDS
) -> DataFrame:
    """doc_id, n_tokens, and ids and decoded, or with `digests` their SHA-256 (ids as little-endian 32-bit integers).

    One row per row of the table; other columns are ignored. A null text counts as empty: no ids, an empty decoded text.
    Null ids are passed on. An empty table gives an empty result. Texts and words may have any length.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())  # a vocabulary file: its size doesn't depend on the data
    vocabulary = spark.sparkContext.broadcast(pieces_table(spark, spec).toArrow().sort_by("id").combine_chunks())
    packs = bucketed(chunks(docs, id_col, text_col, chunk_words), "word-chunks", "chunk")
    words = packs.agg(F.sum("n_words")).first()[0] or 0
    buckets = max(1, min(MOST_BUCKETS, -(-words // bucket_words)))
    coded = encode_words(deal_words(packs, buckets), buckets, spec, vocabulary)

    def encode(chunk, coded):
        import pyarrow as pa

        rows = {"doc_id": [], "n_tokens": [], "ids": [], "decoded": []}
        for pack in chunk.to_pylist():
            sizes, begins, flat, decoded = chunk_table(pack["n_words"], coded, vocabulary.value)
            places = unpack_numbers(pack["places"])
            edges = np.concatenate([[0], np.cumsum(pack["sizes"], dtype=np.int64)])
            for doc_id, a, b in zip(pack["doc_ids"], edges[:-1], edges[1:], strict=True):
                own = places[a:b]
                n = sizes[own]
                ends = np.cumsum(n)
                total = int(ends[-1]) if len(ends) else 0
                ids = flat[np.repeat(begins[own] - ends + n, n) + np.arange(total)].astype("<u4")
                text = " ".join(decoded[own[n > 0]])
                rows["doc_id"].append(doc_id)
                rows["n_tokens"].append(total)
                rows["ids"].append(hashlib.sha256(ids.tobytes()).hexdigest() if digests else ids)
                rows["decoded"].append(hashlib.sha256(text.encode()).hexdigest() if digests else text)
        names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")
        kind = pa.string() if digests else pa.list_(pa.int32())
        return pa.table({"doc_id": pa.array(rows["doc_id"], pa.int64()), "n_tokens": pa.array(rows["n_tokens"], pa.int64()), names[0]: pa.array(rows["ids"], kind), names[1]: pa.array(rows["decoded"], pa.string())})

    shape = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "n_tokens long, ids array<int>, decoded string"
    left = packs.select("chunk", "doc_ids", "sizes", "places", "n_words").groupBy("chunk")
    return left.cogroup(coded.groupBy("chunk")).applyInArrow(encode, f"doc_id long, {shape}")
