import hashlib
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from graphquarry.llm import token_file, word_bpe
from graphquarry.llm.queries_tokens import vocabulary

SHAPE = "doc_id long, text string, lang string, ids string"
TEXTS = [
    (3, "Hello  World's end, it's 2024!\n\tÜber straße", "en", "x"),
    (1, None, None, None),
    (2, "", "en", "x"),
    (5, "<|endoftext|> a<|startoftext|>b <|endoftext|>", "en", "x"),
    (8, "ΣΟΦΟΣ İstanbul éclair   nbsp wide 日本語 𝒳 👩‍🚀", "xx", "x"),
    (9, "a" * 3000 + " " + "word " * 4000, "en", "x"),
    (4, "same same", "en", "x"),
    (4, "same same", "en", "x"),
    (None, "no id", "en", "x"),
    (7, "####||***", None, "x"),
]


def library(name):
    t = Tokenizer.from_file(vocabulary(name))
    t.no_padding()
    t.no_truncation()
    return t


def test_words_are_encoded_as_the_library_does():
    import duckdb

    with open(vocabulary("word_bpe_49k.json"), encoding="utf-8") as f:
        ours = word_bpe.WordEncoder(f.read())
    rows = duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet'").fetchall()
    words = list({w for (t,) in rows for w in t.split()}) + ["x's", "y're'll", "1999", "don't!!", "a" * 500, "ÿÿ", "ÀÉ", "µ", "''s"]
    theirs = library("word_bpe_49k.json").encode_batch(words, add_special_tokens=False)
    assert [w for w, e in zip(words, theirs, strict=True) if ours(w) != e.ids] == []


def test_round_trip_of_whole_documents(spark):
    df = spark.createDataFrame(TEXTS, SHAPE)
    theirs = library("word_bpe_49k.json")
    got = sorted((r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in word_bpe.encode_documents(df, vocabulary("word_bpe_49k.json"), digests=True).collect())
    want = []
    for doc_id, text, *_ in TEXTS:
        ids = theirs.encode(text or "", add_special_tokens=False).ids
        text = theirs.decode(ids, skip_special_tokens=False)
        want.append((doc_id or 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want)
    plain = word_bpe.encode_documents(df, vocabulary("word_bpe_49k.json")).where("doc_id = 3").first()
    assert plain["ids"] == theirs.encode(TEXTS[0][1], add_special_tokens=False).ids
    assert plain["decoded"] == theirs.decode(plain["ids"], skip_special_tokens=False)


def test_slices_hold_all_rows(monkeypatch):
    import pyarrow as pa

    words = [["a"] * n for n in (3, 0, 9, 1, 1, 0)]
    batch = pa.record_batch({"doc_id": pa.array(range(6)), "words": pa.array(words, pa.list_(pa.string()))})
    for size in (1, 2, 4, 100):
        monkeypatch.setattr(word_bpe, "SLICE_WORDS", size)
        assert [w for part in word_bpe.parts(batch.slice(1)) for w in part.column(1).to_pylist()] == words[1:]


@pytest.mark.parametrize(("chunk_words", "bucket_words"), [(1, 1), (7, 3), (50, 10_000), (10_000, 10)])
def test_ids_come_back_from_any_number_of_chunks_and_buckets(spark, chunk_words, bucket_words):
    texts = [" ".join(f"w{(k * j) % 37}x{j % 5} Rare{k}" for j in range(k % 9)) for k in range(60)] + ["", None, "a" * 2000, "once-only " * 300]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in word_bpe.encode_documents(df, vocabulary("word_bpe_49k.json"), chunk_words=chunk_words, bucket_words=bucket_words).collect()}
    theirs = library("word_bpe_49k.json")
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        ids = theirs.encode(text or "", add_special_tokens=False).ids
        assert (got[k]["ids"], got[k]["n_tokens"], got[k]["decoded"]) == (ids, len(ids), theirs.decode(ids, skip_special_tokens=False))


def test_numbers_are_packed_and_unpacked():
    for numbers in ([], [0], [5, 0, 2**32 - 1, 256, 65536]):
        assert word_bpe.unpack_numbers(word_bpe.pack_numbers(np.array(numbers, np.int64))).tolist() == numbers


def test_places_are_not_shuffled(spark):
    df = spark.createDataFrame([(k, f"some words {k}") for k in range(20)], "doc_id long, text string").repartition(3)
    out = word_bpe.encode_documents(df, vocabulary("word_bpe_49k.json"), chunk_words=5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(chunk") == 1 and "Bucketed: true" in plan
    assert out.count() == 20


def test_each_word_is_in_one_bucket(spark):
    df = spark.createDataFrame([(k, "same words " * 5 + f"own{k}") for k in range(40)], "doc_id long, text string").repartition(4)
    dealt = word_bpe.deal_words(word_bpe.chunks(df, "doc_id", "text", 20), 8).collect()
    where = {}
    for r in dealt:
        for w in word_bpe.unpacked(r["words"]).split(b" "):
            where.setdefault(w, set()).add(r["bucket"])
    assert len(where) == 42 and all(len(v) == 1 for v in where.values())


def test_empty_table(spark):
    df = spark.createDataFrame([], SHAPE)
    assert word_bpe.encode_documents(df, vocabulary("word_bpe_49k.json")).count() == 0
    assert token_file.read_documents(token_file.write_tokens(df, vocabulary("byte_bpe_50k.json"))).count() == 0


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_codes_give_any_token(n):
    rng = np.random.default_rng(n)
    ids = np.concatenate([rng.integers(0, 50257, n), [0, 4095, 4096, 65535, 65536, 2**32 - 1][: n % 7]]).astype(np.uint32)
    block = token_file.Block(token_file.encode_block(ids, [7, None], [len(ids), 0]))
    assert block.doc_ids == [7, None]
    assert (block.all() == ids).all() and len(block.all()) == len(ids)
    at = rng.permutation(len(ids))
    assert (block.get(at) == ids[at]).all()
    assert (block.document(0) == ids).all() and len(block.document(1)) == 0


def test_file_holds_what_the_library_gives(spark):
    df = spark.createDataFrame(TEXTS, SHAPE)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_file.read_documents(token_file.write_tokens(df, vocabulary("byte_bpe_50k.json"))).collect())
    theirs, start, want = library("byte_bpe_50k.json"), 0, []
    for doc_id, text, *_ in sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*theirs.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((start, doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_single_tokens_are_read_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(token_file, "BLOCK_TOKENS", 700)  # blocks are made in workers, which have the module's own value
    rows = [(k, "word 2024 Ünï " * (k % 50), "x", "y") for k in range(200)] + [(500, "long text of many words " * 5000, "x", "y")]
    file = token_file.write_tokens(spark.createDataFrame(rows, SHAPE), vocabulary("byte_bpe_50k.json"))
    theirs = library("byte_bpe_50k.json")
    ids = [i for _, t, *_ in rows for i in [*theirs.encode(t, add_special_tokens=False).ids, 2]]
    places = [0, len(ids) - 1, len(ids), -1, None, 5, 5, *range(3, len(ids), 997)]
    got = token_file.read_at(file, spark.createDataFrame([(p,) for p in places], "position long")).collect()
    assert sorted((r["position"], r["id"]) for r in got) == sorted((p, ids[p]) for p in places if p is not None and 0 <= p < len(ids))
    whole = sorted(map(tuple, token_file.read_documents(file).collect()))
    assert whole == sorted(map(tuple, token_file.read_documents(file, slice_tokens=100).collect()))
