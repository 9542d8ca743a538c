import hashlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from graphquarry.llm.queries_tokens import vocabulary

DATA = "/root/testdata/sf0.001"


def test_every_stage_works_on_what_the_one_before_kept(spark, tmp_path):
    docs, seen = spark.read.parquet(f"{DATA}/documents.parquet"), {}
    columns = docs.columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
        seen[name] = ids(docs)
        assert seen[name] <= ids(before)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    good = {i for i, q in labels.items() if q == 1}
    assert len(seen["quality"] & good) >= 0.98 * len(good)
    first = {}
    for i in sorted(seen["quality"]):
        first.setdefault(" ".join(texts[i].replace("\n", " ").split(" ")), i)
    assert seen["exact_dedup"] == set(first.values())
    assert seen["encode"] == seen["mix"] and 0 < len(seen["mix"]) < len(seen["near_dedup"])
    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    for r in docs.collect():
        want = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()


def test_stages_take_empty_tables_and_rows_without_id(spark):
    whole = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(None, "a text without an id that says enough to be kept by all of the stages", "en", "src1", 60), (None, None, None, None, None), (7_000_001, "", "en", None, 0)], whole.schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, whole.limit(0), DATA).count() == 0, name
        out = stage(spark, whole.limit(40).unionByName(odd), DATA)
        assert name == "encode" or out.columns == whole.columns
        if name in ("quality", "exact_dedup", "near_dedup"):
            assert out.where("doc_id IS NULL").count() >= 1, name


def test_near_stage_equals_brute_force(spark):
    from test_near import brute

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = {i for i, _, _, kept in brute([(r["doc_id"], r["text"]) for r in docs.collect()]) if kept}
    assert {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, DATA).collect()} == want
