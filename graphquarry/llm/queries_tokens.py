"""Queries of the tokenizing operators. SQL can't express them: they are tested against the tokenizers library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import token_file, word_bpe
from .common import documents


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.encode_documents(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), digests=True)


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.read_documents(token_file.write_tokens(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json")))


QUERIES = {"op6_bpe_encode_decode": op6_bpe_encode_decode, "op9_token_file": op9_token_file}
ORACLES: dict[str, str] = {}
