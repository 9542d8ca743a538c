"""The query of the near-duplicate operator, and SQL that compares full sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import minhash_dedup
from .common import documents


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(documents(spark, sf_dir))


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * both_have >= 75 * (x.n + y.n - both_have)
), reach AS (
  SELECT a AS doc_id, b AS other FROM links
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
)
SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles,
       least(w.doc_id, coalesce(min(r.other), w.doc_id)) AS component_id,
       w.doc_id <= coalesce(min(r.other), w.doc_id) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN reach r ON r.doc_id = w.doc_id
GROUP BY w.doc_id
"""

QUERIES = {"op3_minhash_dedup": op3_minhash_dedup}
ORACLES = {"op3_minhash_dedup": OP3_SQL}
