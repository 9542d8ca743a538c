"""Queries of the operators on words and pieces of texts and on pages, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fill_in_middle, html_extraction, spelling_variants
from .common import documents


def slip(doc_id: Column, run: Column) -> Column:
    """The run without one code point if 97 divides the crc32 of `<doc_id>:<run>`; a null id counts as the empty text."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = F.pmod(h, F.length(run)).cast("int")
    return F.when(h % 97 == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.grouped(documents(spark, sf_dir), edit=slip)


OP11_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_concat([b], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t
  FROM (SELECT unnest(range(256)) AS b)
), runs AS (
  SELECT doc_id, run, count(*) AS k, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS bytes
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY doc_id, run
), hashed AS (
  SELECT run, k, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(bytes), 2), lambda i: ('0x' || substr(bytes, i, 2))::BIGINT)),
                                 lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM runs, crc
), words AS (
  SELECT word, sum(k)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3
), holes AS (
  SELECT word, n, i, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), shorter AS (SELECT DISTINCT h.word AS a, w.word AS b FROM holes h JOIN words w ON w.word = h.head || h.tail),
pairs AS (
  SELECT x.word AS a, y.word AS b FROM holes x JOIN holes y ON y.i = x.i AND y.head = x.head AND y.tail = x.tail AND y.word <> x.word
  UNION ALL SELECT a, b FROM shorter UNION ALL SELECT b, a FROM shorter
), best AS (
  SELECT p.a AS word, count(*) AS n_near, min({'less': -w.n, 'word': p.b}) AS top FROM pairs p JOIN words w ON w.word = p.b GROUP BY p.a
), forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN -b.top.less >= 2 * w.n THEN b.top.word END AS form, CASE WHEN -b.top.less >= 2 * w.n THEN -b.top.less END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word
), walk AS (
  SELECT word, word AS root, 0 AS step FROM forms
  UNION ALL
  SELECT k.word, f.form, k.step + 1 FROM walk k JOIN forms f ON f.word = k.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n
FROM forms f JOIN (SELECT word, arg_max(root, step) AS root FROM walk GROUP BY word) r ON r.word = f.word
"""


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = fill_in_middle.transform(docs, fill_in_middle.plan_of(F.col("doc_id"), seed=7))
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^
]*
|[^
]+') AS lines,
         sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), c AS (
  SELECT *, len(lines) AS n, ('0x' || h[1:8])::BIGINT % (len(lines) + 1) AS r1, ('0x' || h[9:16])::BIGINT % (len(lines) + 1) AS r2,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 100 THEN 'plain'
              WHEN ('0x' || h[25:32])::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), p AS (
  SELECT *, coalesce(array_to_string(lines[1:least(r1, r2)], ''), '') AS prefix,
         coalesce(array_to_string(lines[least(r1, r2) + 1:greatest(r1, r2)], ''), '') AS middle,
         coalesce(array_to_string(lines[greatest(r1, r2) + 1:], ''), '') AS suffix
  FROM c
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op11_spelling_variants": op11_spelling_variants, "op12_fill_in_middle": op12_fill_in_middle, "op13_html_extraction": op13_html_extraction}
ORACLES = {"op11_spelling_variants": OP11_SQL, "op12_fill_in_middle": OP12_SQL}
