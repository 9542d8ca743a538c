"""An inverted index for keyword ranking: texts are tokenised once, and a question reads only the postings of its terms.

Postings are dealt by document, in as many buckets as a shuffle has partitions, and stand by term within a bucket. So the
scores of a document are summed where its postings lie, without a shuffle, and files skip the terms that nobody asked for.
Only the best of each bucket go on to the ranking of a question.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphquarry.functions import text as T

from .graph import if_small, shared_folder
from .search import PLACES, idf

#: Asked terms that are looked up by a list in the scan, so that files are skipped by it.
LISTED = 2_000


@dataclass(frozen=True)
class Index:
    """postings: id, term, tf, size (tokens of the document); n and mean: documents and their mean size."""

    postings: DataFrame
    n: int
    mean: float


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of all texts, as files in the shared folder. A null or empty text counts as a document without tokens. Ids
    are unique; a null id is kept as an id. An empty table gives an empty index."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), T.tokens(F.col(text_col)).alias("tokens"))
    rows = rows.withColumn("size", F.size("tokens"))
    table, root = f"postings_{uuid.uuid4().hex}", shared_folder(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    # dealt once, as texts; a document's terms are then counted, and written, where its bucket is
    pairs = rows.repartition(n, "id").select("id", "size", F.explode_outer("tokens").alias("term")).groupBy("id", "size", "term").agg(F.count("term").cast("int").alias("tf"))
    pairs.write.format("parquet").option("path", f"{root}/{table}").bucketBy(n, "id").sortBy("term").saveAsTable(table)
    postings = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the name only: its files stay in the shared folder
    sizes = postings.groupBy("id").agg(F.first("size").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean")).first()
    return Index(postings, sizes["n"], sizes["mean"] or 0.0)


def ranked(index: Index, questions: DataFrame, k: int, among: DataFrame | None = None) -> DataFrame:
    """query_id, id, score, position: the k best documents of each question (query_id, terms), best score first, then by id.

    Terms are tokens, each counted once a question. With `among` (id) only those documents are ranked, before the k best are
    taken; the statistics are still those of all documents. A question whose terms no document has gives no row.
    """
    asked = questions.select("query_id", F.explode(F.array_distinct(F.transform("terms", F.lower))).alias("term"))
    wanted = asked.select("term").distinct()
    few = [r["term"] for r in wanted.limit(LISTED + 1).collect()]  # bounded
    holds = index.postings.where(F.col("term").isin(few)) if len(few) <= LISTED else index.postings.join(if_small(wanted), "term", "left_semi")
    rows = holds
    if among is not None:
        rows = rows.join(if_small(among.select("id").distinct()), "id", "left_semi")
    weights = holds.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", idf(F.lit(index.n), F.col("df")).alias("weight"))
    of = if_small(asked.join(weights, "term"))
    share = F.col("weight") * F.col("tf") * (T.K1 + 1) / (F.col("tf") + T.K1 * (1 - T.B + T.B * F.col("size") / F.lit(index.mean or 1.0)))
    scores = rows.join(of, "term").groupBy("query_id", "id").agg(F.round(F.sum(share), PLACES).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scores.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)
