"""What an answer is put together from: groups, context blocks, excerpts' fences, summaries that need no model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import filters, graph

#: Characters of a context, findings shown at each depth, what a test or document loses in a conversation.
CONTEXT_CHARS, DEPTHS, DEMOTION, MOST_NEIGHBOURS = 24_000, {"quick": 1, "standard": 8, "deep": 25}, 0.15, 500


def fence(text: Column) -> Column:
    """Backticks, three at least and more than the text has in a row."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), F.length)
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


def without_citations(text: Column) -> Column:
    """Without numbers in brackets that stand outside of code."""
    kept = F.regexp_replace(text, r"(```[\s\S]*?```|`[^`\n]+`)|(?<!\w)\[\s*\d+(?:\s*[,;]\s*\d+)*\s*\]", "$1")
    return F.regexp_replace(kept, r"^\s+|\s+$", "")


def context(chunks: DataFrame, budget: int = CONTEXT_CHARS) -> DataFrame:
    """rank, section of the chunks (rank, path, start_line, end_line, language, text) of one question, numbered and fenced, up to
    the first that doesn't fit the budget."""
    mark, nl = fence(F.col("text")), F.lit("\n")
    place = F.concat("path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    order = Window.orderBy("rank")  # the chunks of one question
    rows = chunks.withColumn("n", F.row_number().over(order))
    rows = rows.withColumn("section", F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), place, nl, mark, F.coalesce("language", F.lit("")), nl, F.col("text"), nl, mark))
    return rows.withColumn("used", F.sum(F.length("section")).over(order)).where(F.col("used") <= budget).select("rank", "section")


def graph_first(related: DataFrame, ranked: DataFrame, most: int) -> DataFrame:
    """Chunks (path, chunk_index) of files that the graph leads to, then ranked ones, each once."""
    both = related.withColumns({"side": F.lit(0), "score": F.lit(None).cast("double")}).unionByName(ranked.withColumn("side", F.lit(1)))
    order = (F.col("side"), F.desc_nulls_last("score"), F.col("path"), F.col("chunk_index"))
    one = both.withColumn("n", F.row_number().over(Window.partitionBy("path", "chunk_index").orderBy(*order))).where("n = 1").drop("n")
    return one.orderBy(*order).limit(most).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def caller_groups(edges: DataFrame) -> DataFrame:
    """target, source and the places of its call sites, in order."""
    return edges.groupBy("target", "source").agg(F.array_sort(F.collect_set(F.struct("evidence_file", "evidence_line"))).alias("sites"))


def file_listing(symbols: DataFrame) -> DataFrame:
    """path and its symbols in the order of their lines."""
    return symbols.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start_line", "name"))).alias("symbols"))


def neighbours(edges: DataFrame, ids: DataFrame | None, relationship: str, reverse: bool = False, most: int = MOST_NEIGHBOURS) -> DataFrame:
    """id, neighbour: of each node its neighbours by a relationship, each once, the first `most` in order; ids (id) None: of every
    node. The rows are counted, and dealt by node to as many tasks as their number asks for."""
    here, there = ("target", "source") if reverse else ("source", "target")
    rows = edges.where(F.col("relationship") == relationship).select(F.col(here).alias("id"), F.col(there).alias("neighbour"))
    n = graph.tasks(rows) if ids is None else graph.tasks(rows, ids)
    rows = rows.repartition(n, "id")
    if ids is not None:
        rows = rows.join(ids.select("id").repartition(n, "id").hint("merge"), "id", "left_semi")
    rows = rows.distinct()
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("neighbour"))).where(F.col("n") <= most).drop("n")


def expanded(hits: DataFrame, edges: DataFrame, seeds: int = 3, each: int = 10) -> DataFrame:
    """id, position: callees of the best hits (id, position) as a channel of their own, `each` of a hit, resolved calls only."""
    best = hits.where(F.col("position") <= seeds).select(F.col("id").alias("source"), F.col("position").alias("of"))
    calls = edges.where("relationship = 'CALLS' AND resolution = 'resolved'").select("source", "target").distinct().join(F.broadcast(best), "source")  # at most `seeds` rows
    rows = calls.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("target"))).where(F.col("n") <= each)
    first = rows.groupBy(F.col("target").alias("id")).agg(F.min(F.struct("of", "n")).alias("at"))
    return first.select("id", F.row_number().over(Window.orderBy("at", "id")).alias("position"))  # at most seeds * each rows


def examined(edges: DataFrame, frontier: DataFrame, most: int = 100, reverse: bool = True) -> DataFrame:
    """The edges at a frontier (id) that a bounded retrieval looks at: resolved ones first, by file, line and id; of those the
    first to each new node."""
    here, there = ("target", "source") if reverse else ("source", "target")
    order = [F.col("resolution") != "resolved", F.col("evidence_file").asc_nulls_first(), F.col("evidence_line").asc_nulls_first(), F.col("id")]
    some = edges.join(frontier.select(F.col("id").alias(here)), here, "left_semi").orderBy(*order).limit(most)
    first = Window.partitionBy(there).orderBy(*order)  # of at most `most` rows
    return some.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def in_order(edges: DataFrame, label: str = "target_label") -> DataFrame:
    """Edges by file, line and label; what has no place stands first."""
    return edges.orderBy(F.col("evidence_file").asc_nulls_first(), F.col("evidence_line").asc_nulls_first(), label)


def conversational(hits: DataFrame) -> DataFrame:
    """Hits (rank, path, name, score) for a conversation: documents and tests lose DEMOTION; equal scores keep their rank."""
    low = filters.is_document_or_test(F.col("path")) | F.col("name").startswith("test_")
    return hits.withColumn("score", F.col("score") - F.when(low, DEMOTION).otherwise(0.0)).orderBy(F.desc("score"), "rank")


def suggestions(nodes: DataFrame, part: str, most: int = 5) -> DataFrame:
    """Nodes whose name holds what was asked for."""
    return nodes.where(F.contains(F.lower("name"), F.lit(part.lower()))).orderBy("name", "id").limit(most)


def listing(title: str, rows: DataFrame, name: str = "name", path: str = "path", line: str = "line") -> str:
    """A text of a bounded result: a title and a line for each row."""
    found = rows.select(name, path, line).limit(MOST_NEIGHBOURS).collect()  # bounded
    return "\n".join([f"{title}: {len(found)}", *(f"- {r[name]} ({r[path]}:{r[line]})" for r in found)])


def shown(findings: DataFrame, depth: str = "standard") -> DataFrame:
    """The first findings (requirement, rank) of each requirement, as many as a depth of presentation has."""
    n = F.row_number().over(Window.partitionBy("requirement").orderBy("rank"))
    return findings.withColumn("n", n).where(F.col("n") <= DEPTHS[depth]).drop("n")


def summary(findings: DataFrame) -> DataFrame:
    """requirement, text: what is known of each requirement in sentences made from its findings (category, status, label) alone, for
    when no model writes one."""
    per = findings.groupBy("requirement", "category").agg(F.count(F.lit(1)).alias("n"), F.slice(F.array_sort(F.collect_set("label")), 1, 3).alias("names"), F.bool_or(F.col("status") == "partial").alias("partial"))
    line = F.concat(F.col("n").cast("string"), F.lit(" "), F.col("category"), F.lit(": "), F.array_join("names", ", "), F.when(F.col("n") > F.size("names"), ", ...").otherwise(""), F.when(F.col("partial"), " (incomplete)").otherwise(""))
    sentences = F.array_sort(F.collect_list(F.struct("category", line.alias("line"))))
    return per.groupBy("requirement").agg(F.array_join(F.transform(sentences, lambda s: s["line"]), "\n").alias("text"))
