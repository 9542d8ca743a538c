"""Evidence: fair admission, quarantine, classes of claims, coverage, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def admitted(findings: DataFrame, requirement: str, order: list[str], most: int) -> DataFrame:
    """The n-th finding of every requirement before any (n + 1)-th. A requirement has no more than `most` candidates
    after the first filter, so only those are sorted together."""
    n = F.row_number().over(Window.partitionBy(requirement).orderBy(*order))
    return findings.withColumn("turn_of", n).where(F.col("turn_of") <= most).orderBy("turn_of", requirement).limit(most)


def distinct_findings(findings: DataFrame, limit: int) -> DataFrame:
    """One finding for each category, class and details; the first ones of each category."""
    one = findings.dropDuplicates(["category", "classification", "details"])
    return one.withColumn("n", F.row_number().over(Window.partitionBy("category").orderBy("details"))).where(F.col("n") <= limit).drop("n")


def quarantined(links: DataFrame, bad: DataFrame) -> DataFrame:
    """Links (claim, evidence) of the claims that share no bad evidence."""
    tainted = links.join(bad.select("evidence").distinct(), "evidence", "left_semi").select("claim").distinct()
    return links.join(tainted, "claim", "left_anti")


def claim_class(kind: Column, category: Column, classification: Column, has_edge: Column, path_length: Column | None = None) -> Column:
    path = F.lit(0) if path_length is None else F.coalesce(path_length, F.lit(0))
    return (
        F.when((kind == "semantic") | (kind == "definition"), "verified_source_observation")
        .when(kind == "graph", F.when(path > 0, "derived_analysis").otherwise("verified_graph_relationship"))
        .when(category.isin("unresolved_relationship", "candidate"), "unresolved_assertion")
        .when((classification == "hypothesis") | (category == "possible_impact"), "hypothetical_consequence")
        .when(classification == "derived_finding", "derived_analysis")
        .when(has_edge, "verified_graph_relationship")
        .otherwise("verified_source_observation")
    )


def coverage(results: DataFrame, requirement: str) -> DataFrame:
    """complete, partial or missing for each requirement, by the status of its operations."""
    good = F.col("status").isin("success", "partial")
    state = F.when(F.bool_and(good), "complete").when(F.bool_or(good), "partial").otherwise("missing")
    return results.groupBy(requirement).agg(state.alias("coverage"), F.count_if(good).alias("findings"))


def chain_is_valid(nodes: Column, edges: Column) -> Column:
    """Edges (source, target) lead from each node of a path to the next."""
    pairs = F.zip_with(F.slice(nodes, 1, F.greatest(F.size(nodes) - 1, F.lit(0))), F.slice(nodes, 2, F.greatest(F.size(nodes), F.lit(1))), lambda a, b: F.struct(a.alias("source"), b.alias("target")))
    return (F.size(edges) == F.size(nodes) - 1) & F.forall(F.arrays_zip(pairs.alias("p"), edges.alias("e")), lambda x: (x["p"]["source"] == x["e"]["source"]) & (x["p"]["target"] == x["e"]["target"]))


def packed(records: list[tuple[str, int]], budget: int) -> tuple[list[str], list[str]]:
    """Ids that fit a byte budget in order, and those left out: a record that doesn't fit is skipped, later ones may
    still fit. For the bounded number of records of one answer."""
    kept, left, used = [], [], 0
    for name, size in records:
        if used + size <= budget:
            kept.append(name)
            used += size
        else:
            left.append(name)
    return kept, left


def citation(package: str, record: str, prefix: str = "evidence") -> str:
    """prefix:package:record; the prefix is a parameter."""
    return f"{prefix}:{package}:{record}"
