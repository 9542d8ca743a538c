"""Rules: bounded summaries of a symbol or module from edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph

SHAPE = ("source", "target", "relationship")


def named(rows: DataFrame, category: str) -> DataFrame:
    return rows.select(F.lit(category).alias("category"), *SHAPE)


def together(parts: dict[str, DataFrame]) -> DataFrame:
    out = None
    for category, rows in parts.items():
        out = named(rows, category) if out is None else out.unionByName(named(rows, category))
    return out


def function_contract(symbols: DataFrame) -> DataFrame:
    """What is declared: a contract from a signature is never complete."""
    return symbols.select("id", "qualified_name", "parameters", "return_annotation", "modifiers", F.lit("partial").alias("status"))


def dependency_summary(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    some = edges.where("resolution = 'resolved'")
    ids = symbols.select("id")
    return together({
        "incoming": some.join(ids.withColumnRenamed("id", "target"), "target", "left_semi"),
        "outgoing": some.join(ids.withColumnRenamed("id", "source"), "source", "left_semi"),
    })


def reference_test_analysis(edges: DataFrame, symbols: DataFrame, limit: int = 100) -> DataFrame:
    ids = graph.if_small(graph.cut(symbols.select(F.col("id").alias("target")).distinct()))
    into = graph.cut(edges.join(ids, "target", "left_semi"))  # one pass over all edges
    return together({
        "references": graph.resolved(into, "REFERENCES"),
        "callers": graph.resolved(into, "CALLS"),
        "tests": graph.test_references(into, symbols, limit)[0],
        "unresolved": into.where("resolution = 'unresolved'"),
    })


def change_impact(edges: DataFrame, symbols: DataFrame, depth: int, limit: int | None = None) -> DataFrame:
    """category, id, depth: one reverse traversal from all symbols at once; what is further than one hop is a place to
    review, not proven to break."""
    if not 1 <= depth <= 5:
        raise ValueError("depth from 1 to 5")
    found = graph.reach(edges.where("resolution = 'resolved'"), symbols, depth, limit)
    return found.select(F.when(F.col("depth") == 1, "direct_impact").otherwise("possible_impact").alias("category"), "id", "depth")


def module_overview(edges: DataFrame, modules: DataFrame) -> DataFrame:
    ids = graph.cut(modules.select("id").distinct())
    edges = graph.cut(graph.at(edges, ids))  # one pass over all edges
    out, into = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi"), edges.join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    of = lambda rows, *kinds: rows.where(F.col("relationship").isin(*kinds) & F.col("resolution").isin("resolved", "inferred"))
    return together({
        "definitions": of(out, "DEFINES"),
        "imports": of(out, "IMPORTS"),
        "dependencies": of(out, "DEPENDS_ON"),
        "dependents": of(into, "DEPENDS_ON"),
        "exports": of(out, "EXPORTS"),
        "tests": of(into, "CALLS", "REFERENCES").where(graph.is_test_path(F.col("evidence_file"))),
    })
