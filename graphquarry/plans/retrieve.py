"""Retrieval by the first route that fits: structure, exact names, modules, literals, then fused ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphquarry.operators import filters, graph, search

from .understanding import plan_query

MOST, OVER_FETCH = 25, 3


def retrieve(tables: dict[str, DataFrame], question: str, wanted: dict | None = None, limit: int = 5, vector: list[float] | None = None) -> tuple[str, DataFrame]:
    """(route, rows). tables: symbols, edges, chunks (id, path, text, language, module, symbol_kind, name,
    qualified_name, parent_symbol_key, start_line), vectors (id, embedding). Without a vector keywords are ranked alone."""
    if not 1 <= limit <= MOST:
        raise ValueError(f"limit from 1 to {MOST}")
    keep = filters.metadata_filter(filters.checked_filters(wanted))
    plan, chunks = plan_query(question), tables["chunks"].where(keep)
    if plan.intent in ("callers", "callees", "impact", "imports", "dependents"):
        status, found = graph.lookup(tables["symbols"], filters.names_symbol(plan.reference))
        if status == "ambiguous":
            return "candidates", found
        if status == "success":
            return "graph", structural(tables["edges"], plan.intent, found).limit(limit)
    if plan.reference:
        exact = search.exact_lookup(tables["symbols"], chunks, plan.reference, filters.in_scope(F.col("path"), plan.file) if plan.file else None)
        if not exact.isEmpty():
            return "exact", exact.limit(limit)
        if plan.intent == "definition":
            return "not_found", exact
    if plan.module:
        status, files = graph.module(chunks.select("path").distinct(), plan.module)
        if status != "not_found":
            return "module", chunks.join(files, "path", "left_semi").orderBy("path", "start_line").limit(limit)
    if len(plan.query.split()) > 1:
        lines = search.literal_lines(chunks, plan.query, "id")
        if not lines.isEmpty():
            return "literal", lines.orderBy("id", "line").limit(limit)
    fetch = min(search.MOST_CANDIDATES, limit * OVER_FETCH)
    keyword = search.ranked(search.bm25(chunks, plan.keywords.split() or [plan.query], "id"), F.desc("score"), "id", most=fetch)
    channels = {"keyword": keyword.select("id", "position")}
    if vector is not None:
        near = search.nearest(tables["vectors"].join(chunks.select("id"), "id", "left_semi"), vector, fetch, id_col="id")
        channels["semantic"] = search.ranked(near, F.desc("score"), "id", most=fetch).select("id", "position")
    best = search.fused(channels, ["id"]).join(chunks.select("id", "path", "start_line"), "id")
    order = search.final_order(F.lit(False), filters.is_document_or_test(F.col("path")) & F.lit(plan.intent == "explore"), F.lit(False), F.col("score"))
    return "hybrid" if vector is not None else "keyword", best.orderBy(*order, "path", "start_line").limit(limit)


def structural(edges: DataFrame, intent: str, found: DataFrame) -> DataFrame:
    ids = found.select("id")
    if intent == "callers":
        return graph.callers(edges, ids)
    if intent == "callees":
        return graph.callees(edges, ids)
    if intent == "imports":
        return graph.imports(edges, ids, inferred=True)
    return graph.reach(edges.where("resolution = 'resolved'"), ids, 3, search.MOST_CANDIDATES)
