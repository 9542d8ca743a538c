"""Running a plan over the tables of one generation, and the answer that comes of it."""

from __future__ import annotations

import time
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphquarry.operators import evidence, filters, graph, rules, search

from graphquarry.sources import embedding

from .router import Limits, Operation, Plan, build_plan
from .understanding import chat_intent, parse_question  # noqa: F401


#: Statuses after which operations that depend on one may run; operations on modules as well as on symbols.
CARRIED = ("success", "partial", "not_found")
MODULE_OPERATIONS = ("find_imports", "find_importers", "find_dependencies", "find_reverse_dependencies", "find_dependency_paths", "module_overview")


@dataclass
class Result:
    operation: Operation
    status: str
    rows: list[dict] = field(default_factory=list)
    truncated: bool = False
    seconds: float = 0.0


class Engine:
    """tables: symbols (id, name, qualified_name, path, start_line, ...), edges (id, source, target, relationship,
    resolution, evidence_file, evidence_line) and chunks (id, path, text)."""

    def __init__(self, tables: dict[str, DataFrame], limits: Limits = Limits()):
        self.tables, self.limits = tables, limits

    # one operation ------------------------------------------------------------------------------------------------

    def symbol(self, reference: str) -> tuple[str, DataFrame]:
        return graph.lookup(self.tables["symbols"], filters.names_symbol(reference))

    def run(self, op: Operation) -> Result:
        """One operation. What goes wrong in it is its own status and doesn't reach the others."""
        began = time.monotonic()
        try:
            status, rows, more = self._run(op)
        except ValueError as e:
            status, rows, more = "unsupported", [{"reason": str(e)}], False
        except Exception as e:  # noqa: BLE001 - an engine that fails must not take the answer with it
            status, rows, more = "error", [{"reason": type(e).__name__}], False
        return Result(op, status, rows, more, time.monotonic() - began)

    def _run(self, op: Operation) -> tuple[str, list[dict], bool]:
        n = {"graph": self.limits.graph_results, "semantic": self.limits.semantic_candidates, "rules": self.limits.rule_findings}[op.engine]
        if op.name in ("keyword_search", "semantic_search", "hybrid_search"):
            return self._bounded(self.ranked(op.name, op.targets[0], n), n, F.desc("score"), "id")
        status, found = self.symbol(op.targets[0])
        if status == "not_found" and op.name in MODULE_OPERATIONS and "modules" in self.tables:
            status, found = graph.module(self.tables["modules"], op.targets[0])
        if status != "success":
            return status, [r.asDict() for r in found.limit(n).collect()], False
        edges = self.tables["edges"]
        if op.name == "find_definition":
            return self._bounded(found, n, "id")
        if op.name in graph.OPERATIONS:
            return self._bounded(graph.OPERATIONS[op.name](edges, found), n, "evidence_file", "evidence_line", "id")
        if op.name in ("find_paths", "find_dependency_paths"):
            if len(op.targets) < 2:
                return "unsupported", [], False
            other, goals = self.symbol(op.targets[1])
            if other != "success":
                return other, [], False
            ways, cut = graph.paths(graph.resolved(edges, "CALLS" if op.name == "find_paths" else "DEPENDS_ON"), found, goals, self.limits.graph_depth, n, 50_000)
            rows = [r.asDict() for r in ways.collect()]
            return ("partial" if cut else "success") if rows else "not_found", rows, cut
        if op.name == "change_impact":
            return self._bounded(rules.change_impact(edges, found, self.limits.graph_depth), n, "depth", "id")
        if op.name == "function_contract":
            status, rows, more = self._bounded(rules.function_contract(found), n, "id")
            return "partial" if rows else status, rows, more
        rule = {"module_overview": rules.module_overview, "reference_test_analysis": rules.reference_test_analysis, "dependency_summary": rules.dependency_summary}[op.name]
        return self._bounded(rule(edges, found), n, "category", "source", "target")

    def _bounded(self, rows: DataFrame, n: int, *order) -> tuple[str, list[dict], bool]:
        some = [r.asDict() for r in rows.orderBy(*order).limit(n + 1).collect()]  # bounded by the plan's budget
        return ("partial" if len(some) > n else "success") if some else "not_found", some[:n], len(some) > n

    # a plan -------------------------------------------------------------------------------------------------------

    def ranked(self, name: str, question: str, most: int) -> DataFrame:
        """id, score of chunks by keywords, by vectors, or by both fused; without vectors keywords alone."""
        chunks = self.tables["chunks"]
        fetch = min(search.MOST_CANDIDATES, 3 * most)
        channels = {}
        if name != "semantic_search" or "vectors" not in self.tables:
            hits = search.ranked(search.bm25(chunks, question.split(), "id"), F.desc("score"), "id", most=fetch)
            channels["keyword"] = hits
        if name != "keyword_search" and "vectors" in self.tables:
            vector = embedding.embed_text(question, embedding.dimensions(self.tables["vectors"]))
            near = search.nearest(self.tables["vectors"], vector, fetch, id_col="id")
            channels["semantic"] = search.ranked(near, F.desc("score"), "id", most=fetch)
        if len(channels) == 1:
            return next(iter(channels.values())).select("id", "score")
        return search.fused({k: rows.select("id", "position") for k, rows in channels.items()}, ["id"]).select("id", "score")

    def execute(self, plan: Plan) -> list[Result]:
        """Results in the order of the plan. An operation begins when its dependencies have ended well, a few at a time and one
        semantic search among them; it is skipped if a dependency failed or wasn't there. At the deadline what still runs is
        `partial` without rows and what waits is skipped."""
        ends, by_id = time.monotonic() + self.limits.deadline_ms / 1000, {op.id: op for op in plan.operations}
        results: dict[str, Result] = {}
        running: dict[Future, Operation] = {}
        pool = ThreadPoolExecutor(self.limits.concurrent)
        try:
            while len(results) < len(by_id):
                waiting = [op for op in plan.operations if op.id not in results and op not in running.values()]
                for op in waiting:
                    states = [results[d].status if d in results else None if d in by_id else "missing" for d in op.depends_on]
                    if any(s is not None and s not in CARRIED for s in states):
                        results[op.id] = Result(op, "skipped")
                    elif None not in states and len(running) < self.limits.concurrent and not (op.engine == "semantic" and any(o.engine == "semantic" for o in running.values())):
                        running[pool.submit(self.run, op)] = op
                done, _ = wait(running, timeout=max(0.0, ends - time.monotonic()), return_when=FIRST_COMPLETED)
                for f in done:
                    results[running.pop(f).id] = f.result()
                if time.monotonic() >= ends:
                    results |= {op.id: Result(op, "partial", truncated=True) for op in running.values()}
                    results |= {op.id: Result(op, "skipped") for op in plan.operations if op.id not in results}
        finally:
            pool.shutdown(wait=False, cancel_futures=True)
        return [results[op.id] for op in plan.operations]

    def answer(self, question: str) -> dict:
        """Plan, results, coverage of each requirement, and findings admitted fairly within the evidence budget."""
        requirements = parse_question(question)
        plan = build_plan(requirements, self.limits)
        results = self.execute(plan)
        queues, admitted = {r.operation.id: list(r.rows) for r in results}, []
        while any(queues.values()) and len(admitted) < self.limits.evidence:
            for name, rows in queues.items():
                if rows and len(admitted) < self.limits.evidence:
                    admitted.append((name, rows.pop(0)))
        return {
            "requirements": [r.intent for r in requirements],
            "deferred": plan.deferred,
            "unsupported": plan.unsupported,
            "status": {r.operation.name: r.status for r in results},
            "findings": [{"citation": evidence.citation(name[:8], str(k)), **row} for k, (name, row) in enumerate(admitted)],
        }
