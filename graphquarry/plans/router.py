"""From requirements to a plan of operations: deterministic, acyclic, within budgets."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from .understanding import Requirement

#: The engine and operation of an intent, and intents that are explained from other evidence.
ROUTES = {
    "SYMBOL_LOCATION": ("graph", "find_definition"),
    "DIRECT_CALLERS": ("graph", "find_callers"),
    "DIRECT_CALLEES": ("graph", "find_callees"),
    "FEATURE_DISCOVERY": ("semantic", "hybrid_search"),
    "FUNCTION_CONTRACT": ("rules", "function_contract"),
    "CHANGE_IMPACT": ("rules", "change_impact"),
    "MODULE_OVERVIEW": ("rules", "module_overview"),
    "TEST_DISCOVERY": ("rules", "reference_test_analysis"),
    "DEPENDENCY_PATH": ("graph", "find_paths"),
}
DEFERRED = frozenset({"FUNCTION_EXPLANATION", "WORKFLOW_EXPLANATION", "BEHAVIOR_INVESTIGATION", "CODE_COMPARISON"})


@dataclass(frozen=True)
class Limits:
    operations: int = 16
    depth: int = 8
    graph_results: int = 25
    semantic_candidates: int = 5
    rule_findings: int = 25
    graph_depth: int = 3
    concurrent: int = 3
    deadline_ms: int = 30_000
    evidence: int = 200


@dataclass(frozen=True)
class Operation:
    id: str
    requirement: int
    engine: str
    name: str
    targets: tuple[str, ...]
    depends_on: tuple[str, ...] = ()


@dataclass
class Plan:
    operations: list[Operation] = field(default_factory=list)
    deferred: list[int] = field(default_factory=list)
    unsupported: list[int] = field(default_factory=list)


def stable_id(value) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:32]


def build_plan(requirements: list[Requirement], limits: Limits = Limits()) -> Plan:
    """Operations in the order of the requirements. Equal operations are made once."""
    plan, made, of = Plan(), {}, {}
    for k, r in enumerate(requirements):
        if r.intent in DEFERRED:
            plan.deferred.append(k)
        elif r.intent not in ROUTES:
            plan.unsupported.append(k)
        else:
            engine, name = ROUTES[r.intent]
            key = (engine, name, tuple(r.targets) or (r.clause,))
            if key not in made:
                made[key] = Operation(stable_id([engine, name, key[2]]), k, *key, tuple(of[d] for d in r.depends_on if d in of))
                plan.operations.append(made[key])
            of[k] = made[key].id
    validate(plan, limits)
    return plan


def waves(plan: Plan, limits: Limits = Limits()) -> list[list[Operation]]:
    """Operations whose dependencies are done, at most `concurrent` at a time and one semantic search among them."""
    done: set[str] = set()
    left, out = list(plan.operations), []
    while left:
        wave: list[Operation] = []
        for op in left:
            semantic = any(o.engine == "semantic" for o in wave)
            if done.issuperset(op.depends_on) and len(wave) < limits.concurrent and not (op.engine == "semantic" and semantic):
                wave.append(op)
        if not wave:
            raise ValueError("operations depend on one another in a circle")
        out.append(wave)
        done |= {o.id for o in wave}
        left = [o for o in left if o.id not in done]
    return out


def validate(plan: Plan, limits: Limits) -> None:
    ids = [o.id for o in plan.operations]
    if len(set(ids)) != len(ids):
        raise ValueError("operations share an id")
    if len(ids) > limits.operations:
        raise ValueError("more operations than the budget has")
    if any(d not in ids for o in plan.operations for d in o.depends_on):
        raise ValueError("an operation depends on one that isn't planned")
    if len(waves(plan, Limits(concurrent=len(ids) or 1))) > limits.depth:
        raise ValueError("dependencies are deeper than the budget")
