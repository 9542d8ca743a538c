import random
from collections import deque

import pytest

from pyspark.sql import functions as F

from graphquarry.operators import traversal

EDGE = "id string, source string, target string, relationship string, resolution string, evidence_file string, evidence_line int"


def by_hand(seed, edges, loose, depth, limit, budget, reverse, shown=None, most=100):
    """One question at a time, with a queue."""
    queue, visited, results, unresolved, examined = deque([(seed, 0, [])]), {seed}, [], [], 0
    while queue and len(results) < limit and examined < budget:
        node, far, chain = queue.popleft()
        unresolved += sorted(i for i, s in loose if s == node)[:10]
        own = [e for e in edges if e[2 if reverse else 1] == node and e[3] == "CALLS" and e[4] == "resolved"]
        own.sort(key=lambda e: (e[5] is not None, e[5] or "", e[6] is not None, e[6] or 0, e[0]))
        for e in own[:most]:
            examined += 1
            if examined > budget:
                break
            other = e[1 if reverse else 2]
            if other in visited:
                continue
            visited.add(other)
            if shown is None or other in shown:
                results.append((len(results) + 1, other, far + 1, e[0], [*chain, e[0]]))
            if far + 1 < depth:
                queue.append((other, far + 1, [*chain, e[0]]))
            if len(results) >= limit:
                break
    return results, unresolved[:10], min(examined, budget), bool(queue) or examined >= budget or any(r[2] == depth for r in results)


@pytest.mark.parametrize(("depth", "limit", "budget", "reverse", "some"), [(3, 10, 40, True, False), (3, 4, 200, False, True), (2, 50, 12, True, True), (1, 5, 200, False, False)])
def test_walks_equal_a_queue(spark, depth, limit, budget, reverse, some):
    r = random.Random(depth * 100 + limit)
    nodes = [f"n{k}" for k in range(40)]
    edges = [(f"e{k:03}", r.choice(nodes[: 40 if k % 3 else 4]), r.choice(nodes), r.choice(["CALLS", "CALLS", "IMPORTS"]), r.choice(["resolved", "resolved", "inferred"]), r.choice([None, "a", "b"]), r.choice([None, 1, 2])) for k in range(260)]
    loose = [(f"u{k:02}", r.choice(nodes)) for k in range(90)]
    shown = set(r.sample(nodes, 25)) if some else None
    df = spark.createDataFrame(edges, EDGE)
    adjacency = traversal.first_edges(df, "CALLS", reverse, most=9)
    seeds = spark.createDataFrame([(f"q{n}", n) for n in [*nodes, "nowhere"]], "question string, node string")
    out = traversal.walk(seeds, adjacency, depth, limit, budget, spark.createDataFrame(loose, "id string, source string"), None if shown is None else spark.createDataFrame([(n,) for n in shown], "node string"))
    got, said, open_ = {}, {x["question"]: (x["found"], x["examined"], x["truncated"]) for x in out["summary"].collect()}, {}
    for x in sorted(out["results"].collect(), key=lambda x: (x["question"], x["position"])):
        got.setdefault(x["question"], []).append((x["position"], x["node"], x["distance"], x["edge"], x["chain"]))
    for x in sorted(out["unresolved"].collect(), key=lambda x: (x["question"], x["nth"])):
        open_.setdefault(x["question"], []).append(x["id"])
    for n in [*nodes, "nowhere"]:
        results, unresolved, examined, truncated = by_hand(n, edges, loose, depth, limit, budget, reverse, shown, 9)
        assert got.get(f"q{n}", []) == results, n
        assert open_.get(f"q{n}", []) == unresolved, n
        assert said[f"q{n}"] == (len(results), examined, truncated), n


def test_no_question_and_no_edge(spark):
    df = spark.createDataFrame([], EDGE)
    seeds = spark.createDataFrame([("q", "n")], "question string, node string")
    adjacency = traversal.first_edges(df, "CALLS", True)
    assert [tuple(r) for r in traversal.walk(seeds, adjacency)["summary"].collect()] == [("q", 0, 0, False)]
    assert traversal.walk(seeds.limit(0), adjacency)["results"].count() == 0


def test_edges_are_read_and_ranked_once_for_all_levels(spark):
    """Before, every level read all edges again, twice, and each time they were shuffled twice."""
    rows = [(f"e{k}", f"n{k + 1}", f"n{k}", "CALLS", "resolved", "a", k) for k in range(40)]
    read = spark.sparkContext.accumulator(0)

    def counted(line):
        read.add(1)
        return line

    edges = spark.createDataFrame(rows, EDGE).withColumn("evidence_line", F.udf(counted, "int")("evidence_line"))
    adjacency = traversal.first_edges(edges, "CALLS", True)
    assert adjacency._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(") == 1
    seeds = spark.createDataFrame([(f"q{k}", f"n{k}") for k in range(0, 40, 5)], "question string, node string")
    out = traversal.walk(seeds, adjacency)
    assert out["summary"].where("found = 3 AND truncated").count() == 8
    assert sorted(r.chain for r in out["results"].where("question = 'q5'").collect()) == [["e5"], ["e5", "e6"], ["e5", "e6", "e7"]]
    assert read.value == len(rows)
