"""Bounded retrieval over several hops, for many questions at once.

Each question walks breadth first from its nodes along one relationship. It has one budget of edges to look at, over all
hops, and a limit of results; of a node the first edges in a fixed order are looked at, and the first edge to a new node
gives a result with the chain of edges that led there. The walk goes level by level: the first edges of each node are one row,
written once in buckets by node; a level is a join of the frontier with them, and a question with what its nodes lead to is one
row, bounded by the budgets. Only questions that go on are read again, and the number of jobs is bounded by the depth.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graph

#: Edges of a node, edges of a walk, hops, and unresolved occurrences of a node and of an answer.
MOST_EDGES, BUDGET, DEPTH, MOST_UNRESOLVED = 100, 100, 3, 10
#: Stands for a node without an id where nodes are compared: edges that lead to none are one new node of each level.
NOWHERE = "\0"


def first_edges(edges: DataFrame, relationship: str, reverse: bool, inferred: bool = False, most: int = MOST_EDGES) -> DataFrame:
    """node, other, edge, resolution, rank: of each node its first edges, resolved ones first, then by file, line and id. Spark keeps
    the first edges of each node within a task before they are shuffled, so a node with very many edges is ranked in parts."""
    here, there = ("target", "source") if reverse else ("source", "target")
    usable = F.col("resolution").isin("resolved", "inferred") if inferred else F.col("resolution") == "resolved"
    rows = edges.where((F.col("relationship") == relationship) & usable)
    resolved = F.col("resolution") == "resolved"
    rows = rows.select(F.col(here).alias("node"), F.col(there).alias("other"), F.col("id").alias("edge"), resolved.alias("resolved"), "evidence_file", "evidence_line")
    order = [~F.col("resolved"), F.col("evidence_file").asc_nulls_first(), F.col("evidence_line").asc_nulls_first(), F.col("edge")]
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy(*order))).where(F.col("rank") <= most)
    return rows.select("node", "other", "edge", F.when(F.col("resolved"), "resolved").otherwise("inferred").alias("resolution"), "rank")


def walk(seeds: DataFrame, adjacency: DataFrame, depth: int = DEPTH, limit: int = 10, budget: int = BUDGET, unresolved: DataFrame | None = None, shown: DataFrame | None = None) -> dict[str, DataFrame]:
    """results, summary and unresolved of the walks of all questions.

    seeds: question, node, one node for each question. results: question, position (their order), node, distance, edge,
    resolution, chain (ids of the edges from the seed; empty for an inferred edge). A node that isn't among `shown` (node) is
    walked through but is no result. summary: question, found, examined, truncated (a node was left, the budget is spent, or a result
    lies at the greatest depth). unresolved (id, source): occurrences at the nodes that were reached, MOST_UNRESOLVED of a
    node and of a question, in the order of the walk.
    """
    parts = graph.shuffle_parts(seeds.sparkSession)
    if shown is None:
        edges = adjacency.withColumn("listed", F.lit(True))
    else:
        listed = shown.select(F.col("node").alias("other"), F.lit(True).alias("listed")).distinct()
        edges = adjacency.join(listed, "other", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    own = F.struct("rank", "other", "edge", (F.col("resolution") == "resolved").alias("resolved"), "listed")
    lists = edges.groupBy("node").agg(F.slice(F.array_sort(F.collect_list(own)), 1, budget).alias("edges"))
    ahead = graph.bucketed(lists.withColumn("edges", F.transform("edges", lambda e: e.dropFields("rank"))), "node")
    none = F.array().cast("array<string>")
    first = seeds.groupBy("question").agg(F.min("node").alias("node")).repartition(parts, "node").join(ahead, "node", "left")
    state = first.select(
        "question", F.lit(0).cast("long").alias("examined"), F.lit(0).cast("long").alias("found"), F.array("node").alias("visited"), F.array(F.struct("node", none.alias("chain"))).alias("waiting"),
        F.array(F.struct(F.lit(1).alias("at"), "edges")).alias("met"),
    )
    levels = []
    for hop in range(1, depth + 1):
        levels.append(graph.cut(_level(state, hop, depth, limit, budget, shown is None, unresolved is not None)))
        on = levels[-1].where("goes_on")
        if hop == depth or on.isEmpty():
            break
        steps = on.select("question", F.posexplode("made.node").alias("at", "node")).withColumn("at", F.col("at") + 1)
        met = steps.repartition(parts, "node").join(ahead, "node").groupBy("question").agg(F.array_sort(F.collect_list(F.struct("at", "edges"))).alias("met"))  # at most `budget` nodes
        waiting = F.transform("made", lambda m: F.struct(m["node"].alias("node"), m["chain"].alias("chain")))
        state = on.select("question", "examined", "found", "visited", waiting.alias("waiting")).join(met, "question", "left")
        nodes = F.transform("waiting", lambda w: w["node"])
        state = state.withColumn("visited", F.concat("visited", F.filter(nodes, lambda n: n.isNotNull())))
    both = lambda shape: reduce(DataFrame.unionByName, (shape(level, hop) for hop, level in enumerate(levels, 1)))

    def results(level: DataFrame, hop: int) -> DataFrame:
        rows = level.select("question", F.inline("made")).where("listed")
        return rows.select("question", "position", "node", F.lit(hop).alias("distance"), "edge", F.when(F.col("resolved"), "resolved").otherwise("inferred").alias("resolution"), F.when(F.col("resolved"), F.col("chain")).otherwise(none).alias("chain"))

    cut_short = (F.col("left") > 0) | (F.col("examined") >= budget) | F.col("far")
    out = {"results": both(results), "summary": both(lambda level, hop: level.where("NOT goes_on").select("question", "found", "examined", cut_short.alias("truncated")))}
    if unresolved is not None:
        nodes = both(lambda level, hop: level.select("question", F.lit(hop).alias("hop"), F.posexplode("reached").alias("at", "node")))
        some = unresolved.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("id"))).where(F.col("n") <= MOST_UNRESOLVED)
        met = nodes.join(some.select(F.col("source").alias("node"), "id", "n"), "node")
        met = met.withColumn("nth", F.row_number().over(Window.partitionBy("question").orderBy("hop", "at", "n"))).where(F.col("nth") <= MOST_UNRESOLVED)
        out["unresolved"] = met.select("question", "nth", "node", "id")
    return out


def _level(state: DataFrame, hop: int, depth: int, limit: int, budget: int, every: bool, reached: bool) -> DataFrame:
    """question, examined, found, left, far, goes_on, made (the new nodes, in order) and reached (the nodes that were taken up) after
    a level, and visited, what was before it.

    state: question, examined, found, visited, waiting (node, chain; in order), met (at: the place in waiting from 1, edges). every: all nodes are
    results."""
    rows = state.withColumn("rows", F.flatten(F.transform(F.coalesce("met", F.array().cast(state.schema["met"].dataType)), lambda m: F.transform(
        F.coalesce(m["edges"], F.array().cast(state.schema["met"].dataType.elementType["edges"].dataType)),
        lambda e: F.struct(m["at"].alias("at"), e["other"].alias("node"), e["edge"].alias("edge"), e["resolved"].alias("resolved"), e["listed"].alias("listed")),
    ))))
    key = lambda r: F.coalesce(r["node"], F.lit(NOWHERE))
    left = (F.lit(budget) - F.col("examined")).cast("int")
    rows = rows.withColumn("all", F.size("rows")).withColumn("last_at", F.when(F.col("all") >= left, F.get("rows", left - 1)["at"])).withColumn("seen", F.slice("rows", 1, left)).drop("rows", "met")
    rows = rows.withColumn("keys", F.transform("seen", key))
    numbered = F.transform("seen", lambda r, i: F.struct(r.alias("r"), (i + 1).alias("nth")))
    new = F.filter(numbered, lambda x: (F.array_position("keys", key(x["r"])) == x["nth"]) & ~F.coalesce(F.array_contains("visited", key(x["r"])), F.lit(False)))
    rows = rows.withColumn("new", new).drop("seen", "keys")
    hits = F.sequence(F.lit(1), F.greatest(F.size("new"), F.lit(1))) if every else F.aggregate("new", F.array().cast("array<int>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + x["r"]["listed"].cast("int"))))
    rows = rows.withColumn("hits", hits)
    made = F.transform("new", lambda x, i: F.struct(
        x["r"]["node"].alias("node"), x["r"]["at"].alias("at"), x["nth"].alias("nth"), x["r"]["edge"].alias("edge"), x["r"]["resolved"].alias("resolved"), x["r"]["listed"].alias("listed"),
        (F.col("found") + F.get("hits", i)).alias("position"), F.concat(F.get("waiting", x["r"]["at"] - 1)["chain"], F.array(x["r"]["edge"])).alias("chain"),
    ))
    rows = rows.withColumn("made", F.filter(made, lambda m: m["position"] - m["listed"].cast("int") < limit)).drop("new", "hits")
    last = lambda c: F.get("made", F.size("made") - 1)[c]
    rows = rows.withColumn("now", F.coalesce(last("position"), F.col("found")))
    full = F.col("now") >= limit
    # nodes of the frontier are taken up until the budget or the limit is reached
    taken = F.least(F.size("waiting"), F.when(F.col("all") >= left, F.col("last_at")), F.when(full, F.coalesce(last("at"), F.lit(0))))
    rows = rows.withColumn("looked", F.when(full, F.col("examined") + F.coalesce(last("nth"), F.lit(0))).otherwise(F.least(F.col("examined") + F.col("all"), F.lit(budget))).cast("long")).withColumn("taken", taken)
    stopped = full | (F.col("looked") >= budget)
    goes_on = F.lit(False) if hop == depth else ~stopped & (F.size("made") > 0)
    untaken = F.size("waiting") - F.col("taken") + (F.lit(0) if hop == depth else F.when(stopped, F.size("made")).otherwise(0))
    far = (F.col("now") > F.col("found")) if hop == depth else F.lit(False)
    kept = F.transform("made", lambda m: F.struct(*(m[c].alias(c) for c in ("node", "edge", "resolved", "listed", "position", "chain"))))
    taken_up = [F.transform(F.slice("waiting", 1, F.col("taken")), lambda w: w["node"]).alias("reached")] if reached else []
    return rows.select("question", F.col("looked").alias("examined"), F.col("now").cast("long").alias("found"), untaken.alias("left"), far.alias("far"), goes_on.alias("goes_on"), F.when(goes_on, F.col("visited")).alias("visited"), kept.alias("made"), *taken_up)
