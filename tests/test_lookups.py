"""Lookups of large tables: no broadcast beyond the limit, and no task for all null keys."""

import pytest

from graphquarry.operators import assembly, graph


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_keys_beyond_the_limit_are_not_broadcast(spark):
    rows = spark.range(50).selectExpr("id", "id % 7 AS v")
    assert "BroadcastHashJoin" in plan(rows.join(graph.if_small(spark.range(20), 20), "id"))
    assert "Broadcast" not in plan(rows.join(graph.if_small(spark.range(20), 19), "id"))


@pytest.mark.parametrize("limit", [0, 100])
def test_null_keys_stay_out_of_the_shuffle(spark, limit):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, None), (4, "z")], "id int, k string")
    lookup = spark.createDataFrame([("a", 10), ("b", 20)], "k string, v int")
    out = graph.looked_up(rows, lookup, ["k"], limit)
    assert sorted((r["id"], r["k"], r["v"]) for r in out.collect()) == [(1, "a", 10), (2, None, None), (3, None, None), (4, "z", None)]
    assert limit or "isnull(k" in plan(out)


def test_edges_say_what_their_ends_are(spark):
    files = spark.createDataFrame([("a.js", True), ("b.js", True)], "path string, parsed boolean")
    symbols = spark.createDataFrame([("A", "a.js", "Base", "Base", "class", None, 0, 90, 1), ("m", "a.js", "run", "run", "method", "A", 10, 50, 1), ("B", "b.js", "go", "go", "function", None, 0, 80, 1)], "id string, path string, name string, qualified_name string, kind string, parent_symbol_id string, start_byte int, end_byte int, start_line int")
    events = spark.createDataFrame([(1, "b.js", "call", 5, 6, 1, "m", None), (2, "b.js", "call", 7, 8, 1, "gone", "B"), (3, "a.js", "export", 1, 2, 1, "A", None), (4, "a.js", "call", 12, 13, 1, None, "B")], "seq int, file string, kind string, start_byte int, end_byte int, line int, target_symbol_id string, scope_symbol_id string")
    made = assembly.build(files, symbols, events, "r")
    ids = {(r["kind"], r["symbol_id"] or r["path"] or r["label"]): (r["id"], r["path"]) for r in made["nodes"].collect()}
    rows = made["edges"].collect()
    for r in rows:
        for side in ("source", "target"):
            assert ids[r[f"{side}_kind"], r[f"{side}_named"]] == (r[side], r[f"{side}_path"])
    assert {(r["source_named"], r["target_named"], r["relationship"]) for r in rows if r["evidence_type"].startswith("semantic")} == {("B", "m", "CALLS"), ("a.js", "A", "EXPORTS")}
    assert sorted((r["start_byte"], r["reason"]) for r in made["unresolved"].collect()) == [(7, "target_not_uniquely_indexed"), (12, "target_not_uniquely_indexed")]
    bare = made | {"edges": made["edges"].drop(*assembly.ENDS)}  # by ids as by ends
    gone = files.where("path = 'b.js'")
    assert {r["id"] for r in assembly.without_files(made, gone)["edges"].collect()} == {r["id"] for r in assembly.without_files(bare, gone)["edges"].collect()}
    shown = lambda edges: {(r["id"], r["source_label"], r["target_label"], r["target_syntax"]) for r in assembly.described(edges, made["nodes"], symbols).collect()}
    assert shown(made["edges"]) == shown(bare["edges"]) and len(shown(bare["edges"])) == len(rows)
    called = {"own": graph.at(made["edges"], spark.createDataFrame([(ids["Method", "m"][0],)], "id string"))}
    assert {r["relationship"] for r in called["own"].collect()} == {"CALLS", "DEFINES"}
