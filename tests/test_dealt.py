"""Joins and orders whose tasks hold a bounded number of rows, however many there are."""

from graphquarry.operators import answers, graph, snapshots

EDGE = "source string, target string, relationship string"


def fullest(df) -> int:
    return max(df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect())


def test_neighbours_are_dealt_to_tasks_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(graph, "TASK_ROWS", 20)
    edges = spark.createDataFrame([(f"s{k % 7}", f"p{k % 150}", "CALLS") for k in range(1050)] + [("s1", None, "CALLS"), ("s1", "p0", "USES")], EDGE)
    want = {(f"p{k % 150}", f"s{k % 7}") for k in range(1050)}
    every = answers.neighbours(edges, None, "CALLS", reverse=True)
    assert sorted(map(tuple, every.where("id IS NOT NULL").collect())) == sorted(want)
    assert [tuple(r) for r in every.where("id IS NULL").collect()] == [(None, "s1")]
    assert fullest(every) <= 100
    ids = spark.createDataFrame([("p3",), ("p3",), ("p4",), ("p999",), (None,)], "id string")
    some = answers.neighbours(edges, ids, "CALLS", reverse=True, most=5)
    assert sorted(map(tuple, some.collect())) == sorted((p, f"s{k}") for p in ("p3", "p4") for k in range(5))
    assert some.rdd.getNumPartitions() > 4


def test_orphans_are_dealt_to_tasks_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(graph, "TASK_ROWS", 20)
    rows = spark.createDataFrame([(k % 500,) for k in range(1000)] + [(None,)], "k long")
    parents = spark.createDataFrame([(2 * k,) for k in range(250)] * 2, "id long")
    out = snapshots.orphans(rows, parents, "k", "id")
    assert sorted(r.k for r in out.where("k IS NOT NULL").collect()) == sorted(2 * [2 * k + 1 for k in range(250)])
    assert out.where("k IS NULL").count() == 1  # as before: a row without a key has no parent
    assert fullest(out) <= 100
