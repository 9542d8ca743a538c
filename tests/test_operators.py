import pytest
from pyspark.sql import functions as F

from graphquarry.operators import chunking, evidence, filters, graph, metrics, ranges, rules, search, snapshots

EDGE = "id long, source string, target string, relationship string, resolution string, evidence_file string, evidence_line int"


@pytest.fixture(scope="module")
def edges(spark):
    rows = [
        (1, "a", "b", "CALLS", "resolved", "src/a.js", 1),
        (2, "a", "b", "CALLS", "resolved", "src/a.js", 9),
        (3, "b", "c", "CALLS", "resolved", "src/b.js", 2),
        (4, "c", "a", "CALLS", "resolved", "src/c.js", 2),
        (5, "t", "b", "CALLS", "resolved", "tests/b.test.js", 3),
        (6, "a", "x", "CALLS", "unresolved", "src/a.js", 4),
        (7, "m", "n", "DEPENDS_ON", "resolved", "src/m.js", 1),
    ]
    return spark.createDataFrame(rows, EDGE)


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_one_row_for_each_call_site(spark, edges):
    assert sorted(r["id"] for r in graph.callers(edges, ids(spark, "b")).collect()) == [1, 2, 5]
    assert sorted(r["id"] for r in graph.callees(edges, ids(spark, "a")).collect()) == [1, 2]


def test_reach_is_by_first_depth_and_ends_in_cycles(spark, edges):
    calls = graph.resolved(edges, "CALLS")
    assert {r["id"]: r["depth"] for r in graph.reach(calls, ids(spark, "b"), 10).collect()} == {"a": 1, "t": 1, "c": 2}
    assert sorted(r["id"] for r in graph.closure(calls, ids(spark, "c")).collect()) == ["a", "b", "c", "t"]
    assert graph.reach(calls, ids(spark, "b"), 10, most=1).first()["id"] == "a"


def test_paths_keep_parallel_edges_and_say_when_cut(spark, edges):
    calls = graph.resolved(edges, "CALLS")
    found, cut = graph.paths(calls, ids(spark, "a"), ids(spark, "c"), 5, 10, 100)
    assert [r["edges"] for r in found.collect()] == [[1, 3], [2, 3]] and not cut
    found, cut = graph.paths(calls, ids(spark, "a"), ids(spark, "c"), 5, 1, 100)
    assert found.count() == 1 and cut
    assert graph.paths(calls, ids(spark, "a"), ids(spark, "a"), 5, 10, 100)[0].count() == 0
    assert graph.paths(calls, ids(spark, "a"), ids(spark, "c"), 5, 10, 2)[1]
    with pytest.raises(ValueError):
        graph.paths(calls, ids(spark, "a"), ids(spark, "c"), 0, 1, 1)


def test_test_files_are_told_by_path(spark, edges):
    rows, more = graph.test_references(edges, ids(spark, "b"), 5)
    assert [r["source"] for r in rows.collect()] == ["t"] and not more
    paths = ["tests/a", "x/test/a", "a.spec.ts", "test_a.py", "latest/a", "contest.js", "__tests__/q"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in df.select(filters.is_test_path(F.col("p"))).collect()] == [True, True, True, True, False, False, True]


def test_lookup_reports_ambiguity(spark):
    rows = spark.createDataFrame([("1", "f", "a.f"), ("2", "f", "b.f"), ("3", "g", "a.g")], "id string, name string, qualified_name string")
    assert graph.lookup(rows, filters.names_symbol("f"))[0] == "ambiguous"
    assert graph.lookup(rows, filters.names_symbol("a.f"))[0] == "success"
    assert graph.lookup(rows, filters.names_symbol("F"))[0] == "not_found"


def test_legacy_names(spark):
    rows = spark.createDataFrame([("m", "f", "module"), ("m:f", "f", "function"), ("n:g", "get_user", "function")], "id string, name string, kind string")
    assert graph.legacy_node(rows, "f").first()["id"] == "m:f"
    assert graph.legacy_node(rows, "user").first()["id"] == "n:g"
    assert graph.legacy_node(rows, "nothing").isEmpty()


def test_payload_filters(spark):
    df = spark.createDataFrame([(1, "a", "5"), (2, "b", "x"), (3, "c", None)], "id int, k string, n string")
    keep = lambda c: sorted(r["id"] for r in df.where(filters.payload_filter(c)).collect())
    assert keep({"must": [{"key": "n", "range": {"gte": 5, "lt": 6}}]}) == [1]
    assert keep({"should": [{"key": "k", "match": {"any": ["a", "c"]}}]}) == [1, 3]
    assert keep({"must_not": [{"key": "k", "match": {"value": "a"}}]}) == [2, 3]
    assert keep({}) == [1, 2, 3]


def test_filters_are_checked():
    assert filters.checked_filters({"languages": ["TypeScript"]}) == {"languages": ["typescript"]}
    for bad in ({"colour": ["red"]}, {"files": ["/etc"]}, {"files": ["a"] * 26}, {"modules": ["a/../b"]}):
        with pytest.raises(ValueError):
            filters.checked_filters(bad)


def test_fusion_counts_a_repeated_key_once_at_its_first_place(spark):
    a = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "id string, position int")
    b = spark.createDataFrame([("y", 1)], "id string, position int")
    got = {r["id"]: (r["score"], r["channels"]) for r in search.fused({"k": a, "s": b}, ["id"]).collect()}
    assert got["x"] == (pytest.approx(1 / 61), "k") and got["y"] == (pytest.approx(1 / 63 + 1 / 61), "k,s")


def test_innermost_and_declared(spark):
    spans = spark.createDataFrame([("f", "out", 0, 100), ("f", "in", 10, 20), ("g", "other", 0, 100)], "file_id string, id string, start_byte int, end_byte int")
    points = spark.createDataFrame([("f", 15), ("f", 20), ("f", 500)], "file_id string, offset int")
    assert {r["offset"]: r["enclosing"] for r in ranges.innermost(points, spans).collect()} == {15: "in", 20: "out", 500: None}
    symbols = spans.withColumn("name", F.lit("n"))
    d = spark.createDataFrame([("f", "n", 11, 19)], "file_id string, name string, d_start int, d_end int")
    assert ranges.declared(d, symbols).first()["symbol_id"] == "in"


def test_snapshots(spark):
    old = spark.createDataFrame([("a", "1", "parsed"), ("b", "2", "parsed"), ("c", "3", "parsed")], "path string, content_sha256 string, parse_status string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "path string, content_sha256 string")
    assert {r["path"]: r["change"] for r in snapshots.difference(old, new, "path", "content_sha256").collect()} == {"b": "changed", "c": "deleted", "d": "added"}
    assert {r["path"]: r["parse_status"] for r in snapshots.merged(old, new).collect()} == {"a": "parsed", "b": "pending", "d": "pending"}


def test_digest_ignores_order(spark):
    rows = [(p, "source", "included", "eligible", p) for p in "abc"]
    shape = "path string, kind string, status string, reason string, content_sha256 string"
    one, two = spark.createDataFrame(rows, shape), spark.createDataFrame(rows[::-1], shape)
    assert snapshots.observed_digest(one).first() == snapshots.observed_digest(two).first()
    assert snapshots.observed_digest(one).first() != snapshots.observed_digest(one.limit(2)).first()


def test_metrics(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,), (4,)], "k int")
    row = metrics.precision_recall(a, b, "k").first()
    assert (row["precision"], row["recall"], row["missing"], row["unexpected"]) == (pytest.approx(1 / 3), 0.5, 1, 2)
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 2, 10)], "v double")
    assert metrics.nearest_rank(df, F.col("v"), {"p50": 0.5, "p95": 0.95}).first().asDict() == {"p50": 2.0, "p95": 10.0}


def test_evidence(spark):
    links = spark.createDataFrame([("x", "1"), ("x", "2"), ("y", "3")], "claim string, evidence string")
    assert [r["claim"] for r in evidence.quarantined(links, spark.createDataFrame([("2",)], "evidence string")).collect()] == ["y"]
    assert evidence.packed([("a", 5), ("b", 9), ("c", 4)], 10) == (["a", "c"], ["b"])
    shape = "nodes array<string>, edges array<struct<source:string,target:string>>"
    df = spark.createDataFrame([(["a", "b", "c"], [("a", "b"), ("b", "c")]), (["a", "b"], [("b", "a")]), (["a"], [])], shape)
    assert [r[0] for r in df.select(evidence.chain_is_valid(F.col("nodes"), F.col("edges"))).collect()] == [True, False, True]


def test_rules(spark, edges):
    impact = {r["id"]: r["category"] for r in rules.change_impact(edges, ids(spark, "b"), 3).collect()}
    assert impact == {"a": "direct_impact", "t": "direct_impact", "c": "possible_impact"}
    kinds = [r["category"] for r in rules.reference_test_analysis(edges, ids(spark, "b")).collect()]
    assert sorted(kinds) == ["callers", "callers", "callers", "tests"]
    assert [r["target"] for r in rules.module_overview(edges, ids(spark, "m")).collect()] == ["n"]


def test_chunks_have_exact_lines():
    source = '"""doc"""\nimport os\n\n\ndef f(a, b=1):\n    """Adds."""\n    return a + b\n\n\nclass C:\n    def m(self):\n        return 1\n'
    got = chunking.chunks_of("pkg/a.py", source, "repo")
    assert [(c[3], c[4], c[5], c[7]) for c in got] == [("module_context", 1, 2, ""), ("symbol", 5, 7, "f"), ("symbol", 10, 12, "C"), ("symbol", 11, 12, "C.m")]
    assert got[1][8] == "f(a, b=1)" and got[1][9] == "Adds."
    lines = source.split("\n")
    assert all(c[10].split("\n")[0].strip() == lines[c[4] - 1].strip() for c in got)


def test_windows_overlap_and_cut_at_lines():
    text = "\n".join(f"line {i}" for i in range(400))
    got = chunking.chunks_of("a.txt", text, "repo", 200, 40)
    assert all(len(c[10]) <= 200 for c in got) and all(b[4] <= a[5] for a, b in zip(got, got[1:], strict=False))
    assert len({c[2] for c in got}) == len(got)
    for bad in ((10, 1), (100, 100)):
        with pytest.raises(ValueError):
            chunking.chunks_of("a.txt", text, "repo", *bad)


def test_sections_and_fallback():
    assert [c[6] for c in chunking.chunks_of("a.md", "intro\n# One\nx\n## Two\ny", "r")] == ["intro", "# One", "## Two"]
    assert [c[6] for c in chunking.chunks_of("a.json", '{\n  "a": 1,\n  "b": {\n    "c": 2\n  }\n}', "r")] == ["{", '"a": 1,', '"b": {']
    assert chunking.chunks_of("a.py", "def broken(:", "r")[0][3] == "syntax_fallback"
    assert chunking.chunks_of("a.py", "", "r") == []
