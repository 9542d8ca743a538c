import pytest

from graphquarry.operators import assembly, graph

FILES = [("a.js", True, "h1"), ("b.js", True, "h2"), ("c.js", False, "h3")]
SYMBOLS = [("A", "a.js", "Base", "class", None, 0, 100), ("m", "a.js", "run", "method", "A", 10, 50), ("n", "a.js", "run", "method", "A", 60, 90), ("B", "b.js", "Child", "class", None, 0, 80), ("x", "b.js", "<anonymous@5>", "arrow_function", None, 90, 99), ("C", "c.js", "Lost", "class", None, 0, 9)]
EVENT = "seq int, file string, kind string, start_byte int, end_byte int, line int, expression string, target_file string, target_name string, target_start int, target_end int, source_file string, source_name string, source_start int, source_end int, specifier string, module_file string, alias boolean, exported_name string, relationship string, reason string"


@pytest.fixture(scope="module")
def tables(spark):
    files = spark.createDataFrame(FILES, "path string, parsed boolean, content_sha256 string")
    symbols = spark.createDataFrame([(*s[:3], s[2], *s[3:], 1) for s in SYMBOLS], "id string, path string, name string, qualified_name string, kind string, parent_symbol_id string, start_byte int, end_byte int, start_line int")
    return files, symbols


def event(seq, file, kind, at, target=None, source=None, **other):
    names = [c.split()[0] for c in EVENT.split(", ")]
    row = dict.fromkeys(names) | {"seq": seq, "file": file, "kind": kind, "start_byte": at, "end_byte": at + 1, "line": 1} | other
    for side, d in (("target", target), ("source", source)):
        if d:
            row |= dict(zip([f"{side}_{x}" for x in ("file", "name", "start", "end")], d, strict=True))
    return tuple(row[n] for n in names)


def test_each_kind_of_event_has_its_edge(spark, tables):
    files, symbols = tables
    events = spark.createDataFrame(
        [
            event(1, "b.js", "inheritance", 5, ("a.js", "Base", 0, 100), ("b.js", "Child", 0, 80), relationship="EXTENDS"),
            event(2, "b.js", "inheritance", 6, ("a.js", "Base", -5, 120), ("b.js", "Nobody", 0, 80), relationship="IMPLEMENTS"),
            event(3, "b.js", "call", 20, ("a.js", "run", 58, 92)),  # the nearer of two
            event(4, "a.js", "call", 15, ("a.js", "run", 10, 50)),
            event(5, "b.js", "call", 95, ("b.js", "default", 85, 99), expression="f()"),
            event(6, "b.js", "reference", 96, ("a.js", "absent", 0, 9)),
            event(7, "b.js", "call", 97, ("c.js", "Lost", 0, 9), expression="lost()"),
            event(8, "b.js", "import", 0, specifier="./a", module_file="a.js"),
            event(9, "b.js", "import", 1, specifier="react"),
            event(10, "b.js", "import", 2, specifier="@/x", alias=True),
            event(11, "b.js", "import", 3, specifier="./c", module_file="c.js"),
            event(12, "a.js", "export", 4, ("a.js", "Base", 0, 100), exported_name="Base"),
            event(13, "a.js", "unresolved", 12, relationship="CALLS", reason="dynamic"),
            event(14, "c.js", "call", 1, ("a.js", "Base", 0, 100)),
            event(15, "a.js", "strange", 1),
        ],
        EVENT,
    )
    references = spark.createDataFrame([("b.js", "call", 20, 7, 3, "x")], "path string, kind string, start_byte int, start_line int, start_column int, scope_symbol_id string")
    made = assembly.build(files, symbols, events, "r", references)
    name = {r["id"]: r["symbol_id"] or r["label"] for r in made["nodes"].collect()}
    edges = {(name[r["source"]], name[r["target"]], r["relationship"], r["resolution"], r["evidence_type"], r["evidence_line"]) for r in made["edges"].where("evidence_type NOT IN ('inventory', 'syntax_definition')").collect()}
    assert edges == {
        ("B", "A", "EXTENDS", "resolved", "semantic_reference", 1), ("b.js", "A", "IMPLEMENTS", "resolved", "semantic_reference", 1), ("x", "n", "CALLS", "resolved", "semantic_reference", 7), ("m", "m", "CALLS", "resolved", "semantic_reference", 1),
        ("x", "x", "CALLS", "resolved", "semantic_reference", 1), ("b.js", "a.js", "IMPORTS", "resolved", "semantic_module_resolution", 1), ("b.js", "a.js", "DEPENDS_ON", "resolved", "derived_import", 1), ("b.js", "react", "IMPORTS", "inferred", "package_specifier", 1), ("a.js", "A", "EXPORTS", "resolved", "semantic_export", 1),
    }
    loose = {(name[r["source"]], r["relationship"], r["expression"], r["reason"]) for r in made["unresolved"].collect()}
    assert loose == {("x", "CALLS", "lost()", "target_not_uniquely_indexed"), ("b.js", "IMPORTS", "@/x", "local_module_not_indexed_or_missing"), ("b.js", "IMPORTS", "./c", "local_module_not_indexed_or_missing"), ("m", "CALLS", None, "dynamic")}
    assert made["nodes"].where("kind = 'ExternalDependency'").select("label").collect() == [("react",)]


def test_changed_files_refuse_the_build(spark, tables):
    files, symbols = tables
    events = spark.createDataFrame([], EVENT)
    now = files.select("path", "content_sha256")
    assert assembly.build(files, symbols, events, "r", current=now)["edges"].where("relationship = 'CALLS'").count() == 0
    for current in (now.where("path != 'b.js'"), now.replace("h2", "other")):
        with pytest.raises(RuntimeError, match="b.js"):
            assembly.build(files, symbols, events, "r", current=current)


def test_modules_of_imports(spark):
    modules = spark.createDataFrame([("pkg.a",), ("pkg",)], "id string")
    rows = spark.createDataFrame([("m", "pkg", True, 1), ("m", "pkg.a", False, 1), ("m", "pkg.name", False, 1), ("m", "numpy", True, 2), ("m", "..up", True, 3)], "source string, target string, sure boolean, line int")
    got = {tuple(r) for r in graph.module_edges(rows, modules).collect()}
    assert got == {("m", "pkg", r, "resolved", 1) for r in ("IMPORTS", "DEPENDS_ON")} | {("m", "pkg.a", r, "resolved", 1) for r in ("IMPORTS", "DEPENDS_ON")} | {("m", "numpy", "IMPORTS", "inferred", 2), ("m", "..up", "IMPORTS", "unresolved", 3)}
