import pytest
from pyspark.sql import functions as F

from graphquarry.operators import proofs

ENTITY = "id string, kind string, file_id string, symbol_id string, source_hash string, start_line int, end_line int, resolution string, source string, target string, relationship string"
FINDING = "finding_id string, kind string, relationship string, path_node_ids array<string>, path_names array<string>, source_node_id string, source_symbol_id string, source_name string, target_node_id string, target_symbol_id string, target_name string, entity_id string, entity_name string, chunk_id string"
PROOF = "finding_id string, position int, evidence_id string, repository_id string, snapshot_id string, stage_id string, evidence_type string, resolution string, source_hash string, start_line int, end_line int, file_id string, symbol_id string"
NODES = [("A", "Alpha", "sa"), ("B", "Beta", "sb"), ("C", "Gamma", None)]
ENTITIES = [
    ("sa", "symbol", "f1", "sa", "h", 1, 9, None, None, None, None),
    ("sb", "symbol", "f1", "sb", "h", 10, 19, None, None, None, None),
    ("C", "node", "f1", None, "h", 1, 30, None, None, None, None),
    ("k1", "chunk", "f1", "sa", "h", 1, 9, None, None, None, None),
    ("AB", "relationship", "f1", None, "h", 3, 3, "resolved", "A", "B", "CALLS"),
    ("BC", "relationship", "f1", None, "h", 12, 12, "resolved", "B", "C", "CALLS"),
    ("AC", "relationship", "f1", None, "h", 4, 4, "unresolved", "A", "C", "CALLS"),
]
BY_ID = {e[0]: e for e in ENTITIES}
TYPES = {"symbol": "symbol_definition", "node": "source_range", "chunk": "code_chunk", "relationship": "call_site"}
CONTEXT = proofs.Context("r", "g", ("s1", "s2"))


def finding(name, kind="graph", relationship="CALLS", path=(), names=(), **claims):
    order = [c.split()[0] for c in FINDING.split(", ")[5:]]
    return (name, kind, relationship, list(path), list(names), *(claims.get(c) for c in order))


def proof(name, at, evidence, **other):
    e = BY_ID.get(evidence, ("", "symbol", "f1", None, "h", 1, 1, None))
    row = {"repository_id": "r", "snapshot_id": "g", "stage_id": "s1", "evidence_type": TYPES[e[1]], "resolution": e[7], "source_hash": e[4], "start_line": e[5], "end_line": e[6], "file_id": e[2], "symbol_id": e[3]} | other
    return (name, at, evidence, *row.values())


CASES = {
    "direct": (finding("direct", source_node_id="A", target_name="Beta"), ["AB"], None),
    "wrong end": (finding("wrong end", source_node_id="B"), ["AB"], "canonical_identity"),
    "wrong symbol": (finding("wrong symbol", target_symbol_id="sa"), ["AB"], "canonical_identity"),
    "two edges": (finding("two edges"), ["AB", "BC"], "claim_provenance"),
    "no edge": (finding("no edge"), ["k1"], "claim_provenance"),
    "nothing": (finding("nothing"), [], "claim_provenance"),
    "unresolved": (finding("unresolved"), ["AC"], "claim_provenance"),
    "other kind of edge": (finding("other kind of edge", relationship="IMPORTS"), ["AB"], "claim_provenance"),
    "path": (finding("path", path="ABC", names=("Alpha", "Beta", "Gamma")), ["AB", "sa", "BC"], None),
    "broken path": (finding("broken path", path="ABC", names=("Alpha", "Beta", "Gamma")), ["BC", "AB"], "claim_provenance"),
    "names": (finding("names", path="ABC", names=("Alpha", "Beta", "Delta")), ["AB", "BC"], "canonical_identity"),
    "definition": (finding("definition", "definition", "DEFINITION", target_node_id="A", entity_id="sa", entity_name="Alpha"), ["sa"], None),
    "by symbol": (finding("by symbol", "definition", "DEFINITION", target_symbol_id="sb", entity_id="sb"), ["sb"], None),
    "of a node": (finding("of a node", "definition", "DEFINITION", target_node_id="C", entity_id="C", entity_name="Gamma"), ["C"], None),
    "not cited": (finding("not cited", "definition", "DEFINITION", target_node_id="A", entity_id="sa"), ["k1"], "claim_provenance"),
    "other node": (finding("other node", "definition", "DEFINITION", target_node_id="B", entity_id="sa"), ["sa"], "canonical_identity"),
    "wrong name": (finding("wrong name", "definition", "DEFINITION", target_node_id="A", entity_id="sa", entity_name="Beta"), ["sa"], "canonical_identity"),
    "semantic": (finding("semantic", "semantic", None, chunk_id="k1"), ["k1"], None),
    "no chunk": (finding("no chunk", "semantic", None, chunk_id="sa"), ["sa"], "claim_provenance"),
    "strange": (finding("strange", "rag"), ["k1"], "unsupported_finding"),
}
BAD = [
    ({"repository_id": "q"}, "repository_mismatch"), ({"snapshot_id": None}, "generation_mismatch"), ({"stage_id": "s9"}, "stage_mismatch"), ({"source_hash": "x"}, "source_hash"), ({"end_line": 5}, "source_range"),
    ({"file_id": None}, "canonical_identity"), ({"symbol_id": "sa"}, "canonical_identity"), ({"evidence_type": "code_chunk"}, "provenance"), ({"resolution": "inferred"}, "provenance"),
]


@pytest.fixture(scope="module")
def stored(spark):
    return spark.createDataFrame(ENTITIES, ENTITY), spark.createDataFrame(NODES, "id string, label string, symbol_id string")


def test_each_case_has_its_code(spark, stored):
    entities, nodes = stored
    findings = [c[0] for c in CASES.values()] + [finding(f"bad {k}") for k in range(len(BAD))] + [finding("gone")]
    made = [proof(n, k, e) for n, (_, es, _) in CASES.items() for k, e in enumerate(es)]
    made += [proof(f"bad {k}", 0, "AB", **other) for k, (other, _) in enumerate(BAD)] + [proof("gone", 0, "AB"), proof("gone", 1, "zz")]
    out = proofs.prove(spark.createDataFrame(findings, FINDING), spark.createDataFrame(made, PROOF), entities, nodes, CONTEXT)
    got = {r["finding_id"]: (r["verdict"], r["code"]) for r in out.collect()}
    want = {n: c for n, (_, _, c) in CASES.items()} | {f"bad {k}": c for k, (_, c) in enumerate(BAD)} | {"gone": "missing"}
    assert got == {n: ("rejected" if c else "proved", c) for n, c in want.items()}
    assert {tuple(r["bad"]) for r in out.where("finding_id IN ('gone', 'path')").collect()} == {("zz",), ()}


def test_saved_answers_are_proved_against_the_present_generation(spark):
    answers = spark.createDataFrame([("a", "r", "g"), ("b", "r", "old"), ("c", "q", "g"), ("d", "r", "g"), ("e", "r", "g")], "answer_id string, repository_id string, snapshot_id string")
    items = spark.createDataFrame([("a", "r1", "i1", "f1", ["x"]), ("a", "r1", "i2", "f2", []), ("a", "r2", "i3", "f1", ["y"]), ("b", "r1", "i4", "f1", []), ("d", "r1", "i5", "f1", ["x"]), ("d", "r1", "i6", "unknown", [])], "answer_id string, requirement_id string, item_id string, finding_id string, evidence_ids array<string>")
    verdicts = spark.createDataFrame([("f1", "proved"), ("f2", "rejected")], "finding_id string, verdict string")
    bad = spark.createDataFrame([("a", "y")], "answer_id string, evidence_id string")
    status, requirements, left = proofs.preview(answers, items, verdicts, bad, CONTEXT)
    assert {tuple(r) for r in status.collect()} == {("a", "partial"), ("b", "stale"), ("c", "unauthorized"), ("d", "partial"), ("e", "verified")}
    assert {tuple(r) for r in requirements.collect()} == {("a", "r1", "partially_satisfied", 1), ("a", "r2", "error", 0), ("d", "r1", "partially_satisfied", 1)}
    assert {r["item_id"] for r in left.collect()} == {"i1", "i5"} and left.columns == items.columns


def test_empty_tables(spark, stored):
    entities, nodes = stored
    none, few = spark.createDataFrame([], FINDING), spark.createDataFrame([], PROOF)
    assert proofs.prove(none, few, entities, nodes, CONTEXT).count() == 0
    some = spark.createDataFrame([finding("f")], FINDING)
    assert [r["code"] for r in proofs.prove(some, few, entities.limit(0), nodes.limit(0), CONTEXT).collect()] == ["claim_provenance"]
    assert proofs.proof_codes(spark.createDataFrame([proof("f", 0, "AB")], PROOF), entities.limit(0), CONTEXT).select(F.col("code")).first()[0] == "missing"


def test_whole_findings_are_shuffled_once(spark):
    """Nodes are met by single claims; before, whole findings with their evidence went through a shuffle for each lookup."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frames = [spark.createDataFrame(rows, schema) for rows, schema in (([c[0] for c in CASES.values()], FINDING), ([proof("direct", 0, "AB")], PROOF), (ENTITIES, ENTITY), (NODES, "id string, label string, symbol_id string"))]
        plan = proofs.prove(*frames, CONTEXT)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(") <= 8
    assert sum("path_names" in line for line in plan.splitlines() if "Exchange hashpartitioning(" in line) == 0
    assert "Exchange hashpartitioning(repository_id" not in plan


def test_claims_without_a_node_or_a_name(spark):
    """Paths with nulls or too few names, ends that contradict each other, a symbol of several nodes, a definition of nothing."""
    made = [
        (finding("null step", path=("A", None), names=("Alpha", "")), ["AB"], "claim_provenance"),
        (finding("few names", path="AB", names=("Alpha",)), ["AB"], "canonical_identity"),
        (finding("null name", path="AB", names=("Alpha", None)), ["AB"], "canonical_identity"),
        (finding("other end", path="AB", names=("Alpha", "Beta"), target_node_id="A"), ["AB"], "canonical_identity"),
        (finding("other name", path="AB", names=("Alpha", "Beta"), source_name="Beta"), ["AB"], "canonical_identity"),
        (finding("ends", path="AB", names=("Alpha", "Beta"), source_symbol_id="sa", target_name="Beta", target_node_id="B"), ["AB"], None),
        (finding("first of symbol", "definition", "DEFINITION", target_symbol_id="sb", entity_id="sb", entity_name="Beta"), ["sb"], None),
        (finding("not the first", "definition", "DEFINITION", target_symbol_id="sb", entity_id="sb", entity_name="Later"), ["sb"], "canonical_identity"),
        (finding("of nothing", "definition", "DEFINITION", entity_id="sa"), ["sa"], "canonical_identity"),
        (finding("no such node", "definition", "DEFINITION", target_node_id="Z", entity_id="sa"), ["sa"], "canonical_identity"),
    ]
    cited = [proof(f[0], n, e) for f, evidence, _ in made for n, e in enumerate(evidence)]
    nodes = spark.createDataFrame([*NODES, ("B2", "Later", "sb")], "id string, label string, symbol_id string")
    out = proofs.prove(spark.createDataFrame([f for f, _, _ in made], FINDING), spark.createDataFrame(cited, PROOF), spark.createDataFrame(ENTITIES, ENTITY), nodes, CONTEXT)
    assert {r.finding_id: r.code for r in out.collect()} == {f[0]: code for f, _, code in made}
