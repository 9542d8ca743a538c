import time

import pytest
from pyspark.sql import functions as F

from graphquarry import api
from graphquarry.operators import answers
from graphquarry.plans import executor, router, structural, understanding
from graphquarry.sources import embedding, generations, stores, vector_journal
from graphquarry.streaming import events


@pytest.fixture(scope="module")
def repository(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("sources")
    (root / "pkg").mkdir()
    (root / "pkg/auth.py").write_text("def check_password(word):\n    '''Compare hashes.'''\n    return hashed(word)\n\ndef hashed(word):\n    return word\n")
    (root / "pkg/app.py").write_text("from pkg.auth import check_password\n\ndef login(word):\n    return check_password(word)\n")
    (root / "pkg/twice.py").write_text("from .auth import hashed\n\ndef twice(word):\n    hashed(word)\n    return hashed(word)\n")
    (root / "README.md").write_text("# Title\nHow passwords are checked.\n")
    out = api.Repository(spark, f"file://{root}", f"file://{tmp_path_factory.mktemp('store')}/s")
    out.folder = root
    return out


def test_index_search_ask(repository):
    first, made = repository.index()
    assert made and repository.index() == (first, False)
    assert repository.live_state()["fresh"]
    route, rows = repository.search("who calls check_password")
    assert route == "graph" and [r["source"] for r in rows] == ["pkg.app:login"]
    assert repository.search("how are password hashes compared")[0] == "hybrid"
    answer = repository.ask("who calls check_password and where is hashed defined")
    assert answer["status"] == {"find_callers": "success", "find_definition": "success"}
    assert repository.ask("hello there")["intent"] == "greeting"
    assert {n["name"] for n in repository.file("pkg/auth.py")["nodes"]} >= {"check_password", "hashed"}
    assert repository.documentation().where("id = 'pkg.auth:check_password'").count() == 1
    edges = repository.tables()["edges"]
    assert {(r["source"], r["target"], r["relationship"]) for r in edges.where("relationship IN ('IMPORTS', 'DEPENDS_ON')").collect()} == {(m, "pkg.auth", r) for m in ("pkg.app", "pkg.twice") for r in ("IMPORTS", "DEPENDS_ON")}
    assert [(r["evidence_file"], r["evidence_line"]) for r in edges.where("source = 'pkg.twice:twice' AND relationship = 'CALLS'").orderBy("evidence_line").collect()] == [("pkg/twice.py", 4), ("pkg/twice.py", 5)]
    engine = executor.Engine(repository.tables())
    for name, target, want in (("find_imports", "pkg/app.py", ["pkg.auth"]), ("find_dependencies", "pkg/twice.py", ["pkg.auth"]), ("find_importers", "pkg/auth.py", ["pkg.auth"] * 2)):
        out = engine.run(router.Operation("x", 0, "graph", name, (target,), ()))
        assert out.status == "success" and [r["target"] for r in out.rows] == want, name
    (repository.folder / "pkg/new.py").write_text("def fresh():\n    pass\n")
    state = repository.live_state()
    assert not state["fresh"] and state["added"] == 1
    second, made = repository.index()
    assert made and second != first and repository.store.collectable() == [first] and repository.store.collectable({first}) == []
    assert repository.store.unchanged(second) and not repository.store.unchanged(first)


class Scripted(executor.Engine):
    def __init__(self, script, **limits):
        super().__init__({}, router.Limits(**limits))
        self.script = script

    def _run(self, op):
        return self.script[op.id]()


def steps(*pairs):
    return router.Plan([router.Operation(i, k, "graph", i, (), tuple(after)) for k, (i, after) in enumerate(pairs)])


def test_failed_dependencies_stop_what_needs_them_and_nothing_else():
    def broken():
        raise RuntimeError("engine")

    good = lambda: ("success", [{"x": 1}], False)
    engine = Scripted({"a": broken, "b": good, "c": good, "d": good, "e": good})
    out = engine.execute(steps(("a", []), ("b", ["a"]), ("c", []), ("d", ["c"]), ("e", ["nowhere"])))
    assert [r.status for r in out] == ["error", "skipped", "success", "success", "skipped"]


def test_the_deadline_ends_an_answer():
    def slow():
        time.sleep(1.5)
        return "success", [{"x": 1}], False

    out = Scripted({"a": slow, "b": slow}, deadline_ms=300, concurrent=1).execute(steps(("a", []), ("b", [])))
    assert [(r.status, r.rows) for r in out] == [("partial", []), ("skipped", [])]


@pytest.mark.parametrize(
    ("message", "kind", "symbol"),
    [
        ("what breaks if I change login?", "impact", "login"),
        ("please show me callers of `verify`", "callers", "verify"),
        ("what does A.run call", "callees", "A.run"),
        ("members of class Store", "members", "Store"),
        ("how is login used", "callers", "login"),
        ("impact of change", None, None),
        ("who calls login and logout", None, None),
        ("callers of 'login\"", None, None),
    ],
)
def test_structural_questions(spark, message, kind, symbol):
    got = structural.detected(spark.createDataFrame([(1, message)], "id int, text string")).collect()
    assert [(r["kind"], r["symbol"]) for r in got] == ([(kind, symbol)] if kind else [])


def test_structural_targets_must_be_one_node(spark):
    nodes = spark.createDataFrame([("m:login", "login"), ("m:Store.get", "get"), ("n:get", "get"), ("m:unique_name", "x")], "id string, name string")
    asked = spark.createDataFrame([(k, f"callers of {n}") for k, n in enumerate(["login", "get", "unique", "nothing"])], "id int, text string")
    assert {r["id"] for r in structural.detected(asked, nodes).collect()} == {0, 2}


def test_vectors_without_a_model(spark):
    texts = [("a", "check the password hash"), ("b", "Draw a café chart"), ("c", ""), ("d", None)]
    rows = {r["id"]: r["embedding"] for r in embedding.embedded(spark.createDataFrame(texts, "id string, text string"), size=32).collect()}
    assert all(abs(sum(x * x for x in v) - 1) < 1e-5 and len(v) == 32 for v in rows.values())
    for name, text in texts[:3]:
        assert rows[name] == pytest.approx(embedding.embed_text(text, 32))
    files = spark.createDataFrame([("a.py", b"x", None), ("b.py", b"", None), ("node_modules/c.js", b"x", None), ("d.exe", b"x", None), ("l.py", b"x", "../out.py"), ("m.py", b"x", "a.py"), ("e.md", b"x" * 1_000_001, None)], "path string, content binary, target string")
    assert {r["path"] for r in embedding.indexable(files).collect()} == {"a.py", "m.py"}


def test_a_new_fingerprint_indexes_all(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, content_sha256 string")
    done = files.where("path = 'a'")
    one = embedding.fingerprint("m", 1200, 150, 6, 1, "x")
    assert {r["path"] for r in embedding.to_index(files, done, one, one).collect()} == {"b"}
    assert embedding.to_index(files, done, one, embedding.fingerprint("m", 800, 150, 6, 1, "x")).count() == 2
    assert embedding.to_index(files, done, one, None).count() == 2


def test_stores(spark, tmp_path):
    (tmp_path / "events.json").write_text('{"seq": 1, "file": "a.js", "kind": "call", "startByte": 3, "endByte": 9, "target": {"file": "b.js", "name": "f", "start": 1, "end": 5}}\nnot json\n')
    rows = stores.semantic_events(spark, f"file://{tmp_path}/events.json").collect()
    assert len(rows) == 1 and rows[0]["target"]["name"] == "f" and rows[0]["start_byte"] == 3
    nodes = spark.createDataFrame([("a", "function", "a", "a.py", 1)], stores.NODES)
    edges = spark.createDataFrame([("a", "b", "calls", "a.py", 2)], stores.EDGES)
    stores.save_graph(nodes, edges, f"file://{tmp_path}/g")
    got = stores.load_graph(spark, f"file://{tmp_path}/g")
    assert got[0].collect() == nodes.collect() and got[1].collect() == edges.collect()
    assert [df.count() for df in stores.load_graph(spark, f"file://{tmp_path}/none")] == [0, 0]
    pages = spark.createDataFrame([("x", "text", "h1"), ("x", "text 2", "h2")], "id string, page string, facts_hash string")
    assert [tuple(r) for r in stores.store_pages(pages, f"file://{tmp_path}/docs").collect()] == [("x", "text 2", "h2")]


def test_the_last_of_several_new_vectors_wins(spark):
    empty = spark.createDataFrame([], "chunk_id string, vector_id long, embedding array<float>, payload string")
    rows = spark.createDataFrame([("a", [1.0, 0.0], "old", 1), ("a", [0.0, 1.0], "new", 2)], "chunk_id string, embedding array<float>, payload string, seq int")
    assert [r["payload"] for r in vector_journal.upsert(empty, rows, 2).collect()] == ["new"]


def test_two_writers_of_one_number_have_one_winner(spark, tmp_path):
    store = generations.Store(spark, f"file://{tmp_path}/s")
    for name in ("b", "a"):
        store._write(1, name, "ready", name, [])
    assert store.active()["generation"] == "b"


def test_failed_publications_are_tried_again(spark, tmp_path):
    spark.range(4).selectExpr("id AS event_id", "timestamp_seconds(id * 100) AS ts", "1L AS user_id").coalesce(1).write.parquet(f"{tmp_path}/in")
    seen, waits = [], []

    def publish(batch):
        if len(waits) < 2:
            raise OSError("store")
        seen.extend(batch.collect())

    stream = events.debounced(events.file_events(spark, f"{tmp_path}/in", "event_id long, ts timestamp, user_id long"), "5 seconds", lateness="0 seconds")
    events.publish_changes(stream, publish, f"file://{tmp_path}/state", once=True, sleep=waits.append).awaitTermination(120)
    assert seen and waits == [5, 10]


def test_answers(spark):
    row = lambda c: spark.range(1).select(c.alias("c")).first()["c"]
    assert row(answers.fence(F.lit("a ```` b"))) == "`````" and row(answers.fence(F.lit(""))) == "```"
    assert row(answers.without_citations(F.lit(" a [1, 2] `x[3]` a[4] ```\n[5]\n``` [6]"))) == "a  `x[3]` a[4] ```\n[5]\n```"
    assert row(understanding.chat_intent(F.lit("ＨＩ！"))) == "greeting"
    found = understanding.parse_question("find callers of getUser")
    assert [r.intent for r in found] == ["DIRECT_CALLERS"]
    assert understanding.support(found[0], {"getUser": "resolved"}, True, False) == "supported"
    assert understanding.support(found[0], {"getUser": "ambiguous"}, True, False) == "unresolved"
    assert understanding.support(found[0], {}, False, False) == "unsupported"
