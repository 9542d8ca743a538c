import random
from collections import Counter

from graphquarry.operators import maintenance

SHAPES = {"files": "path string, content_sha256 string, status string", "symbols": "id string, path string, kind string, name string", "calls": "source string, file string, name string, line int", "chunks": "id string, path string", "vectors": "id string, x double"}


def facts_of(path, version):
    """What a file of this version holds."""
    r = random.Random(f"{path}/{version}")
    names = sorted({f"n{r.randrange(14)}" for _ in range(r.randrange(5))})
    symbols = [(f"{path}:{n}", path, "function", n) for n in names] + [(path, path, "module", path)]
    calls = [(f"{path}:{r.randrange(3)}", path, f"n{r.randrange(14)}", k) for k in range(r.randrange(7))]
    chunks = [(f"{path}/{version}/{k}", path) for k in range(r.randrange(3))]
    return {"symbols": symbols, "calls": calls, "chunks": chunks, "vectors": [(c[0], 1.0) for c in chunks]}


def frames(spark, versions):
    out = {k: spark.createDataFrame([x for p, v in versions.items() for x in facts_of(p, v)[k]], SHAPES[k]) for k in SHAPES if k != "files"}
    return out


def inventory(spark, versions, ignored=()):
    rows = [(p, f"h{v}", "ignored" if p in ignored else "included") for p, v in versions.items()]
    return spark.createDataFrame(rows, SHAPES["files"])


def rows(df):
    return Counter(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


def test_updates_equal_rebuilds_on_random_changes(spark):
    r = random.Random(8)
    versions, ignored = {f"f{k}": 0 for k in range(8)}, set()
    of = frames(spark, versions)
    state = maintenance.build(inventory(spark, versions), of["symbols"], of["calls"], of["chunks"], of["vectors"])
    for turn in range(1, 5):
        shown = {p: v for p, v in versions.items() if p not in ignored}
        for p in r.sample(sorted(versions), 2):
            versions[p] += 1
        versions.pop(r.choice(sorted(versions)))
        versions[f"new{turn}"] = 0
        ignored = {r.choice(sorted(versions))}
        now = {p: v for p, v in versions.items() if p not in ignored}
        files = inventory(spark, versions, ignored)
        state = maintenance.update(state, files, frames(spark, {p: v for p, v in now.items() if shown.get(p) != v}))
        of = frames(spark, now)
        anew = maintenance.build(files, of["symbols"], of["calls"], of["chunks"], of["vectors"])
        for name in ("symbols", "calls", "chunks", "vectors", "names", "edges"):
            assert rows(state[name]) == rows(anew[name]), (turn, name)


def test_nothing_changed_and_everything_gone(spark):
    versions = {"a": 0, "b": 3}
    of = frames(spark, versions)
    files = inventory(spark, versions)
    state = maintenance.build(files, of["symbols"], of["calls"], of["chunks"], of["vectors"])
    none = {k: v.limit(0) for k, v in of.items()}
    same = maintenance.update(state, files, none)
    assert all(rows(same[k]) == rows(state[k]) for k in state)
    empty = maintenance.update(state, files.limit(0), none)
    assert all(empty[k].count() == 0 for k in empty)
    assert all(rows(maintenance.update(empty, files, of)[k]) == rows(state[k]) for k in state)


def test_a_state_keeps_up_only_what_it_has(spark):
    from graphquarry.operators import maintenance

    files = spark.createDataFrame([("a", "1", "included"), ("b", "1", "included")], "path string, content_sha256 string, status string")
    now = spark.createDataFrame([("a", "2", "included"), ("b", "1", "included")], "path string, content_sha256 string, status string")
    symbols = spark.createDataFrame([("a:f", "a", "function", "f"), ("b:g", "b", "function", "g")], "id string, path string, kind string, name string")
    fresh = spark.createDataFrame([("a:g", "a", "function", "g")], symbols.schema)
    state = maintenance.build(files, symbols, None, None, None)
    later = maintenance.update(state, now, {"symbols": fresh})
    assert set(later) == {"files", "symbols", "names"}
    assert [tuple(r) for r in later["names"].collect()] == [("g", 2, None)]
