"""Incremental maintenance: a change of some files is carried through everything that was derived from them.

A state holds files, symbols, calls (the raw call sites of each file), chunks, vectors, names (how many symbols have a
name, and which if it is one), and edges (the resolved call sites). update() replaces what the changed files own, counts
only the names that they touch, and resolves again only the call sites of changed files and those of other files whose
name is resolved otherwise than before. The result is that of building everything anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph, snapshots

#: Tables of a state whose rows belong to a file, and files whose contents are looked into.
OWNED = ("symbols", "calls", "chunks")
INDEXED = ("included", "unsupported")
State = dict[str, DataFrame]


def names_of(symbols: DataFrame) -> DataFrame:
    """name, n, only (the id if n is 1) of all symbols but modules."""
    counted = symbols.where("kind != 'module'").groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    return counted.select("name", "n", F.when(F.col("n") == 1, F.col("least")).alias("only"))


def resolve(calls: DataFrame, symbols: DataFrame, names: DataFrame) -> DataFrame:
    """The calls (source, file, name, line) with target: the symbol `file:name`, else the only symbol of that name, else the
    bare name."""
    exact = symbols.select(F.col("id").alias("own")).distinct()
    single = graph.if_small(names.where("n = 1").select("name", "only"))
    out = calls.join(exact, F.concat_ws(":", "file", "name") == F.col("own"), "left").join(single, "name", "left")
    return out.select("source", "file", "name", "line", F.coalesce("own", "only", "name").alias("target"))


def build(files: DataFrame, symbols: DataFrame, calls: DataFrame | None, chunks: DataFrame | None, vectors: DataFrame | None) -> State:
    """A state from scratch. files: path, content_sha256, status; symbols: id, path, kind, name; calls: source, file, name,
    line; chunks: id, path and more; vectors: id (of a chunk) and more. A state may be without calls, and so without edges, and
    without chunks and vectors: what nobody asks for isn't kept up."""
    names = graph.cut(names_of(symbols))
    out = {"files": files, "symbols": symbols, "names": names}
    if calls is not None:
        out |= {"calls": calls, "edges": graph.cut(resolve(calls, symbols, names))}
    return out if chunks is None else out | {"chunks": chunks, "vectors": vectors}


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change (added, deleted, changed) between two inventories. A file that is no longer looked into counts as
    deleted, one that is again as added."""
    seen = lambda files: files.where(F.col("status").isin(*INDEXED)).select("path", "content_sha256")
    return snapshots.difference(seen(old), seen(new), "path", "content_sha256")


def _file_of(table: str) -> str:
    return "file" if table == "calls" else "path"


def update(state: State, files: DataFrame, facts: State) -> State:
    """The state of the inventory `files`. `facts` has symbols, calls, chunks and vectors of the files that were added or
    changed; facts of other files are left out. Files of both inventories are unique by path. Every table is written, so
    a lost executor costs nothing that was finished, and the old state stays as it is."""
    delta = graph.cut(changes(state["files"], files))
    gone = graph.if_small(delta.where("change != 'added'").select("path"))
    fresh = graph.if_small(delta.where("change != 'deleted'").select("path"))
    out: State = {"files": files}
    removed, added = {}, {}
    for name in (t for t in OWNED if t in state):
        of = _file_of(name)
        removed[name] = state[name].join(gone.withColumnRenamed("path", of), of, "left_semi")
        added[name] = graph.cut(facts[name].join(fresh.withColumnRenamed("path", of), of, "left_semi"))
        kept = state[name].join(gone.withColumnRenamed("path", of), of, "left_anti")
        out[name] = graph.cut(kept.select(state[name].columns).unionByName(added[name].select(state[name].columns)))
    if "chunks" in state:
        dead = graph.if_small(graph.cut(removed["chunks"].select("id")))
        own = facts["vectors"].join(added["chunks"].select("id"), "id", "left_semi")
        out["vectors"] = graph.cut(state["vectors"].join(dead, "id", "left_anti").select(state["vectors"].columns).unionByName(own.select(state["vectors"].columns)))

    # names: only those that a removed or an added symbol has are counted again
    touched = graph.cut(removed["symbols"].select("name").union(added["symbols"].select("name")).distinct())
    few = graph.if_small(touched)
    again = graph.cut(names_of(out["symbols"].join(few, "name", "left_semi")))
    out["names"] = graph.cut(state["names"].join(few, "name", "left_anti").select("name", "n", "only").unionByName(again))
    if "calls" not in state:
        return out
    was = state["names"].join(few, "name", "left_semi").select("name", F.col("only").alias("was"))
    moved = touched.join(was, "name", "left").join(again.select("name", "only"), "name", "left").where("NOT was <=> only").select("name")
    moved = graph.if_small(graph.cut(moved))

    # edges: call sites of changed files, and call sites of others whose name now means something else
    stale = state["edges"].join(gone.withColumnRenamed("path", "file"), "file", "left_anti").join(moved, "name", "left_anti")
    elsewhere = out["calls"].join(moved, "name", "left_semi").join(fresh.withColumnRenamed("path", "file"), "file", "left_anti")
    made = resolve(added["calls"].select("source", "file", "name", "line").unionByName(elsewhere.select("source", "file", "name", "line")), out["symbols"], out["names"])
    out["edges"] = graph.cut(stale.select(made.columns).unionByName(made))
    return out
