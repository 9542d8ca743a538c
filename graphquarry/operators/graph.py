"""Traversals of a property graph held as edge frames (source, target, relationship, resolution, evidence columns).

Frontiers are joined hop by hop and written to the shared folder after each, so the plan stays short and a lost executor
costs one hop at most.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .filters import is_test_path, names_module

MOST_IMPACT = 500
#: Hops after which what has been seen is written as one.
COMPACTED = 8


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. A folder of our own stands in only for a master within this machine (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/graphquarry-scratch"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder, and read it back."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """As cut(), in as many buckets by a key as a shuffle has parts: joins by the key then shuffle the other side alone. The table's
    name is taken out of the catalog again; its files stay in the shared folder."""
    spark, table = df.sparkSession, f"cut_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").option("compression", "zstd").option("path", f"{shared_folder(spark)}/{table}")
    writer.bucketBy(shuffle_parts(spark), key).sortBy(key).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return out


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: Rows of a task of a join or an order that is dealt by `tasks`.
TASK_ROWS = 100_000


def tasks(*frames: DataFrame) -> int:
    """How many tasks frames that meet by a key are dealt to: their number grows with the rows, so the rows of a task, and what it
    holds in memory, don't. The frames are counted, so they are read once more: give what is cheap to make."""
    return max(1, ceil(sum(f.count() for f in frames) / TASK_ROWS))


#: Keys of a set up to which it is broadcast.
BROADCAST_KEYS = 300_000


def if_small(keys: DataFrame, limit: int = BROADCAST_KEYS) -> DataFrame:
    """Keys with a broadcast hint if they are counted and at most `limit`; beyond that they are joined by a shuffle. That is said
    by a hint too: files of many short keys are small enough to be broadcast by their size, and fill the driver as a table."""
    return F.broadcast(keys) if keys.limit(limit + 1).count() <= limit else keys.hint("merge")


def looked_up(rows: DataFrame, lookup: DataFrame, on: list[str], limit: int = BROADCAST_KEYS) -> DataFrame:
    """Rows with the columns of a lookup by the keys `on`, null where there is none. A small lookup is broadcast; beyond that
    rows whose first key is null stay where they are, for in a shuffle they would all meet in one task. Both are read
    more than once: give what is written, or cheap to make."""
    if lookup.limit(limit + 1).count() <= limit:
        return rows.join(F.broadcast(lookup), on, "left")
    none = {c: F.lit(None).cast(kind) for c, kind in lookup.dtypes if c not in on}
    met = rows.where(F.col(on[0]).isNotNull()).join(lookup.hint("merge"), on, "left")
    return met.unionByName(rows.where(F.col(on[0]).isNull()).withColumns(none))


def resolved(edges: DataFrame, relationship: str) -> DataFrame:
    return edges.where((F.col("resolution") == "resolved") & (F.col("relationship") == relationship))


def at(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """The edges with an end among `ends` (id), each once: what several operations on the same nodes read."""
    ids = cut(ends.select("id").distinct())
    flag = lambda side: if_small(ids.select(F.col("id").alias(side), F.lit(True).alias(f"_{side}")))
    met = edges.join(flag("source"), "source", "left").join(flag("target"), "target", "left")
    return met.where("_source OR _target").select(edges.columns)


def callers(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row for each call site whose target is among `symbols` (id)."""
    return resolved(edges, "CALLS").join(symbols.select(F.col("id").alias("target")), "target", "left_semi")


def callees(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    return resolved(edges, "CALLS").join(symbols.select(F.col("id").alias("source")), "source", "left_semi")


def imports(edges: DataFrame, modules: DataFrame, inferred: bool = False) -> DataFrame:
    allowed = ["resolved", "inferred"] if inferred else ["resolved"]
    rows = edges.where((F.col("relationship") == "IMPORTS") & F.col("resolution").isin(allowed))
    return rows.join(modules.select(F.col("id").alias("source")), "source", "left_semi")


def reverse_dependencies(edges: DataFrame, modules: DataFrame) -> DataFrame:
    return resolved(edges, "DEPENDS_ON").join(modules.select(F.col("id").alias("target")), "target", "left_semi")


def test_references(edges: DataFrame, symbols: DataFrame, limit: int) -> tuple[DataFrame, bool]:
    """Resolved calls and references from test files, and whether there are more than `limit`."""
    rows = edges.where((F.col("resolution") == "resolved") & F.col("relationship").isin("CALLS", "REFERENCES") & is_test_path(F.col("evidence_file")))
    rows = rows.join(symbols.select(F.col("id").alias("target")), "target", "left_semi")
    return limited(rows, limit, "evidence_file", "evidence_line", "id")


def limited(rows: DataFrame, limit: int, *order) -> tuple[DataFrame, bool]:
    """The first rows, and whether more were there: one row more than asked for is looked at."""
    probe = rows.orderBy(*order).limit(limit + 1)
    return probe.limit(limit), probe.count() > limit


def unresolved(edges: DataFrame, source: Column | None = None, module: Column | None = None) -> DataFrame:
    if source is not None and module is not None:
        raise ValueError("either a symbol or a module")
    rows = edges.where("resolution = 'unresolved'")
    scope = source if source is not None else module
    return rows if scope is None else rows.where(scope)


def reach(edges: DataFrame, seeds: DataFrame, depth: int, most: int | None = None, reverse: bool = True) -> DataFrame:
    """id, depth, via: nodes reached from `seeds` (id) in up to `depth` hops, each at its first depth. `via` is the
    smallest neighbour it was reached from. With `most`, the first nodes by depth, via and id."""
    step = cut(edges.select(F.col("target" if reverse else "source").alias("via"), F.col("source" if reverse else "target").alias("id")).distinct())
    seen = cut(seeds.select("id", F.lit(0).alias("depth"), F.lit(None).cast(dict(step.dtypes)["via"]).alias("via")).dropDuplicates(["id"]))
    frontier = seen
    for hop in range(1, depth + 1):
        found = frontier.select(F.col("id").alias("via")).join(step, "via").groupBy("id").agg(F.min("via").alias("via"))
        found = cut(found.join(seen, "id", "left_anti").select("id", F.lit(hop).alias("depth"), "via"))
        if found.isEmpty():
            break
        seen, frontier = seen.unionByName(found), found
        if hop % COMPACTED == 0:  # so that a hop never reads more than so many folders
            seen = cut(seen)
    out = seen.where("depth > 0")
    return out if most is None else out.orderBy("depth", "via", "id").limit(most)


def closure(edges: DataFrame, seeds: DataFrame, reverse: bool = True, most_hops: int = 10_000) -> DataFrame:
    """id of all that depends on the seeds, and the seeds themselves, to the fixed point."""
    return reach(edges, seeds, most_hops, reverse=reverse).select("id").unionByName(seeds.select("id").distinct())


def paths(edges: DataFrame, starts: DataFrame, goals: DataFrame, max_depth: int, max_paths: int, max_work: int) -> tuple[DataFrame, bool]:
    """Simple paths from starts (id) to goals (id), shortest first, and whether a bound cut the search.

    Parallel edges give parallel paths. The start is never visited again. The partial paths of a hop are bounded by
    max_work in the order of their edge ids.
    """
    if not (1 <= max_depth <= 20 and 1 <= max_paths <= 1000 and 1 <= max_work <= 50_000):
        raise ValueError("bounds of a path search")
    step = edges.select(F.col("source").alias("end"), F.col("target").alias("next"), F.col("id").alias("edge"))
    open_ = cut(starts.select(F.array("id").alias("nodes"), F.array().cast(f"array<{dict(edges.dtypes)['id']}>").alias("edges"), F.col("id").alias("end")))
    found, work, truncated = None, open_.count(), False
    for _ in range(max_depth):
        longer = open_.join(step, "end").where(~F.array_contains("nodes", F.col("next")))
        longer = longer.select(F.concat("nodes", F.array("next")).alias("nodes"), F.concat("edges", F.array("edge")).alias("edges"), F.col("next").alias("end"))
        longer = cut(longer.orderBy("edges").limit(max_work - work + 1))
        size = longer.count()
        if work + size > max_work:
            truncated = True
            longer = longer.orderBy("edges").limit(max_work - work)
            size = max_work - work
        work += size
        done = longer.join(goals.select(F.col("id").alias("end")), "end", "left_semi").select("nodes", "edges")
        found = done if found is None else found.unionByName(done)
        open_ = longer.join(goals.select(F.col("id").alias("end")), "end", "left_anti")
        if not size or truncated or open_.isEmpty():
            break
    out = found.orderBy(F.size("edges"), "edges").limit(max_paths + 1)
    return out.limit(max_paths), truncated or out.count() > max_paths


def lookup(rows: DataFrame, condition: Column, most: int = 101) -> tuple[str, DataFrame]:
    """not_found, success or ambiguous, with the candidates."""
    found = rows.where(condition).limit(most)
    n = found.count()
    return ("not_found" if not n else "success" if n == 1 else "ambiguous"), found


def module(files: DataFrame, reference: str) -> tuple[str, DataFrame]:
    """Exact module names first, path suffixes only if there is none."""
    status, found = lookup(files, names_module(F.col("path"), reference))
    return (status, found) if status != "not_found" else lookup(files, F.col("path").endswith("/" + reference))


def legacy_node(nodes: DataFrame, reference: str) -> DataFrame:
    """The node of a name: by id, by unique name, the only one that is no module, the first, a unique part of a name."""
    part = F.contains(F.lower(F.col("name")), F.lit(reference.lower()))
    rank = F.when(F.col("id") == reference, 0).when((F.col("name") == reference) & (F.col("kind") != "module"), 1).when(F.col("name") == reference, 2).when(part, 3)
    some = nodes.withColumn("rank", rank).where("rank IS NOT NULL")
    best = some.join(F.broadcast(some.agg(F.min("rank").alias("rank"))), "rank")  # one row
    counted = best.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("rank")))
    return counted.where("rank < 3 OR n = 1").orderBy("id").limit(1).drop("rank", "n")


def resolve_calls(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """source, target of calls (source, file, name): the node `file:name`, else the node of a name that is unique in all
    files, else the bare name, which stays dangling. Further columns, such as the line of a call, stay."""
    unique = nodes.where("kind != 'module'").groupBy("name").agg(F.min("id").alias("only"), F.count(F.lit(1)).alias("n")).where("n = 1")
    exact = nodes.select(F.col("id").alias("own")).distinct()
    out = calls.join(exact, F.concat_ws(":", "file", "name") == F.col("own"), "left").join(unique, "name", "left")
    return out.select("source", F.coalesce("own", "only", "name").alias("target"), *(c for c in calls.columns if c not in ("source", "file", "name")))


def module_edges(imports_: DataFrame, modules: DataFrame) -> DataFrame:
    """source, target, relationship, resolution, line of imports (source, target: a module's name, sure, line): IMPORTS and
    DEPENDS_ON of modules (id) that are known, inferred IMPORTS of packages that aren't; a name that begins with a dot is
    unresolved. What isn't sure (a name that may be a module or something in it) counts only if it is a known module."""
    known = modules.select(F.col("id").alias("target"), F.lit(True).alias("known"))
    rows = imports_.join(known, "target", "left").where("known OR sure")
    state = F.when(F.col("known"), "resolved").when(F.col("target").startswith("."), "unresolved").otherwise("inferred")
    names = F.when(F.col("known"), F.array(F.lit("IMPORTS"), F.lit("DEPENDS_ON"))).otherwise(F.array(F.lit("IMPORTS")))
    return rows.select("source", "target", F.explode(names).alias("relationship"), state.alias("resolution"), "line")


def statistics(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    e = edges.agg(F.count(F.lit(1)).alias("edges"), *(F.count_if(F.col("resolution") == r).alias(r) for r in ("resolved", "inferred", "unresolved")))
    return nodes.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(e)  # one row each


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.coalesce(column, F.lit("unknown")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def last_wins(edges: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of edges with one key, the last event."""
    at = Window.partitionBy(*key).orderBy(F.desc(order))
    return edges.withColumn("n", F.row_number().over(at)).where("n = 1").drop("n")


def within_footprint(nodes: DataFrame, edges: DataFrame, max_nodes: int, max_edges: int) -> bool:
    return nodes.limit(max_nodes + 1).count() <= max_nodes and edges.limit(max_edges + 1).count() <= max_edges


def contains_edges(paths_: DataFrame) -> DataFrame:
    """Directory chain of each path as CONTAINS edges."""
    parts = F.split("path", "/")
    prefix = lambda n: F.array_join(F.slice(parts, 1, n), "/")
    long = paths_.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.when(i == 1, F.lit(".")).otherwise(prefix(i - 1)).alias("source"), prefix(i).alias("target")))).alias("e"))
    return long.select("e.source", "e.target", F.lit("CONTAINS").alias("relationship")).distinct()


def resolve_imports(imports_: DataFrame, files: DataFrame, aliases: list[str]) -> DataFrame:
    """source, target, relationship, resolution of imports (source, specifier, resolved_path): indexed targets are
    IMPORTS and DEPENDS_ON, bare specifiers outside the aliases are inferred external packages, others unresolved."""
    known = files.select(F.col("path").alias("resolved_path"), F.lit(True).alias("indexed"))
    rows = imports_.join(known, "resolved_path", "left")
    bare = ~F.col("specifier").rlike(r"^[./]") & ~F.coalesce(F.col("specifier").rlike("^(" + "|".join(aliases) + ")") if aliases else F.lit(False), F.lit(False))
    kind = F.when(F.col("indexed"), "resolved").when(bare, "inferred").otherwise("unresolved")
    names = F.when(F.col("indexed"), F.array(F.lit("IMPORTS"), F.lit("DEPENDS_ON"))).otherwise(F.array(F.lit("IMPORTS")))
    target = F.when(F.col("indexed"), F.col("resolved_path")).when(bare, F.concat(F.lit("external:"), F.col("specifier")))
    return rows.select("source", target.alias("target"), F.explode(names).alias("relationship"), kind.alias("resolution"))


def references(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Resolved references and calls to symbols (id)."""
    rows = edges.where((F.col("resolution") == "resolved") & F.col("relationship").isin("REFERENCES", "CALLS"))
    return rows.join(symbols.select(F.col("id").alias("target")), "target", "left_semi")


def importers(edges: DataFrame, modules: DataFrame) -> DataFrame:
    return resolved(edges, "IMPORTS").join(modules.select(F.col("id").alias("target")), "target", "left_semi")


def dependencies(edges: DataFrame, modules: DataFrame) -> DataFrame:
    return resolved(edges, "DEPENDS_ON").join(modules.select(F.col("id").alias("source")), "source", "left_semi")


#: Operations on a symbol or module by name, as functions of edges and found nodes (id).
OPERATIONS = {
    "find_callers": callers,
    "find_callees": callees,
    "find_references": references,
    "find_imports": lambda edges, modules: imports(edges, modules, inferred=True),
    "find_importers": importers,
    "find_dependencies": dependencies,
    "find_reverse_dependencies": reverse_dependencies,
}


def resolve_names(names: DataFrame, symbols: DataFrame, most: int = 25) -> DataFrame:
    """name, status (not_found, success, ambiguous) and candidates of many names at once: symbols of that name, qualified name or
    id, the first `most` by id. Ambiguity is never settled here."""
    keys = symbols.select("id", F.explode(F.array_distinct(F.array("name", "qualified_name", "id"))).alias("name"))
    met = names.select("name").distinct().join(keys, "name", "left")
    place = F.row_number().over(Window.partitionBy("name").orderBy("id"))
    met = met.withColumn("n", F.count("id").over(Window.partitionBy("name"))).withColumn("place", place).where(F.col("place") <= most)
    out = met.groupBy("name").agg(F.max("n").alias("n"), F.array_sort(F.collect_list("id")).alias("candidates"))
    return out.select("name", F.when(F.col("n") == 0, "not_found").when(F.col("n") == 1, "success").otherwise("ambiguous").alias("status"), "candidates")
