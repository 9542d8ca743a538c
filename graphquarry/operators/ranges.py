"""Joins of intervals within a file, by the index of intervals: a file is dealt by blocks, and no span is held against
all points of its file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphquarry.functions import text as T

from . import graph, intervals


def innermost(points: DataFrame, spans: DataFrame, file: str = "file_id", at: str = "offset", start: str = "start_byte", end: str = "end_byte", id_col: str = "id") -> DataFrame:
    """Points with `enclosing`, the narrowest span that holds them (null if none)."""
    s = spans.select(file, F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(id_col).alias("_id"))
    narrow = F.struct((F.col("_e") - F.col("_s")).alias("width"), F.col("_id").alias("id"))
    best = intervals.fold_holding(points, s, [file], at, "_s", "_e", {"_best": ("min", narrow)})
    return points.join(best.select(file, at, F.col("_best.id").alias("enclosing")), [file, at], "left")


def declared(descriptors: DataFrame, symbols: DataFrame) -> DataFrame:
    """Descriptors (file_id, name, d_start, d_end) with the symbol of that name whose span holds theirs or lies within
    it: the nearest span, then the narrowest."""
    s = symbols.select("file_id", "name", F.col("id").alias("symbol_id"), "start_byte", "end_byte")
    holds = (F.col("start_byte") <= F.col("d_start")) & (F.col("d_end") <= F.col("end_byte"))
    inside = (F.col("d_start") <= F.col("start_byte")) & (F.col("end_byte") <= F.col("d_end"))
    far = F.abs(F.col("start_byte") - F.col("d_start")) + F.abs(F.col("end_byte") - F.col("d_end"))
    met = descriptors.join(s, ["file_id", "name"]).where(holds | inside)
    return met.groupBy(*descriptors.columns).agg(F.min_by("symbol_id", F.struct(far, F.col("end_byte") - F.col("start_byte"), "symbol_id")).alias("symbol_id"))


def most_specific(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Chunks (id, file_id, start_line, end_line) with the narrowest symbol that overlaps them, if all others that do so
    hold that symbol; null otherwise. All hold it if none begins after it or ends before it: three values to fold."""
    s = symbols.select("file_id", F.col("id").alias("symbol_id"), F.col("start_line").alias("s"), F.col("end_line").alias("e"))
    narrow = F.struct((F.col("e") - F.col("s")).alias("width"), F.col("s").alias("s"), F.col("symbol_id").alias("id"))
    values = {"_best": ("min", narrow), "_last": ("max", F.col("s")), "_least": ("min", F.col("e"))}
    met = intervals.fold_overlapping(chunks, s, ["file_id"], "start_line", "end_line", "s", "e", values)
    nested = (F.col("_last") <= F.col("_best.s")) & (F.col("_least") >= F.col("_best.s") + F.col("_best.width"))
    found = met.where(nested).select("file_id", "start_line", "end_line", F.col("_best.id").alias("symbol_id"))
    return chunks.join(found, ["file_id", "start_line", "end_line"], "left").select(*chunks.columns, "symbol_id")


def ancestors(symbols: DataFrame) -> DataFrame:
    """id, ancestor: every symbol with itself and all that hold it by parent_symbol_id; parents that aren't there end a
    chain. Each round doubles the steps, so a chain of d parents takes log2(d) joins. A ring ends where it closes."""
    known = symbols.select(F.col("id").alias("parent"))
    up = symbols.select("id", F.col("parent_symbol_id").alias("parent")).where("parent IS NOT NULL AND parent != id").join(known, "parent", "left_semi")
    reach = graph.cut(up.select("id", F.col("parent").alias("ancestor")).distinct())
    n = reach.count()
    while n:
        further = reach.join(reach.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("further")), "ancestor").select("id", F.col("further").alias("ancestor"))
        reach, before = graph.cut(reach.unionByName(further).distinct()), n
        n = reach.count()
        if n == before:
            break
    return reach.where("id != ancestor").unionByName(symbols.select("id", F.col("id").alias("ancestor"))).distinct()


def owners(chunks: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks (id, file_id, start_line, end_line, content) with symbol_id, the narrowest symbol whose lines hold theirs and
    whose own source holds their text, if all others that do so are its ancestors; null otherwise.

    files: file_id, content (bytes); symbols: id, file_id, parent_symbol_id, lines and bytes. Lines alone don't do: two
    declarations may share a line. Line ends are made newlines before texts are compared. Spans that aren't in the file
    hold nothing. A chunk is held against the symbols around its first line, as many as they are nested.
    """
    length = F.col("end_byte") - F.col("start_byte")
    source = T.unix_lines(F.decode(F.substring("content", F.col("start_byte").cast("int") + 1, length.cast("int")), "UTF-8"))
    own = symbols.where("start_byte >= 0 AND start_byte <= end_byte").join(files.select("file_id", "content"), "file_id")
    own = own.select("file_id", F.col("id").alias("_symbol"), F.col("start_line").alias("_s"), (F.col("end_line") + 1).alias("_e"), length.alias("_width"), source.alias("_source"))
    asked = chunks.select("file_id", F.col("id").alias("_chunk"), F.col("start_line").alias("_at"), F.col("end_line").alias("_to"), F.col("content").alias("_text"))
    met = intervals.pairs_holding(asked, own, ["file_id"], "_at", "_s", "_e").where((F.col("_to") < F.col("_e")) & F.contains("_source", "_text"))
    met = graph.cut(met.select("_chunk", "_symbol", "_width"))
    best = met.groupBy("_chunk").agg(F.min(F.struct("_width", "_symbol")).alias("_best"), F.count(F.lit(1)).alias("_n")).select("_chunk", F.col("_best._symbol").alias("_first"), "_n")
    line = ancestors(symbols).select(F.col("id").alias("_first"), F.col("ancestor").alias("_symbol"))
    over = met.join(best, "_chunk").join(line, ["_first", "_symbol"]).groupBy("_chunk", "_first", "_n").agg(F.count(F.lit(1)).alias("_over"))
    return chunks.join(over.where("_over = _n").select(F.col("_chunk").alias("id"), F.col("_first").alias("symbol_id")), "id", "left")


def unique_targets(occurrences: DataFrame, targets: DataFrame, key: list[str], target: str) -> DataFrame:
    """Occurrences with the target that all resolutions of their place agree on."""
    one = targets.groupBy(*key).agg(F.min(target).alias(target), F.count_distinct(target).alias("n")).where("n = 1").drop("n")
    return occurrences.join(one, key, "left")


def with_callers(hits: DataFrame, symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """Search hits (hit_id, file_id, start_line, end_line) with the distinct callers of the symbols that they overlap."""
    s = symbols.select("file_id", F.col("id").alias("target"), F.col("start_line").alias("s"), F.col("end_line").alias("e"))
    asked = hits.select("file_id", "hit_id", F.col("start_line").alias("_from"), F.col("end_line").alias("_to"))
    met = intervals.pairs_overlapping(asked, s, ["file_id"], "_from", "_to", "s", "e").select("hit_id", "target")
    who = met.join(calls.select("source", "target"), "target").groupBy("hit_id").agg(F.array_sort(F.collect_set("source")).alias("callers"))
    return hits.join(who, "hit_id", "left").withColumn("graph_verified", F.col("callers").isNotNull())
