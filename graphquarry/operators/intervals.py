"""An interval index: spans of whole numbers are cut into aligned blocks, so that ranges are joined by equality.

A block of level k has 8 ** k numbers and begins at a multiple of that. A span [start, end) is the union of at most 14
blocks of each level up to the one that its length reaches; a point lies in one block of each level. So the spans that hold
a point are those that share one of its blocks, each once. What is asked for is mostly a least or greatest value (the
narrowest span, say): then an index keeps one value for a block, and n spans and m points cost about n + m times the
number of levels, however the spans overlap. Blocks are dealt by their number, not by file, so that one large file is
dealt like many small ones; and since equal points are asked once, a block of level k is asked at most 8 ** k times.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 3
FOLDS = {"min": F.min, "max": F.max}
#: Values to fold: of each name, "min" or "max" and what of.
Values = dict[str, tuple[str, Column]]
_BLOCK = ["_level", "_block"]


def levels_for(spans: DataFrame, start: str, end: str) -> int:
    """The highest level of a block that fits in a span: one number of the whole table."""
    longest = spans.agg(F.max(F.col(end) - F.col(start)).alias("n")).first()["n"] or 0
    return max(0, (int(longest).bit_length() - 1) // BITS)


def _named(level: int, block: Column) -> Column:
    return F.struct(F.lit(level).alias("_level"), block.cast("long").alias("_block"))


def blocks_of_span(start: Column, end: Column, levels: int) -> Column:
    """The blocks (_level, _block) whose union is [start, end); none if it is empty or null."""
    start, end = start.cast("long"), end.cast("long")
    edge = lambda k: (-F.shiftright(-start, BITS * k), F.shiftright(end, BITS * k))
    none = F.array().cast("array<struct<_level:int,_block:bigint>>")
    parts = []
    for k in range(levels + 1):
        a, b = edge(k)
        up_a, up_b = (F.shiftleft(x, BITS) for x in edge(k + 1))
        run = lambda x, y, k=k: F.when(x < y, F.transform(F.sequence(x, y - 1), lambda n: _named(k, n))).otherwise(none)
        parts.append(run(a, b) if k == levels else F.when(up_a < up_b, F.concat(run(a, up_a), run(up_b, b))).otherwise(run(a, b)))
    return F.concat(*parts)


def blocks_of_point(at: Column, levels: int) -> Column:
    return F.array(*(_named(k, F.shiftright(at.cast("long"), BITS * k)) for k in range(levels + 1)))


def _folded(rows: DataFrame, keys: list[str], values: Values) -> DataFrame:
    return rows.groupBy(*keys).agg(*(FOLDS[how](name).alias(name) for name, (how, _) in values.items()))


def _with_values(rows: DataFrame, keys: list[Column | str], values: Values) -> DataFrame:
    return rows.select(*keys, *(c.alias(name) for name, (_, c) in values.items()))


def _flat(rows: DataFrame) -> DataFrame:
    return rows.select(*(c for c in rows.columns if c != "_b"), "_b._level", "_b._block").drop("_b")


def fold_holding(points: DataFrame, spans: DataFrame, on: list[str], at: str, start: str, end: str, values: Values) -> DataFrame:
    """The distinct points (on, at) that a span [start, end) holds, with the values folded over all spans that do."""
    levels = levels_for(spans, start, end)
    index = _with_values(spans, [*on, F.explode(blocks_of_span(F.col(start), F.col(end), levels)).alias("_b")], values)
    index = _folded(_flat(index), [*on, *_BLOCK], values)
    asked = _flat(points.select(*on, at).distinct().select("*", F.explode(blocks_of_point(F.col(at), levels)).alias("_b")))
    return _folded(asked.join(index, [*on, *_BLOCK]), [*on, at], values)


def fold_within(spans: DataFrame, points: DataFrame, on: list[str], at: str, start: str, end: str, values: Values) -> DataFrame:
    """The distinct spans (on, start, end) that hold a point, with the values folded over all points in [start, end)."""
    levels = levels_for(spans, start, end)
    index = _with_values(points, [*on, F.explode(blocks_of_point(F.col(at), levels)).alias("_b")], values)
    index = _folded(_flat(index), [*on, *_BLOCK], values)
    asked = _flat(spans.select(*on, start, end).distinct().select("*", F.explode(blocks_of_span(F.col(start), F.col(end), levels)).alias("_b")))
    return _folded(asked.join(index, [*on, *_BLOCK]), [*on, start, end], values)


def fold_overlapping(ranges: DataFrame, spans: DataFrame, on: list[str], start: str, end: str, span_start: str, span_end: str, values: Values) -> DataFrame:
    """The distinct ranges (on, start, end) that share a number with a span, both ends included, with the values folded
    over all spans that do: those that hold the range's start, and those that begin after it within the range."""
    whole = ranges.select(*on, start, end).distinct()
    held = spans.withColumn("_after", F.col(span_end) + 1)
    first = fold_holding(whole, held, on, start, span_start, "_after", values)
    first = whole.join(first, [*on, start])
    inner = whole.withColumns({"_from": F.col(start) + 1, "_after": F.col(end) + 1})
    second = fold_within(inner, spans.where(F.col(span_start) <= F.col(span_end)), on, span_start, "_from", "_after", values)
    second = inner.join(second, [*on, "_from", "_after"])
    shape = [*on, start, end, *values]
    return _folded(first.select(shape).unionByName(second.select(shape)), [*on, start, end], values)


def pairs_holding(points: DataFrame, spans: DataFrame, on: list[str], at: str, start: str, end: str) -> DataFrame:
    """Every pair of a point and a span [start, end) that holds it, with the columns of both, each pair once. The names of
    columns differ but for `on`."""
    levels = levels_for(spans, start, end)
    left = _flat(points.select("*", F.explode(blocks_of_point(F.col(at), levels)).alias("_b")))
    right = _flat(spans.select("*", F.explode(blocks_of_span(F.col(start), F.col(end), levels)).alias("_b")))
    return left.join(right, [*on, *_BLOCK]).drop(*_BLOCK)


def pairs_overlapping(ranges: DataFrame, spans: DataFrame, on: list[str], start: str, end: str, span_start: str, span_end: str) -> DataFrame:
    """Every pair of a range and a span that share a number, both ends included, each pair once: the span holds the
    range's start, or begins after it within the range. As many rows as there are pairs."""
    held = pairs_holding(ranges, spans.withColumn("_after", F.col(span_end) + 1), on, start, span_start, "_after")
    inner = ranges.withColumns({"_from": F.col(start) + 1, "_after": F.col(end) + 1})
    begun = pairs_holding(spans.where(F.col(span_start) <= F.col(span_end)), inner, on, span_start, "_from", "_after")
    shape = [*on, *(c for c in ranges.columns + spans.columns if c not in on)]
    both = [x.where(reduce(and_, [F.col(start) <= F.col(end), F.col(span_start) <= F.col(span_end)])).select(shape) for x in (held, begun)]
    return both[0].unionByName(both[1])
