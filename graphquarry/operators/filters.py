"""Predicates over files, symbols and payloads."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphquarry.functions.identity import is_relative_path  # noqa: F401

#: Where tests are, and what a question may filter by.
TEST_PATH = r"(^|/)(tests?|__tests__)/|\.(test|spec)\.|(^|/)test_"
DOCUMENT_OR_TEST = r"\.(md|markdown)$|(^|/)(tests|test|__tests__)(/|$)"
FILTER_KEYS = {"files": "path", "modules": "module", "languages": "language", "symbolTypes": "symbol_kind"}
MOST_VALUES = 25


def checked_filters(filters: dict[str, list[str]] | None) -> dict[str, list[str]]:
    """Known keys, at most MOST_VALUES values each; languages and symbol types in lower case; paths are relative."""
    out = {}
    for key, values in (filters or {}).items():
        if key not in FILTER_KEYS:
            raise ValueError(f"unknown filter {key!r}")
        if len(values) > MOST_VALUES:
            raise ValueError(f"more than {MOST_VALUES} values for {key}")
        if key in ("languages", "symbolTypes"):
            values = [v.lower() for v in values]
        elif any(v.startswith("/") or "\\" in v or {"", ".", ".."} & set(v.split("/")) for v in values):
            raise ValueError(f"{key} must be normalised relative paths")
        out[key] = list(values)
    return out


def metadata_filter(filters: dict[str, list], columns: dict[str, str] | None = None) -> Column:
    """All keys must match, any value of a key; an empty list doesn't filter."""
    names = columns or FILTER_KEYS
    return reduce(and_, (F.col(names[k]).isin(*v) for k, v in filters.items() if v), F.lit(True))


def payload_filter(condition: dict, field=F.col) -> Column:
    """must, should and must_not over conditions with key and match {value | any} or range {gt, gte, lt, lte}."""

    def one(c: dict) -> Column:
        if {"must", "should", "must_not"} & c.keys():
            return payload_filter(c, field)
        value = field(c["key"])
        if "match" in c:
            wanted = [c["match"]["value"]] if "value" in c["match"] else c["match"]["any"]
            return F.coalesce(value.isin(*wanted), F.lit(False))
        number = value.try_cast("double")
        test = {"gt": number.__gt__, "gte": number.__ge__, "lt": number.__lt__, "lte": number.__le__}
        return F.coalesce(reduce(and_, (test[op](bound) for op, bound in c["range"].items())), F.lit(False))

    parts = [one(c) for c in condition.get("must", [])]
    if condition.get("should"):
        parts.append(reduce(or_, map(one, condition["should"])))
    parts += [~one(c) for c in condition.get("must_not", [])]
    return reduce(and_, parts, F.lit(True))


def in_scope(path: Column, scope: str) -> Column:
    """The path itself or one that ends with it."""
    return (path == scope) | path.endswith("/" + scope)


def names_symbol(reference: str, name: str = "name", qualified: str = "qualified_name", identity: str = "id") -> Column:
    return reduce(or_, (F.col(c) == reference for c in (name, qualified, identity)))


def names_module(path: Column, module: str) -> Column:
    """Path, base name, path without extension, or stem."""
    base = F.element_at(F.split(path, "/"), -1)
    bare = lambda p: F.regexp_replace(p, r"\.[^./]*$", "")
    return (path == module) | (base == module) | (bare(path) == module) | (bare(base) == module)


def is_test_path(path: Column) -> Column:
    return path.rlike(TEST_PATH)


def is_document_or_test(path: Column) -> Column:
    return F.lower(path).rlike(DOCUMENT_OR_TEST)


def ready(rows: DataFrame, snapshots: DataFrame, on: str = "snapshot_id") -> DataFrame:
    """Rows of snapshots that are ready."""
    return rows.join(snapshots.where("state = 'ready'").select(F.col("id").alias(on)), on, "left_semi")


def fresh(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows whose source hash is the file's present one."""
    now = files.select("path", F.col("content_sha256").alias("source_hash"))
    return rows.join(now, ["path", "source_hash"], "left_semi")


def stale(rows: DataFrame, files: DataFrame) -> DataFrame:
    now = files.select("path", F.col("content_sha256").alias("source_hash"))
    return rows.join(now, ["path", "source_hash"], "left_anti")


def encloses(line: int, column: int) -> Column:
    """A symbol whose range holds a selection."""
    start, end = F.struct("start_line", "start_column"), F.struct("end_line", "end_column")
    at = F.struct(F.lit(line), F.lit(column))
    return (start <= at) & (at <= end)


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start <= b_end) & (a_end >= b_start)


def agrees(left: str, right: str, columns: list[str]) -> Column:
    """All columns are equal, null with null."""
    return reduce(and_, (F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns))
