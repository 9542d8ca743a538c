"""Identity functions as column expressions: hashes of canonical JSON, name-based UUIDs, path predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the namespace of chunk identifiers.
CHUNK_NAMESPACE = "a3f1b2c4-d5e6-7890-abcd-ef1234567890"


def json_string(value: Column) -> Column:
    """A JSON string literal."""
    listed = F.to_json(F.array(value.cast("string")))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def json_list(*parts: Column) -> Column:
    """A JSON list of strings whose separator is a comma and a blank."""
    return F.concat(F.lit("["), F.concat_ws(", ", *map(json_string, parts)), F.lit("]"))


def entity_id(kind: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.sha2(json_list(*parts), 256))


def repository_id(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, 24)


def file_id(repository: Column, path: Column) -> Column:
    return entity_id("File", repository, path)


def name_uuid(name: Column, namespace: str = CHUNK_NAMESPACE) -> Column:
    """The version 5 UUID of a name."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    hexa = lambda at, n: F.substring(digest, at, n)
    variant = F.lower(F.hex(F.conv(hexa(17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat(hexa(1, 8), F.lit("-"), hexa(9, 4), F.lit("-5"), hexa(14, 3), F.lit("-"), variant, hexa(18, 3), F.lit("-"), hexa(21, 12))


def chunk_id(repository: Column, path: Column, rest: Column) -> Column:
    return name_uuid(F.concat_ws("::", repository, path, rest))


def vector_id(chunk: Column) -> Column:
    """The first eight bytes of the SHA-256, without the sign bit."""
    head = F.substring(F.sha2(chunk, 256), 1, 16)
    clear = F.lower(F.hex(F.conv(F.substring(head, 1, 1), 16, 10).cast("int").bitwiseAND(F.lit(7))))
    return F.conv(F.concat(clear, F.substring(head, 2, 15)), 16, 10).cast("long")


def is_relative_path(path: Column) -> Column:
    """A normalised relative POSIX path: no backslash, no root, no empty, `.` or `..` part."""
    parts = F.split(path, "/")
    return (F.length(path) > 0) & ~path.contains("\\") & F.forall(parts, lambda p: ~p.isin("", ".", ".."))


def ordinal_identity(rows, group: list[str], order: str):
    """Running number of rows that agree in `group`, in the order of the visit, from 0."""
    from pyspark.sql import Window

    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(*group).orderBy(order)) - 1)
