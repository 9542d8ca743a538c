"""The inventory of a directory: one row for each file, with a status and the first reason that applies."""

from __future__ import annotations

import re
from fnmatch import translate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphquarry.functions.text import SECRET_MARKERS

#: Fixed values of the classification.
SOURCE_LANGUAGES = {
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript",
}
CONFIG_LANGUAGES = {".json": "json", ".yaml": "yaml"}
CONFIG_NAMES = (
    "package.json", "package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "pnpm-workspace.yaml",
    "bun.lock", "bun.lockb", "jsconfig.json", "webpack.config.js", "rollup.config.js", "vite.config.js", "vite.config.ts",
    "next.config.js", "next.config.mjs", "next.config.ts", "eslint.config.js", "eslint.config.mjs", "eslint.config.ts",
    "babel.config.js", "babel.config.json", ".gitignore",
)
EXCLUDED_DIRS = (
    ".git", ".hg", ".svn", "node_modules", ".venv", "venv", "env", "dist", "build", "out", "coverage", ".next", ".cache",
    "vendor", "__pycache__", ".pytest_cache", ".vscode-test",
)
SENSITIVE_NAMES = (".env", ".npmrc", ".pypirc", ".netrc", "id_rsa", "id_ed25519", "credentials.json", "secrets.json", "service-account.json")
SENSITIVE = r"^(\.env\..*|service-account.*\.json|.*\.(pem|key|p12|pfx|jks|keystore))$"
MAX_BYTES, BINARY_PROBE = 1_000_000, 8192


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(name_of(path), r"[^.](\.[^.]*)$", 1))


def is_config(path: Column) -> Column:
    return name_of(path).isin(*CONFIG_NAMES) | name_of(path).rlike(r"^tsconfig\..*(?<=\.)json$")


def kind(path: Column) -> Column:
    return F.when(is_config(path), "config").when(suffix_of(path).isin(*SOURCE_LANGUAGES), "source").otherwise("unsupported")


def language(path: Column) -> Column:
    table = lambda values: F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    suffix = suffix_of(path)
    own = F.try_element_at(table(SOURCE_LANGUAGES), suffix)
    return F.when(is_config(path), F.coalesce(own, F.try_element_at(table(CONFIG_LANGUAGES), suffix))).otherwise(own)


def is_sensitive(path: Column) -> Column:
    name = F.lower(name_of(path))
    return name.isin(*SENSITIVE_NAMES) | name.rlike(SENSITIVE)


def is_excluded(path: Column) -> Column:
    """Below a directory that is never looked into."""
    parents = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    return F.exists(parents, lambda p: p.isin(*EXCLUDED_DIRS) | p.endswith(".egg-info"))


def matches_any(path: Column, patterns) -> Column:
    hit = F.lit(False)
    for p in patterns:
        regex = translate(p)
        hit = hit | path.rlike(f"^(?:{regex})") | name_of(path).rlike(f"^(?:{regex})")
    return hit


def classified(files: DataFrame, exclusions: tuple[str, ...] = (), ignored: DataFrame | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Files (path, content) with kind, language, status, reason, size_bytes and content_sha256. `ignored` has the paths
    (and a reason) that version control leaves out. The order of the reasons is part of the result."""
    path, data = F.col("path"), F.col("content")
    rows = files if ignored is None else files.join(ignored.select("path", F.col("reason").alias("_ignored")), "path", "left")
    ignored_reason = F.lit(None).cast("string") if ignored is None else F.col("_ignored")
    decoded = F.decode(data, "ISO-8859-1")
    secret = F.lit(False)
    for p in SECRET_MARKERS:
        secret = secret | decoded.rlike(p)
    reason = (
        F.when(is_excluded(path), "excluded_directory")
        .when(is_sensitive(path), "sensitive_filename")
        .when(ignored_reason.isNotNull(), ignored_reason)
        .when(matches_any(path, exclusions), "custom_exclusion")
        .when(kind(path) == "unsupported", "unsupported_file_type")
        .when(F.octet_length(data) > max_bytes, "too_large")
        .when(F.instr(F.decode(F.substring(data, 1, BINARY_PROBE), "ISO-8859-1"), "\0") > 0, "binary")
        .when(secret, "possible_embedded_secret")
        .otherwise("eligible")
    )
    rows = rows.withColumns({"kind": kind(path), "language": language(path), "reason": reason, "size_bytes": F.octet_length(data).cast("long")})
    status = (
        F.when(F.col("reason") == "eligible", "included")
        .when(F.col("reason") == "unsupported_file_type", "unsupported")
        .when(F.col("reason").isin("too_large", "binary", "possible_embedded_secret"), "skipped")
        .otherwise("ignored")
    )
    digest = F.when(F.col("reason") == "eligible", F.sha2(data, 256))
    return rows.withColumns({"status": status, "content_sha256": digest}).drop("_ignored")


def scan(spark: SparkSession, root: str, **options) -> DataFrame:
    """The inventory of a folder that Spark can read. Spark lists no files whose name begins with a dot or underscore."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    bare = re.sub("^[a-z][a-z0-9+.-]*:/+", "/", root.rstrip("/")) + "/"
    whole = F.regexp_replace("path", "^[a-z][a-z0-9+.-]*:/+", "/")
    inside = F.when(whole.startswith(bare), F.substring(whole, F.lit(len(bare) + 1), F.length(whole))).otherwise(whole)
    return classified(files.select(inside.alias("path"), "content"), **options)
