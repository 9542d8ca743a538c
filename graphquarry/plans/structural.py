"""Questions about the structure of code that name a single target, told by whole-message patterns, for many messages at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How such questions are put; <target> stands for the name.
PREFIX = r"\s*(?:please\s+)?(?:(?:show(?:\s+me)?|find|list|tell\s+me\s+about)\s+)?"
TARGET = r"""([`'"]?)([\p{L}_][\p{L}\p{N}_]*(?:(?:\.|::)[\p{L}_][\p{L}\p{N}_]*)*)\1"""
PATTERNS = (
    ("impact", r"what\s+(?:happens|breaks|is\s+affected)\s+(?:if\s+(?:I|we)\s+)?(?:change|modify|remove|delete)\s+<target>"),
    ("impact", r"(?:what\s+is\s+the\s+)?(?:change[ -])?impact\s+(?:of\s+)?(?:(?:changing|modifying|removing|deleting)\s+)?<target>"),
    ("impact", r"(?:affect(?:s|ed)?|break(?:s)?|chang(?:e|es|ing)|modif(?:y|ies|ying|ication))\s+(?:of\s+)?<target>"),
    ("callers", r"(?:what|which|who)\s+(?:(?:functions?|methods?|code)\s+)?(?:calls?|invokes?|uses?)\s+<target>"),
    ("callers", r"(?:what|which|who)\s+(?:depends?\s+on|relies?\s+on)\s+<target>"),
    ("callers", r"(?:callers?|upstream|dependencies)\s+(?:of\s+)?<target>"),
    ("callees", r"called\s+by\s+<target>"),
    ("callees", r"(?:what|which)\s+(?:does\s+|(?:functions?|methods?)\s+(?:does\s+)?)<target>\s+(?:call|invoke|use)"),
    ("callees", r"(?:callees?|downstream)\s+(?:of\s+)?<target>"),
    ("members", r"(?:members?|methods?|attributes?)\s+(?:of|in)\s+(?:class\s+)?<target>"),
    ("callers", r"how\s+is\s+<target>\s+(?:used|called|invoked)"),
    ("impact", r"(?:impact|effects?)\s+on\s+<target>"),
)
NO_TARGETS = "a an the if i we of on in to and or it this that these those them function method class code change changing modify modifying remove delete impact".split()


def detected(messages: DataFrame, nodes: DataFrame | None = None, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, kind, symbol of the messages that ask for callers, callees, members or impact of one name: the first pattern that is all
    of the message. An unquoted common word is no name, and ends the search. With nodes (id, name) a name must be one node's
    id, or one node's name, or else part of one node's id; others are left out."""
    text = F.col(text_col)
    shapes = [(kind, f"(?i)^{PREFIX}{p.replace('<target>', TARGET)}\\s*[?.!]?\\s*$") for kind, p in PATTERNS]
    which = F
    for k, (_, shape) in enumerate(shapes):
        which = which.when(text.rlike(shape), F.struct(F.lit(shapes[k][0]).alias("kind"), F.regexp_extract(text, shape, 1).alias("quote"), F.regexp_extract(text, shape, 2).alias("symbol")))
    rows = messages.select(F.col(id_col).alias("id"), F.when(~text.rlike(r"[\x00-\x1f\x7f]"), which).alias("m")).where("m IS NOT NULL")
    rows = rows.select("id", "m.kind", "m.symbol", "m.quote").where((F.col("quote") != "") | ~F.lower("symbol").isin(NO_TARGETS)).drop("quote")
    if nodes is None:
        return rows
    names = rows.select("symbol").distinct()
    exact = names.join(nodes.select(F.col("id").alias("symbol")), "symbol", "left_semi").withColumn("n", F.lit(1))
    named = names.join(exact, "symbol", "left_anti").join(nodes.select(F.col("name").alias("symbol")), "symbol").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    rest = F.broadcast(names.join(exact, "symbol", "left_anti").join(named, "symbol", "left_anti"))  # names of one batch of questions
    part = nodes.select("id").join(rest, F.contains("id", "symbol")).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    one = exact.unionByName(named).unionByName(part).where("n = 1").select("symbol")
    return rows.join(one, "symbol", "left_semi").select("id", "kind", "symbol")
