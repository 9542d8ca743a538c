"""Tables that come from or go to other programs: events of a type checker, graphs as JSON, documentation pages."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed schema of a type checker's events, one JSON object a line.
EVENTS = (
    "seq long, file string, kind string, startByte int, endByte int, line int, specifier string, expression string, exportedName string, relationship string, reason string, alias boolean, "
    "targetModule struct<file: string>, target struct<file: string, name: string, start: int, end: int>"
)
NODES = "id string, kind string, name string, path string, line int"
EDGES = "source string, target string, relationship string, path string, line int"


def semantic_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of imports, calls, constructions, references, exports and inheritance, with the schema that is agreed on; lines that
    aren't JSON are left out."""
    rows = spark.read.schema(EVENTS + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    rows = rows.where("_corrupt IS NULL").drop("_corrupt")
    return rows.withColumnsRenamed({"startByte": "start_byte", "endByte": "end_byte", "exportedName": "exported_name"})


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph as two folders of JSON lines."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/links")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a saved graph; empty ones if there is none. Broken lines are left out, and so are edges without ends."""

    def read(name: str, schema: str) -> DataFrame:
        try:
            return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(f"{path}/{name}")
        except AnalysisException:
            return spark.createDataFrame([], schema)

    return read("nodes", NODES).where("id IS NOT NULL"), read("links", EDGES).where("source IS NOT NULL AND target IS NOT NULL")


def store_pages(pages: DataFrame, path: str) -> DataFrame:
    """Write documentation pages (id, page, facts_hash), of one id the last by hash, and give what is stored."""
    pages.groupBy("id").agg(F.max(F.struct("facts_hash", "page")).alias("p")).select("id", "p.page", "p.facts_hash").write.mode("overwrite").parquet(path)
    return pages.sparkSession.read.parquet(path)
