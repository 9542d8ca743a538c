"""One object for a repository of sources: index it, search it, ask it. Transport, sessions and tokens are left to callers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphquarry.functions import identity
from graphquarry.functions import text as T
from graphquarry.operators import assembly, chunking, graph, provenance, snapshots
from graphquarry.plans import documentation, executor, retrieve, understanding
from graphquarry.sources import embedding, generations, inventory, python_ast

DIMENSIONS = 64


class Repository:
    """`root` is a folder of sources that Spark can read, `store` a folder for the generations of its index."""

    def __init__(self, spark: SparkSession, root: str, store: str, exclusions: tuple[str, ...] = ()):
        self.spark, self.root, self.exclusions = spark, root.rstrip("/"), exclusions
        self.id = root.rstrip("/").rsplit("/", 1)[-1]
        self.store = generations.Store(spark, store)

    def scan(self) -> DataFrame:
        """The inventory, with the hash of every file, so that a change of any file is seen."""
        return inventory.scan(self.spark, self.root, exclusions=self.exclusions).withColumn("content_sha256", F.sha2("content", 256))

    def sources(self, found: DataFrame) -> DataFrame:
        """Files worth indexing: those that the inventory takes, and other sources by extension; secrets are redacted."""
        rows = embedding.indexable(found.where("status IN ('included', 'unsupported')"))
        return rows.select("path", "content_sha256", F.coalesce("language", F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("language"), T.redact(F.decode("content", "UTF-8")).alias("text"))

    def index(self) -> tuple[str, bool]:
        """Publish a generation of the sources as they are; (generation, False) if nothing changed."""
        found = graph.cut(self.scan())
        digest = snapshots.observed_digest(found).first()["digest"]
        files = self.sources(found)
        chunks = chunking.chunked(files, self.id).withColumnRenamed("chunk_id", "id").join(files.select("path", "language"), "path")
        chunks = chunks.withColumns({"module": F.regexp_replace("path", r"\.[^./]*$", ""), "symbol_kind": F.col("kind"), "parent_symbol_key": F.col("qualified_name")})
        nodes = python_ast.nodes(files).select("id", "kind", "name", F.col("id").alias("qualified_name"), F.col("file").alias("path"), F.col("line").alias("start_line"))
        raw = python_ast.edges(files)
        modules = nodes.where("kind = 'module'")
        calls = graph.resolve_calls(raw.where("relationship = 'calls'").select("source", F.col("file"), F.col("target").alias("name"), "line"), nodes)  # a row for each call site
        known = nodes.select(F.col("id").alias("target"), F.lit(True).alias("known"))
        calls = calls.join(known, "target", "left").select("source", "target", F.lit("CALLS").alias("relationship"), F.when(F.col("known"), "resolved").otherwise("unresolved").alias("resolution"), "line")
        defines = raw.where("relationship = 'contains'").select("source", "target", F.lit("DEFINES").alias("relationship"), F.lit("resolved").alias("resolution"), "line")
        uses = graph.module_edges(raw.where("relationship IN ('imports', 'may_import')").select("source", "target", (F.col("relationship") == "imports").alias("sure"), "line"), modules)
        places = nodes.select(F.col("id").alias("source"), F.col("path").alias("evidence_file"))
        edges = calls.unionByName(defines).unionByName(uses).withColumnRenamed("line", "evidence_line").distinct().join(places, "source", "left")
        edges = edges.withColumn("id", identity.entity_id("rel", F.col("source"), F.col("target"), F.col("relationship"), F.col("evidence_file"), F.col("evidence_line").cast("string")))
        symbols = nodes.where("kind != 'module'").withColumns({"parameters": F.lit("[]"), "return_annotation": F.lit(None).cast("string"), "modifiers": F.lit("[]")})
        vectors = embedding.embedded(chunks, "id", "text", DIMENSIONS)
        tables = {"files": found.drop("content"), "chunks": chunks, "symbols": symbols, "modules": modules, "edges": edges, "vectors": vectors}
        return self.store.publish(tables, digest, audits=lambda t: {"chunk_of_file": (t["chunks"], t["files"], "path", "path"), "vector_of_chunk": (t["vectors"], t["chunks"], "id", "id")})

    def tables(self) -> dict[str, DataFrame]:
        return self.store.pinned()[1]

    def live_state(self) -> dict:
        """The active generation and how the sources differ from it."""
        generation, tables = self.store.pinned()
        return {"generation": generation} | provenance.freshness(tables["files"], self.scan()).first().asDict()

    def search(self, question: str, filters: dict | None = None, limit: int = 5) -> tuple[str, list[dict]]:
        tables = self.tables()
        route, rows = retrieve.retrieve(tables, question, filters, limit, embedding.embed_text(question, DIMENSIONS))
        return route, [r.asDict() for r in rows.limit(limit).collect()]  # at most `limit` rows

    def ask(self, question: str) -> dict:
        """Small talk is told apart; a question is planned and answered from one generation. If another was published meanwhile, the
        findings are discarded."""
        row = self.spark.range(1).select(understanding.chat_intent(F.lit(question)).alias("i")).first()
        if row["i"]:
            return {"intent": row["i"], "findings": []}
        generation, tables = self.store.pinned()
        answer = executor.Engine(tables).answer(question)
        return answer if self.store.unchanged(generation) else {"status": "stale_index", "findings": []}

    def file(self, path: str) -> dict:
        """The symbols of a file and the resolved edges that leave them."""
        tables = self.tables()
        nodes, edges = assembly.file_graph({"nodes": tables["symbols"], "edges": tables["edges"]}, path)
        return {"nodes": [r.asDict() for r in nodes.orderBy("start_line").limit(500).collect()], "edges": [r.asDict() for r in edges.orderBy("id").limit(500).collect()]}

    def documentation(self) -> DataFrame:
        tables = self.tables()
        return documentation.symbol_pages(tables["symbols"], tables["edges"].where("relationship = 'CALLS'"))
