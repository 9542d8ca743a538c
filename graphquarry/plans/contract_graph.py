"""Queries of assembly, provenance and answers over the given tables, and SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphquarry.functions import identity
from graphquarry.operators import answers, assembly, evidence, filters, graph, provenance, rules, search, snapshots

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ── a graph of parts (symbols), their brands (files) and line items (events) ──────────────────────────────────────

_FACTS = """
WITH symbols AS (
  SELECT 'p' || p_partkey AS id, 'src/' || p_brand || '/m' || p_partkey % 7 || '.js' AS path, p_name AS name,
    CASE p_size % 5 WHEN 0 THEN 'class' WHEN 1 THEN 'method' WHEN 2 THEN 'interface' WHEN 3 THEN 'enum' ELSE 'function' END AS kind,
    CASE WHEN p_partkey % 10 = 3 THEN 'p' || (p_partkey - 1) END AS parent, (p_partkey * 37) % 5000 AS a, (p_partkey * 37) % 5000 + 100 + p_size AS b FROM part
), files AS (SELECT DISTINCT path, path NOT LIKE '%/m6.js' AS parsed FROM symbols),
events AS (
  SELECT l_orderkey * 10 + l_linenumber AS seq, path AS file, CASE l_linenumber % 4 WHEN 0 THEN 'call' WHEN 1 THEN 'reference' WHEN 2 THEN 'construction' ELSE 'export' END AS kind,
    (l_orderkey * 13) % 5200 AS pos, CASE WHEN l_quantity < 10 THEN 'p' || l_partkey END AS scope, CASE WHEN l_returnflag <> 'R' THEN 'p' || l_suppkey * 3 END AS target, l_linestatus AS expression
  FROM lineitem JOIN symbols ON id = 'p' || l_partkey
), nodes AS (
  SELECT 'Repository:' || sha256('["repo", "repo"]') AS id, 'Repository' AS kind, 'repo' AS label, NULL AS path, NULL AS symbol_id
  UNION ALL SELECT 'Directory:' || sha256('["repo", "' || d || '"]'), 'Directory', regexp_extract(d, '[^/]*$'), d, NULL FROM (SELECT 'src' AS d UNION SELECT regexp_replace(path, '/[^/]*$', '') FROM files)
  UNION ALL SELECT 'File:' || sha256('["repo", "' || path || '"]'), 'File', regexp_extract(path, '[^/]*$'), path, NULL FROM files
  UNION ALL SELECT 'Module:' || sha256('["repo", "' || path || '"]'), 'Module', path, path, NULL FROM files WHERE parsed
  UNION ALL SELECT k || ':' || sha256('["repo", "' || id || '"]'), k, name, path, id
    FROM (SELECT s.*, CASE s.kind WHEN 'class' THEN 'Class' WHEN 'method' THEN 'Method' WHEN 'interface' THEN 'Interface' WHEN 'enum' THEN 'Type' ELSE 'Function' END AS k FROM symbols s JOIN files USING (path) WHERE parsed)
), bound AS (
  SELECT e.*, m.id AS module,
    CASE WHEN e.kind = 'export' THEN m.id ELSE coalesce(sc.id, ar.id, m.id) END AS source, t.id AS bound,
    CASE e.kind WHEN 'call' THEN 'CALLS' WHEN 'export' THEN 'EXPORTS' ELSE 'REFERENCES' END AS relationship
  FROM events e JOIN nodes m ON m.kind = 'Module' AND m.path = e.file
  LEFT JOIN nodes sc ON sc.symbol_id = e.scope LEFT JOIN nodes t ON t.symbol_id = e.target
  LEFT JOIN (SELECT file, pos, list(id ORDER BY b - a, id)[1] AS around FROM (SELECT DISTINCT file, pos FROM events) x JOIN symbols s ON s.path = file AND a <= pos AND pos < b GROUP BY 1, 2) i ON i.file = e.file AND i.pos = e.pos
  LEFT JOIN nodes ar ON ar.symbol_id = i.around
), made AS (
  SELECT source, bound AS target, relationship, file, pos, CASE WHEN kind = 'export' THEN 'semantic_export' ELSE 'semantic_reference' END AS evidence_type FROM bound WHERE bound IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY source, bound, relationship, file, pos ORDER BY seq DESC) = 1
), loose AS (
  SELECT source, relationship, CASE WHEN kind = 'export' THEN 'export_target_not_indexed' ELSE 'target_not_uniquely_indexed' END AS reason, file, pos, expression FROM bound WHERE bound IS NULL AND kind <> 'reference'
  QUALIFY row_number() OVER (PARTITION BY source, relationship, file, pos, kind = 'export' ORDER BY seq DESC) = 1
), shape AS (
  SELECT CASE WHEN contains(path, '/') THEN 'Directory:' || sha256('["repo", "' || regexp_replace(path, '/[^/]*$', '') || '"]') ELSE 'Repository:' || sha256('["repo", "repo"]') END AS source, id AS target, 'CONTAINS' AS relationship, path AS file, NULL::BIGINT AS pos, 'inventory' AS evidence_type FROM nodes WHERE kind IN ('Directory', 'File')
  UNION ALL SELECT 'File:' || sha256('["repo", "' || path || '"]'), id, 'DEFINES', path, NULL, 'inventory' FROM nodes WHERE kind = 'Module'
  UNION ALL SELECT coalesce(o.id, 'Module:' || sha256('["repo", "' || n.path || '"]')), n.id, 'DEFINES', n.path, s.a, 'syntax_definition' FROM nodes n JOIN symbols s ON s.id = n.symbol_id LEFT JOIN nodes o ON o.symbol_id = s.parent WHERE s.parent IS NULL OR o.id IS NOT NULL
), edges AS (
  SELECT 'rel:' || sha256('["' || source || '", "' || target || '", "' || relationship || '", "' || file || '", "' || coalesce(pos::VARCHAR, 'None') || '"]') AS id, *, 'resolved' AS resolution FROM (SELECT * FROM shape UNION ALL SELECT * FROM made)
)"""


def _facts(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    part, items = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    path = F.concat(F.lit("src/"), "p_brand", F.lit("/m"), (F.col("p_partkey") % 7).cast("string"), F.lit(".js"))
    key = lambda c: F.concat(F.lit("p"), c.cast("string"))
    k = F.col("p_size") % 5
    kind = F.when(k == 0, "class").when(k == 1, "method").when(k == 2, "interface").when(k == 3, "enum").otherwise("function")
    start = ((F.col("p_partkey") * 37) % 5000).cast("int")
    symbols = part.select(
        key(F.col("p_partkey")).alias("id"), path.alias("path"), F.col("p_name").alias("name"), F.col("p_name").alias("qualified_name"), kind.alias("kind"),
        F.when(F.col("p_partkey") % 10 == 3, key(F.col("p_partkey") - 1)).alias("parent_symbol_id"), start.alias("start_byte"), (start + 100 + F.col("p_size")).alias("end_byte"), (F.floor(start / 40) + 1).cast("int").alias("start_line"),
    )
    files = symbols.select("path").distinct().withColumn("parsed", ~F.col("path").endswith("/m6.js"))
    n = F.col("l_linenumber") % 4
    at = ((F.col("l_orderkey") * 13) % 5200).cast("int")
    events = items.join(graph.if_small(part.select(F.col("p_partkey").alias("l_partkey"), path.alias("file"))), "l_partkey").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), "file", F.when(n == 0, "call").when(n == 1, "reference").when(n == 2, "construction").otherwise("export").alias("kind"),
        at.alias("start_byte"), (at + 5).alias("end_byte"), (F.floor(at / 40) + 1).cast("int").alias("line"),
        F.when(F.col("l_quantity") < 10, key(F.col("l_partkey"))).alias("scope_symbol_id"), F.when(F.col("l_returnflag") != "R", key(F.col("l_suppkey") * 3)).alias("target_symbol_id"), F.col("l_linestatus").alias("expression"),
    )
    return files, symbols, events


def _built(spark, sf_dir) -> dict[str, DataFrame]:
    files, symbols, events = _facts(spark, sf_dir)
    return assembly.build(files, symbols, graph.cut(events), "repo")  # events are read several times


@query("assembled_nodes", _FACTS + " SELECT id, kind, label, path, symbol_id FROM nodes")
def assembled_nodes(spark, sf_dir):
    files, symbols, _ = _facts(spark, sf_dir)
    return assembly.nodes(files, symbols, "repo")


@query("assembled_edges", _FACTS + " SELECT id, source, target, relationship, resolution, evidence_type, file AS evidence_file, coalesce(pos, -1)::INTEGER AS start_byte FROM edges")
def assembled_edges(spark, sf_dir):
    return _built(spark, sf_dir)["edges"].select("id", "source", "target", "relationship", "resolution", "evidence_type", "evidence_file", F.coalesce("start_byte", F.lit(-1)).alias("start_byte"))


@query("unresolved_references", _FACTS + " SELECT source, relationship, reason, file AS evidence_file, pos::INTEGER AS start_byte FROM loose")
def unresolved_references(spark, sf_dir):
    return _built(spark, sf_dir)["unresolved"].select("source", "relationship", "reason", "evidence_file", "start_byte")


@query("described_edges", _FACTS + " SELECT a.kind AS source_kind, b.kind AS target_kind, s.kind AS target_syntax, relationship, count(*) AS n, min(b.label) AS least FROM edges e JOIN nodes a ON a.id = source JOIN nodes b ON b.id = target LEFT JOIN symbols s ON s.id = b.symbol_id GROUP BY ALL")
def described_edges(spark, sf_dir):
    files, symbols, events = _facts(spark, sf_dir)
    made = assembly.build(files, symbols, graph.cut(events), "repo")
    rows = assembly.described(made["edges"], made["nodes"], symbols, sides=("target",))
    return rows.groupBy("source_kind", "target_kind", "target_syntax", "relationship").agg(F.count(F.lit(1)).alias("n"), F.min("target_label").alias("least"))


# ── all relationships from one table of events: descriptors of targets and classes, imports, what a resolver gave up ──

_WHOLE = _FACTS.split(", files AS (")[0].replace("p_name AS name", "CASE WHEN p_partkey % 13 = 0 THEN '<anonymous ' || p_partkey || '>' ELSE p_name END AS name") + """,
files AS (SELECT DISTINCT path, path NOT LIKE '%/m6.js' AS parsed FROM symbols),
events AS (
  SELECT ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey % 100000) * 1000 + l_suppkey % 1000 AS seq, s.path AS file, ['unresolved', 'call', 'reference', 'construction', 'export', 'import', 'inheritance'][l_linenumber % 7 + 1] AS kind,
    (l_orderkey * 13) % 5200 AS pos, l_linestatus AS expression, 'x' || l_suppkey AS exported, 'gave up ' || l_linestatus AS reason,
    CASE WHEN l_linenumber = 6 THEN CASE WHEN l_orderkey % 2 = 0 THEN 'EXTENDS' ELSE 'IMPLEMENTS' END WHEN l_linenumber = 7 THEN 'CALLS' END AS said,
    t.path AS t_file, CASE WHEN t.id IS NULL THEN NULL WHEN t.name LIKE '<anonymous%' THEN 'default' WHEN l_orderkey % 11 = 0 THEN 'absent' ELSE t.name END AS t_name,
    t.a + [0, -5, 10][l_orderkey % 3 + 1] + CASE WHEN l_orderkey % 17 = 0 THEN 3000 ELSE 0 END AS t_from, t.b + [0, 5, -10][l_orderkey % 3 + 1] + CASE WHEN l_orderkey % 17 = 0 THEN 3000 ELSE 0 END AS t_to,
    s.path AS s_file, CASE WHEN s.name LIKE '<anonymous%' THEN '__function' ELSE s.name END AS s_name, s.a AS s_from, s.b AS s_to,
    ['./m', 'pkg' || l_suppkey % 5, '@app/x', 'lib' || l_suppkey % 3][l_orderkey % 4 + 1] AS specifier, CASE WHEN l_orderkey % 2 = 0 THEN t.path END AS module_file,
    CASE WHEN l_quantity < 10 THEN s.id END AS ref_scope
  FROM lineitem JOIN symbols s ON s.id = 'p' || l_partkey LEFT JOIN symbols t ON l_returnflag <> 'R' AND t.id = 'p' || l_suppkey * 3
), refs AS (
  SELECT file, kind, pos, max({'line': pos // 40 + 2, 'scope': ref_scope}) AS r FROM events WHERE ref_scope IS NOT NULL AND kind IN ('call', 'construction', 'inheritance') GROUP BY ALL
), module_nodes AS (SELECT path, 'Module:' || sha256('["repo", "' || path || '"]') AS id FROM files WHERE parsed),
symbol_nodes AS (
  SELECT s.id AS symbol_id, CASE s.kind WHEN 'class' THEN 'Class' WHEN 'method' THEN 'Method' WHEN 'interface' THEN 'Interface' WHEN 'enum' THEN 'Type' ELSE 'Function' END || ':' || sha256('["repo", "' || s.id || '"]') AS id
  FROM symbols s JOIN files USING (path) WHERE parsed
), asked AS (SELECT DISTINCT t_file AS f, t_name AS n, t_from AS a, t_to AS b FROM events WHERE t_file IS NOT NULL UNION SELECT DISTINCT s_file, s_name, s_from, s_to FROM events),
answered AS (
  SELECT f, n, q.a, q.b, list(s.id ORDER BY abs(s.a - q.a) + abs(s.b - q.b), s.b - s.a, s.id)[1] AS symbol_id FROM asked q JOIN symbols s ON s.path = f
  WHERE ((s.a <= q.a AND q.b <= s.b) OR (q.a <= s.a AND s.b <= q.b)) AND (s.name = n OR n IN ('default', '__function') AND s.name LIKE '<anonymous%') GROUP BY ALL
), held AS (SELECT file, pos, list(id ORDER BY b - a, id)[1] AS around FROM (SELECT DISTINCT file, pos FROM events) x JOIN symbols s ON s.path = file AND a <= pos AND pos < b GROUP BY 1, 2),
bound AS (
  SELECT e.*, m.id AS module, i.id AS imported, t.id AS target, coalesce(r.r.line, e.pos // 40 + 1) AS line,
    CASE WHEN e.kind IN ('import', 'export') THEN m.id WHEN e.kind = 'inheritance' THEN coalesce(d.id, m.id) ELSE coalesce(sc.id, ar.id, m.id) END AS source,
    CASE e.kind WHEN 'call' THEN 'CALLS' WHEN 'export' THEN 'EXPORTS' WHEN 'import' THEN 'IMPORTS' WHEN 'construction' THEN 'REFERENCES' WHEN 'reference' THEN 'REFERENCES' ELSE said END AS relationship,
    CASE WHEN e.kind = 'import' AND i.id IS NULL AND NOT regexp_matches(specifier, '^[./]') AND NOT starts_with(specifier, '@app') THEN 'ExternalDependency:' || sha256('["repo", "' || specifier || '"]') END AS package
  FROM events e JOIN module_nodes m ON m.path = e.file LEFT JOIN module_nodes i ON i.path = e.module_file AND e.kind = 'import'
  LEFT JOIN refs r ON r.file = e.file AND r.kind = e.kind AND r.pos = e.pos
  LEFT JOIN answered x ON x.f = t_file AND x.n = t_name AND x.a = t_from AND x.b = t_to LEFT JOIN symbol_nodes t ON t.symbol_id = x.symbol_id
  LEFT JOIN answered y ON y.f = s_file AND y.n = s_name AND y.a = s_from AND y.b = s_to LEFT JOIN symbol_nodes d ON d.symbol_id = y.symbol_id
  LEFT JOIN symbol_nodes sc ON sc.symbol_id = r.r.scope LEFT JOIN held h ON h.file = e.file AND h.pos = e.pos LEFT JOIN symbol_nodes ar ON ar.symbol_id = h.around
), ended AS (SELECT *, CASE WHEN kind = 'import' THEN coalesce(imported, package) WHEN kind <> 'unresolved' THEN target END AS goal FROM bound),
several AS (
  SELECT seq, file, pos, line, source, goal, relationship, kind, CASE WHEN kind = 'import' THEN CASE WHEN imported IS NULL THEN 'package_specifier' ELSE 'semantic_module_resolution' END WHEN kind = 'export' THEN 'semantic_export' ELSE 'semantic_reference' END AS proof FROM ended WHERE goal IS NOT NULL
  UNION ALL SELECT seq, file, pos, line, source, goal, 'DEPENDS_ON', kind, 'derived_import' FROM ended WHERE kind = 'import' AND imported IS NOT NULL
)"""


def _whole_facts(spark, sf_dir):
    """Files, symbols, events and syntactic references, with events of every kind."""
    files, symbols, _ = _facts(spark, sf_dir)
    key = F.regexp_extract("id", "[0-9]+", 0)
    symbols = symbols.withColumn("name", F.when(key.cast("long") % 13 == 0, F.concat(F.lit("<anonymous "), key, F.lit(">"))).otherwise(F.col("name"))).withColumn("qualified_name", F.col("name"))
    own = symbols.select(key.cast("long").alias("l_partkey"), F.col("path").alias("file"), F.col("name").alias("s_name"), F.col("start_byte").alias("source_start"), F.col("end_byte").alias("source_end"))
    goal = symbols.select(key.cast("long").alias("t_id"), F.col("path").alias("target_file"), F.col("name").alias("t_name"), F.col("start_byte").alias("t_a"), F.col("end_byte").alias("t_b"))
    named = lambda k: F.concat(F.lit("p"), k.cast("string"))
    items = table(spark, sf_dir, "lineitem").withColumn("t_id", F.when(F.col("l_returnflag") != "R", F.col("l_suppkey") * 3))
    items = graph.looked_up(items, goal, ["t_id"]).join(graph.if_small(own), "l_partkey").withColumn("s_id", named(F.col("l_partkey")))
    k, o = F.col("l_linenumber"), F.col("l_orderkey")
    pick = lambda column, values: F.element_at(F.array(*(v if not isinstance(v, (str, int)) else F.lit(v) for v in values)), (column % len(values) + 1).cast("int"))
    shift = F.when(o % 17 == 0, 3000).otherwise(0)
    anonymous = lambda c: F.col(c).startswith("<anonymous")
    at = ((o * 13) % 5200).cast("int")
    specifier = pick(o, ["./m", F.concat(F.lit("pkg"), (F.col("l_suppkey") % 5).cast("string")), "@app/x", F.concat(F.lit("lib"), (F.col("l_suppkey") % 3).cast("string"))])
    events = items.select(
        (((o * 10 + k) * 100_000 + F.col("l_partkey") % 100_000) * 1000 + F.col("l_suppkey") % 1000).alias("seq"), "file", pick(k, ["unresolved", "call", "reference", "construction", "export", "import", "inheritance"]).alias("kind"), at.alias("start_byte"), (at + 5).alias("end_byte"), (F.floor(at / 40) + 1).cast("int").alias("line"),
        F.col("l_linestatus").alias("expression"), F.concat(F.lit("x"), F.col("l_suppkey").cast("string")).alias("exported_name"), F.concat(F.lit("gave up "), "l_linestatus").alias("reason"),
        F.when(k == 6, F.when(o % 2 == 0, "EXTENDS").otherwise("IMPLEMENTS")).when(k == 7, "CALLS").alias("relationship"),
        "target_file", F.when(anonymous("t_name"), "default").when(F.col("t_id").isNotNull() & F.col("t_name").isNotNull() & (o % 11 == 0), "absent").otherwise(F.col("t_name")).alias("target_name"),
        (F.col("t_a") + pick(o, [0, -5, 10]) + shift).alias("target_start"), (F.col("t_b") + pick(o, [0, 5, -10]) + shift).alias("target_end"),
        F.col("file").alias("source_file"), F.when(anonymous("s_name"), "__function").otherwise(F.col("s_name")).alias("source_name"), "source_start", "source_end",
        specifier.alias("specifier"), specifier.startswith("@app").alias("alias"), F.when(o % 2 == 0, F.col("target_file")).alias("module_file"), F.when(F.col("l_quantity") < 10, F.col("s_id")).alias("_scope"),
    )
    events = graph.cut(events)
    references = events.where("_scope IS NOT NULL").select(F.col("file").alias("path"), "kind", "start_byte", (F.floor(F.col("start_byte") / 40) + 2).cast("int").alias("start_line"), (F.col("start_byte") % 40).alias("start_column"), F.col("_scope").alias("scope_symbol_id"))
    return files, symbols, events.drop("_scope"), references


def _whole(spark, sf_dir) -> dict[str, DataFrame]:
    files, symbols, events, references = _whole_facts(spark, sf_dir)
    return assembly.build(files, symbols, events, "repo", references)


@query("event_edges", _WHOLE + """ SELECT 'rel:' || sha256('["' || source || '", "' || goal || '", "' || relationship || '", "' || file || '", "' || pos || '"]') AS id, source, goal AS target, relationship,
  CASE WHEN proof = 'package_specifier' THEN 'inferred' ELSE 'resolved' END AS resolution, proof AS evidence_type, file AS evidence_file, line::INTEGER AS evidence_line, pos::INTEGER AS start_byte FROM several
  QUALIFY row_number() OVER (PARTITION BY source, goal, relationship, file, pos ORDER BY seq DESC) = 1""")
def event_edges(spark, sf_dir):
    """Edges of events of every kind: calls, references, exports, imports, dependencies, inheritance."""
    made = _whole(spark, sf_dir)["edges"].where("evidence_type NOT IN ('inventory', 'syntax_definition')")
    return made.select("id", "source", "target", "relationship", "resolution", "evidence_type", "evidence_file", "evidence_line", "start_byte")


@query("event_unresolved", _WHOLE + """, loose AS (
  SELECT *, CASE kind WHEN 'import' THEN 'local_module_not_indexed_or_missing' WHEN 'export' THEN 'export_target_not_indexed' WHEN 'unresolved' THEN reason ELSE 'target_not_uniquely_indexed' END AS why,
    CASE kind WHEN 'import' THEN specifier WHEN 'export' THEN exported ELSE expression END AS text FROM ended WHERE goal IS NULL AND kind <> 'reference')
SELECT 'unresolved:' || sha256('["' || source || '", "' || relationship || '", "' || file || '", "' || pos || '", "' || why || '"]') AS id, source, relationship, text AS expression, why AS reason, file AS evidence_file, line::INTEGER AS evidence_line, pos::INTEGER AS start_byte FROM loose
  QUALIFY row_number() OVER (PARTITION BY source, relationship, file, pos, why ORDER BY seq DESC) = 1""")
def event_unresolved(spark, sf_dir):
    """What events leave unresolved, each with its reason."""
    return _whole(spark, sf_dir)["unresolved"].select("id", "source", "relationship", "expression", "reason", "evidence_file", "evidence_line", "start_byte")


@query("external_dependencies", _WHOLE + " SELECT package AS id, specifier AS label, count(DISTINCT source) AS importers FROM ended WHERE package IS NOT NULL GROUP BY ALL")
def external_dependencies(spark, sf_dir):
    """Packages that are imported by name, and how many modules do so."""
    made = _whole(spark, sf_dir)
    uses = made["edges"].where("resolution = 'inferred'").groupBy(F.col("target").alias("id")).agg(F.count_distinct("source").alias("importers"))
    return made["nodes"].where("kind = 'ExternalDependency'").join(uses, "id").select("id", "label", "importers")


@query("edges_in_order", _FACTS + " SELECT file AS evidence_file, pos::INTEGER AS start_byte, b.label AS target_label FROM edges JOIN nodes b ON b.id = target WHERE relationship = 'CALLS' ORDER BY file NULLS FIRST, pos NULLS FIRST, b.label, edges.id LIMIT 50")
def edges_in_order(spark, sf_dir):
    made = _built(spark, sf_dir)
    rows = assembly.described(made["edges"].where("relationship = 'CALLS'"), made["nodes"], sides=("target",)).withColumn("evidence_line", F.col("start_byte"))
    keys = rows.select("evidence_file", "evidence_line", "start_byte", F.concat_ws("|", "target_label", "id").alias("label"), "target_label")
    return answers.in_order(keys, "label").limit(50).select("evidence_file", "start_byte", "target_label")


_ONE = "(SELECT min(path) FROM files WHERE parsed)"


@query("file_graph", _FACTS + f" SELECT id, relationship FROM edges WHERE source IN (SELECT id FROM nodes WHERE path = {_ONE}) UNION ALL SELECT id, 'NODE' FROM nodes WHERE path = {_ONE}")
def file_graph(spark, sf_dir):
    made = _built(spark, sf_dir)
    first = made["nodes"].where("kind = 'Module'").agg(F.min("path")).first()[0]
    own, out = assembly.file_graph(made, first)
    return out.select("id", "relationship").unionByName(own.select("id", F.lit("NODE").alias("relationship")))


@query("updated_files", _FACTS + """, gone AS (SELECT id FROM nodes WHERE path LIKE '%/m2.js')
SELECT relationship, count(*) AS n, min(id) AS first FROM edges WHERE source NOT IN (SELECT id FROM gone) AND target NOT IN (SELECT id FROM gone) GROUP BY 1""")
def updated_files(spark, sf_dir):
    made = _built(spark, sf_dir)
    gone = made["nodes"].where("path LIKE '%/m2.js'").select("path").distinct()
    return assembly.without_files(made, gone)["edges"].groupBy("relationship").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


_OPS = """, named AS (SELECT id FROM nodes WHERE symbol_id IN ('p3', 'p6', 'p9', 'p12') OR (kind = 'Module' AND path LIKE '%/m1.js'))
SELECT 'find_callers' AS operation, id FROM edges WHERE relationship = 'CALLS' AND target IN (SELECT id FROM named)
UNION ALL SELECT 'find_callees', id FROM edges WHERE relationship = 'CALLS' AND source IN (SELECT id FROM named)
UNION ALL SELECT 'find_references', id FROM edges WHERE relationship IN ('CALLS', 'REFERENCES') AND target IN (SELECT id FROM named)
UNION ALL SELECT 'find_imports', id FROM edges WHERE relationship = 'IMPORTS' AND source IN (SELECT id FROM named)
UNION ALL SELECT 'find_importers', id FROM edges WHERE relationship = 'IMPORTS' AND target IN (SELECT id FROM named)
UNION ALL SELECT 'find_dependencies', id FROM edges WHERE relationship = 'DEPENDS_ON' AND source IN (SELECT id FROM named)
UNION ALL SELECT 'find_reverse_dependencies', id FROM edges WHERE relationship = 'DEPENDS_ON' AND target IN (SELECT id FROM named)"""


@query("typed_operations", _FACTS.replace("SELECT source, bound AS target, relationship, file", "SELECT source, bound AS target, CASE relationship WHEN 'EXPORTS' THEN 'IMPORTS' ELSE relationship END AS relationship, file") + _OPS)
def typed_operations(spark, sf_dir):
    """All operations by name; exports stand for imports, so that every kind of edge occurs."""
    made = _built(spark, sf_dir)
    edges, nodes = made["edges"], made["nodes"]
    named = nodes.where("symbol_id IN ('p3', 'p6', 'p9', 'p12') OR (kind = 'Module' AND path LIKE '%/m1.js')").select("id")
    kind = F.when(F.col("relationship") == "EXPORTS", "IMPORTS").otherwise(F.col("relationship"))
    changed = graph.cut(graph.at(edges, named)).withColumn("relationship", kind)  # one pass for all operations
    place = F.coalesce(F.col("start_byte").cast("string"), F.lit("None"))
    changed = changed.withColumn("id", identity.entity_id("rel", F.col("source"), F.col("target"), F.col("relationship"), F.coalesce("evidence_file", F.lit("")), place))
    out = None
    for name, find in graph.OPERATIONS.items():
        one = find(changed, named).select(F.lit(name).alias("operation"), "id")
        out = one if out is None else out.unionByName(one)
    return out


@query("resolve_names", "WITH w AS (SELECT DISTINCT p_name AS name FROM part WHERE p_partkey % 3 = 0 UNION SELECT 'nothing'), c AS (SELECT name, count(p_partkey) AS n, list_sort(list('p' || p_partkey ORDER BY 'p' || p_partkey) FILTER (p_partkey IS NOT NULL))[1:25] AS l FROM w LEFT JOIN part ON p_name = name GROUP BY 1) SELECT name, CASE n WHEN 0 THEN 'not_found' WHEN 1 THEN 'success' ELSE 'ambiguous' END AS status, coalesce(array_to_string(l, ','), '') AS candidates FROM c")
def resolve_names(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    symbols = part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"), F.concat(F.lit("x."), "p_name").alias("qualified_name"))
    wanted = part.where("p_partkey % 3 = 0").select(F.col("p_name").alias("name")).unionByName(spark.range(1).select(F.lit("nothing").alias("name")))
    return graph.resolve_names(wanted, symbols).select("name", "status", F.array_join("candidates", ",").alias("candidates"))


_SITES = "WITH edges AS (SELECT 's' || l_suppkey AS source, 'p' || l_partkey AS target, l_shipdate::DATE::VARCHAR AS file, l_linenumber AS line, l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_returnflag = 'R' THEN 'unresolved' ELSE 'resolved' END AS resolution FROM lineitem)"


def _sites(spark, sf_dir) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    return items.select(name("s", "l_suppkey").alias("source"), name("p", "l_partkey").alias("target"), F.col("l_shipdate").cast("date").cast("string").alias("evidence_file"), F.col("l_linenumber").alias("evidence_line"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.lit("CALLS").alias("relationship"), F.when(F.col("l_returnflag") == "R", "unresolved").otherwise("resolved").alias("resolution"))


@query("caller_groups", _SITES + " SELECT target, source, string_agg(site, ';' ORDER BY file, line) AS sites FROM (SELECT DISTINCT target, source, file, line, file || ':' || line AS site FROM edges) GROUP BY ALL")
def caller_groups(spark, sf_dir):
    rows = answers.caller_groups(_sites(spark, sf_dir))
    return rows.select("target", "source", F.array_join(F.transform("sites", lambda s: F.concat_ws(":", s["evidence_file"], s["evidence_line"].cast("string"))), ";").alias("sites"))


@query("neighbours_once", _SITES + " SELECT target AS id, source AS neighbour FROM (SELECT DISTINCT target, source FROM edges) QUALIFY row_number() OVER (PARTITION BY target ORDER BY source) <= 500")
def neighbours_once(spark, sf_dir):
    return answers.neighbours(_sites(spark, sf_dir), None, "CALLS", reverse=True)


@query("expanded_callees", _SITES + """, hits AS (SELECT 's' || s_suppkey AS id, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS position FROM supplier QUALIFY position <= 20),
c AS (SELECT DISTINCT source, target, position FROM edges JOIN hits ON hits.id = source WHERE position <= 3 AND resolution = 'resolved'),
n AS (SELECT target, position, row_number() OVER (PARTITION BY source ORDER BY target) AS n FROM c QUALIFY n <= 10),
f AS (SELECT target AS id, min(position * 100 + n) AS pos FROM n GROUP BY 1)
SELECT id, row_number() OVER (ORDER BY pos, id) AS position FROM f""")
def expanded_callees(spark, sf_dir):
    sup = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), "s_acctbal", "s_suppkey")
    hits = search.ranked(sup, F.desc("s_acctbal"), "s_suppkey", most=20).select("id", "position")
    return answers.expanded(hits, _sites(spark, sf_dir))


@query("examined_edges", _SITES + """, few AS (SELECT * FROM edges WHERE target IN ('p1', 'p2', 'p3', 'p4', 'p5') ORDER BY resolution <> 'resolved', file, line, id LIMIT 100)
SELECT source, id FROM few QUALIFY row_number() OVER (PARTITION BY source ORDER BY resolution <> 'resolved', file, line, id) = 1""")
def examined_edges(spark, sf_dir):
    frontier = spark.createDataFrame([(f"p{k}",) for k in range(1, 6)], "id string")
    return answers.examined(_sites(spark, sf_dir), frontier).select("source", "id")


@query("file_listing", "SELECT p_brand AS path, string_agg(p_size || ':' || p_name, ';' ORDER BY p_size, p_name) AS symbols FROM part GROUP BY 1")
def file_listing(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("path"), F.col("p_size").alias("start_line"), F.col("p_name").alias("name"))
    return answers.file_listing(rows).select("path", F.array_join(F.transform("symbols", lambda s: F.concat_ws(":", s["start_line"].cast("string"), s["name"])), ";").alias("symbols"))


@query("conversational_order", "WITH h AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank, round(1 - 0.01 * (row_number() OVER (ORDER BY n_chars DESC, doc_id) // 4), 4) AS score, CASE doc_id % 3 WHEN 0 THEN 'docs/a.md' WHEN 1 THEN 'src/a.js' ELSE 'tests/a.js' END AS path FROM documents QUALIFY rank <= 60) SELECT doc_id, round(score - CASE WHEN path = 'src/a.js' THEN 0 ELSE 0.15 END, 4) AS score FROM h ORDER BY 2 DESC, rank LIMIT 30")
def conversational_order(spark, sf_dir):
    k = F.col("doc_id") % 3
    docs = search.ranked(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), F.desc("n_chars"), "doc_id", most=60).withColumnRenamed("position", "rank")
    hits = docs.withColumns({"score": F.round(1 - 0.01 * F.floor(F.col("rank") / 4), 4), "path": F.when(k == 0, "docs/a.md").when(k == 1, "src/a.js").otherwise("tests/a.js"), "name": F.lit("a")})
    return answers.conversational(hits.withColumn("score", F.round("score", 4))).limit(30).select("doc_id", F.round("score", 4).alias("score"))


@query("fences", "SELECT doc_id, repeat('`', greatest(3, coalesce(list_max(list_transform(regexp_extract_all(t, '`+'), lambda x: length(x))), 0) + 1)) AS fence FROM (SELECT doc_id, coalesce(text, '') || repeat('`', (doc_id % 6)::INTEGER) AS t FROM documents)")
def fences(spark, sf_dir):
    ticks = F.repeat(F.lit("`"), (F.col("doc_id") % 6).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", answers.fence(F.concat(F.coalesce("text", F.lit("")), ticks)).alias("fence"))


@query("without_citations", "SELECT conv_id, turn, md5(trim(text || ' and `x[2]` stays')) AS digest FROM conversations")
def without_citations(spark, sf_dir):
    marked = F.concat("text", F.lit(" [1]and `x[2]`[ 3, 4 ] stays [5;6]"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(answers.without_citations(marked)).alias("digest"))


# ── provenance and what answers are made of, over documents as files ──────────────────────────────────────────────

_DOCS = """
WITH d AS (SELECT doc_id, source || '/' || doc_id || '.md' AS path, text, regexp_replace(text, '\n$', '') AS body, sha256(text) AS hash, len(string_split(regexp_replace(text, '\n$', ''), chr(10))) AS n_lines, strlen(text) AS n_bytes FROM documents WHERE text IS NOT NULL AND text <> '')"""


def _files(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL AND text != ''").dropDuplicates(["doc_id"])
    return docs.select("doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("file_id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").cast("binary").alias("content"), F.sha2("text", 256).alias("hash"))


@query(
    "trace",
    _DOCS + """, c AS (SELECT 'c' || doc_id AS id, 'chunk' AS kind, path, 1 AS s, n_lines + (doc_id % 5 = 0)::INTEGER AS e, CASE WHEN doc_id % 11 = 0 THEN 'not_ready' WHEN doc_id % 7 = 0 THEN 'changed' WHEN doc_id % 5 = 0 THEN 'invalid_location' ELSE 'ok' END AS status FROM d),
y AS (SELECT 's' || doc_id AS id, 'symbol' AS kind, path, 1 + (doc_id % 3 = 0)::INTEGER AS s, NULL::INTEGER AS e,
  CASE WHEN doc_id % 11 = 0 THEN 'not_ready' WHEN 1 + (doc_id % 3 = 0)::INTEGER > n_lines OR n_bytes < 9 THEN 'invalid_location' WHEN doc_id % 3 = 0 THEN 'lines_disagree' ELSE 'ok' END AS status FROM d)
SELECT id, kind, path, s::INTEGER AS start_line, e::INTEGER AS end_line, status FROM c
UNION ALL SELECT id, kind, path, s, s, status FROM y
UNION ALL SELECT 'n' || doc_id, 'node', NULL, 1, -1, 'structural' FROM d WHERE doc_id % 11 <> 0
UNION ALL SELECT 'n' || doc_id, 'node', NULL, 1, -1, 'not_ready' FROM d WHERE doc_id % 11 = 0
UNION ALL SELECT 'z' || doc_id, NULL, NULL, 1, -1, 'missing' FROM d""",
)
def trace(spark, sf_dir):
    files = _files(spark, sf_dir)
    key = lambda letter: F.concat(F.lit(letter), F.col("doc_id").cast("string")).alias("id")
    snapshot = F.when(F.col("doc_id") % 11 == 0, "old").otherwise("new").alias("snapshot_id")
    n_lines = F.size(F.split(F.regexp_replace(F.decode("content", "UTF-8"), "\n$", ""), "\n", -1))
    chunks = files.select(key("c"), snapshot, "file_id", F.when(F.col("doc_id") % 7 == 0, "gone").otherwise(F.col("hash")).alias("source_hash"), F.lit(1).alias("start_line"), (n_lines + (F.col("doc_id") % 5 == 0).cast("int")).alias("end_line"))
    symbols = files.select(key("s"), snapshot, "file_id", F.col("hash").alias("source_hash"), (1 + (F.col("doc_id") % 3 == 0).cast("int")).alias("start_line"), F.lit(0).alias("start_byte"), F.lit(9).alias("end_byte"))
    nodes = files.select(key("n"), snapshot)
    entities = {"chunk": chunks, "symbol": symbols, "relationship": nodes.where("false"), "node": nodes.unionByName(chunks.select("id", "snapshot_id"))}
    ids = files.select(F.explode(F.array(*(F.concat(F.lit(x), F.col("doc_id").cast("string")) for x in "csnz"))).alias("id"))
    snapshots_ = spark.createDataFrame([("new", "ready"), ("old", "building")], "id string, state string")
    return provenance.trace(ids, entities, snapshots_, files).select("id", "kind", "path", "start_line", F.coalesce("end_line", F.lit(-1)).alias("end_line"), "status")


@query("payloads_valid", _DOCS + " SELECT doc_id, doc_id % 4 <> 1 AND doc_id % 6 <> 2 AND doc_id % 9 <> 4 AS valid FROM d")
def payloads_valid(spark, sf_dir):
    files = _files(spark, sf_dir)
    k = F.col("doc_id")
    none = F.lit(None).cast("string")
    chunk = files.select("doc_id", F.col("doc_id").cast("string").alias("id"), "path", F.col("hash").alias("source_hash"), F.lit("s1").alias("snapshot_id"), "file_id", none.alias("symbol_id"), F.lit(0).alias("chunk_index"), F.col("hash").alias("content_hash"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), F.when(k % 2 == 0, "md").alias("language"))
    payload = files.select("doc_id", F.col("doc_id").cast("string").alias("chunk_id"), F.col("path").alias("file_path"), F.col("hash").alias("file_hash"), F.when(k % 4 == 1, "s0").otherwise("s1").alias("snapshot_id"), "file_id", none.alias("symbol_id"), F.lit(0).alias("chunk_index"), F.col("hash").alias("content_hash"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), F.when(k % 6 == 2, "txt").when(k % 2 == 0, "md").alias("language"), F.concat(F.decode("content", "UTF-8"), F.when(k % 9 == 4, "!").otherwise("")).alias("code_snippet"))
    return chunk.alias("c").join(payload.alias("p"), "doc_id").select("doc_id", provenance.payload_valid("c", "p", ("language",)).alias("valid"))


@query("index_health", "SELECT count(DISTINCT lang) AS collections, count(DISTINCT source) AS models, count(*) FILTER (doc_id % 4 = 0) AS unready, 'stale' AS status FROM documents")
def index_health(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").select((F.col("doc_id") % 4).cast("string").alias("snapshot_id"), F.col("lang").alias("collection_name"), F.col("source").alias("embedding_model"))
    return provenance.health(chunks, spark.createDataFrame([("1", "ready"), ("2", "ready"), ("3", "ready"), ("0", "failed")], "id string, state string"))


@query("index_freshness", "SELECT count(*) FILTER (o_orderkey % 10 NOT IN (3, 4) AND o_orderkey % 7 = 0) AS changed, count(*) FILTER (o_orderkey % 10 = 4) AS deleted, count(*) FILTER (o_orderkey % 10 = 3) AS added, false AS fresh FROM orders")
def index_freshness(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    shape = lambda rows, digest: rows.select(F.col("o_orderkey").cast("string").alias("path"), digest.alias("content_sha256"))
    return provenance.freshness(shape(o.where("o_orderkey % 10 != 3"), F.col("o_orderstatus")), shape(o.where("o_orderkey % 10 != 4"), F.when(F.col("o_orderkey") % 7 == 0, "new").otherwise(F.col("o_orderstatus"))))


_TOP = _DOCS + """, r AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS rank FROM d QUALIFY rank <= 100)"""


@query("excerpts", _TOP + """, x AS (SELECT rank, path, '1: ' || split_part(body, chr(10), 1) || CASE WHEN n_lines > 1 THEN chr(10) || '2: ' || split_part(body, chr(10), 2) ELSE '' END AS t, least(n_lines, 2) AS e FROM (SELECT * REPLACE (regexp_replace(body, 'token = "[^''"\n]{8,}"', 'token = "[REDACTED]"', 'g') AS body) FROM r) WHERE rank % 6 <> 0),
u AS (SELECT *, 14000 - coalesce(sum(length(t)) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM x)
SELECT rank::INTEGER AS rank, path, 1 AS start_line, e::INTEGER AS end_line, substr(t, 1, rest::BIGINT) AS excerpt FROM u WHERE rest > 0""")
def excerpts(spark, sf_dir):
    ranked = search.ranked(_files(spark, sf_dir), "doc_id", most=100).withColumnRenamed("position", "rank")
    n_lines = F.size(F.split(F.regexp_replace(F.decode("content", "UTF-8"), "\n$", ""), "\n", -1))
    places = ranked.select("rank", "path", F.lit(1).alias("start_line"), F.least(n_lines, F.lit(2)).alias("end_line"), F.when(F.col("rank") % 6 == 0, "gone").otherwise(F.col("hash")).alias("source_hash"), "content")
    return provenance.excerpts(places.unionByName(places.where("rank = 2").withColumn("rank", F.lit(999))))


@query("context_block", _TOP + """, x AS (SELECT rank, '[' || rank || '] ' || path || ':1-' || n_lines || chr(10) || '```md' || chr(10) || text || chr(10) || '```' AS t FROM r)
SELECT rank::INTEGER AS rank, md5(t) AS digest FROM (SELECT *, sum(length(t)) OVER (ORDER BY rank) AS used FROM x) WHERE used <= 60000""")
def context_block(spark, sf_dir):
    ranked = search.ranked(_files(spark, sf_dir), "doc_id", most=100).withColumnRenamed("position", "rank")
    body = F.decode("content", "UTF-8")
    chunks = ranked.select("rank", "path", F.lit(1).alias("start_line"), F.size(F.split(F.regexp_replace(body, "\n$", ""), "\n", -1)).alias("end_line"), F.lit("md").alias("language"), body.alias("text"))
    return answers.context(chunks, 60_000).select("rank", F.md5("section").alias("digest"))


@query("graph_first", """WITH g AS (SELECT source AS path, doc_id AS chunk_index, 0 AS side, NULL AS score FROM documents WHERE source = 'src3' UNION ALL SELECT source, doc_id, 1, n_chars::DOUBLE FROM documents WHERE lang = 'de'),
o AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY path, chunk_index ORDER BY side) = 1)
SELECT path, chunk_index, row_number() OVER (ORDER BY side, score DESC NULLS LAST, path, chunk_index)::INTEGER AS rank FROM o ORDER BY rank LIMIT 80""")
def graph_first(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("path"), F.col("doc_id").alias("chunk_index"), "lang", F.col("n_chars").cast("double").alias("score"))
    return answers.graph_first(docs.where("path = 'src3'").select("path", "chunk_index"), docs.where("lang = 'de'").select("path", "chunk_index", "score"), 80).select("path", "chunk_index", "rank")


@query("suggestions", "SELECT p_partkey AS id, p_name AS name FROM part WHERE contains(lower(p_name), lower(substr((SELECT min(p_name) FROM part), 1, 3))) ORDER BY name, id LIMIT 5")
def suggestions(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return answers.suggestions(part, part.agg(F.min("name")).first()[0][:3])


_SUMMARY = "WITH f AS (SELECT user_id AS requirement, event_type AS category, 'e' || event_id AS label, event_id % 10 = 0 AS partial FROM events)"


@query("evidence_summaries", _SUMMARY + """, g AS (SELECT requirement, category, count(*) AS n, array_to_string(list_sort(list(DISTINCT label))[1:3], ', ') AS names, bool_or(partial) AS partial FROM f GROUP BY ALL)
SELECT requirement, string_agg(n || ' ' || category || ': ' || names || CASE WHEN n > 3 THEN ', ...' ELSE '' END || CASE WHEN partial THEN ' (incomplete)' ELSE '' END, chr(10) ORDER BY category) AS text FROM g GROUP BY 1""")
def evidence_summaries(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("requirement"), F.col("event_type").alias("category"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("label"), F.when(F.col("event_id") % 10 == 0, "partial").otherwise("success").alias("status"))
    return answers.summary(rows)


@query("presentation_depth", "SELECT user_id AS requirement, event_id AS rank FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 8")
def presentation_depth(spark, sf_dir):
    return answers.shown(table(spark, sf_dir, "events").select(F.col("user_id").alias("requirement"), F.col("event_id").alias("rank"))).select("requirement", "rank")


# ── predicates, windows and rules that other queries don't reach ──────────────────────────────────────────────────


@query("ordinals", "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS ordinal FROM events")
def ordinals(spark, sf_dir):
    rows = identity.ordinal_identity(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id")
    return rows.select("event_id", F.col("ordinal").cast("long").alias("ordinal"))


@query("ready_rows", "SELECT l_orderkey * 10 + l_linenumber AS id FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O'")
def ready_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("snapshot_id"))
    states = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "ready").otherwise("building").alias("state"))
    return filters.ready(rows, states).select("id")


@query("fresh_rows", "SELECT l_orderkey * 10 + l_linenumber AS id FROM lineitem JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus = l_linestatus")
def fresh_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").cast("string").alias("path"), F.col("l_linestatus").alias("source_hash"))
    return filters.fresh(rows, table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderstatus").alias("content_sha256"))).select("id")


@query("enclosing_selection", "SELECT event_id FROM events WHERE (event_id % 40, event_id % 13) <= (20, 5) AND (20, 5) <= (event_id % 40 + 10, event_id % 7)")
def enclosing_selection(spark, sf_dir):
    k = F.col("event_id")
    named = {"start_line": k % 40, "start_column": k % 13, "end_line": k % 40 + 10, "end_column": k % 7}
    rows = table(spark, sf_dir, "events").select("event_id", *(c.cast("int").alias(n) for n, c in named.items()))
    return rows.where(filters.encloses(20, 5)).select("event_id")


@query("symbol_names", "SELECT p_partkey FROM part WHERE p_name = (SELECT min(p_name) FROM part) OR p_brand || '.' || p_name = (SELECT min(p_name) FROM part) OR p_partkey::VARCHAR = (SELECT min(p_name) FROM part)")
def symbol_names(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    rows = part.select("p_partkey", F.col("p_name").alias("name"), F.concat_ws(".", "p_brand", "p_name").alias("qualified_name"), F.col("p_partkey").cast("string").alias("id"))
    return rows.where(filters.names_symbol(part.agg(F.min("p_name")).first()[0])).select("p_partkey")


@query("footprint", "SELECT count(*) <= 500 AND (SELECT count(*) FROM lineitem) <= 10000 AS within FROM part")
def footprint(spark, sf_dir):
    fits = graph.within_footprint(table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem"), 500, 10_000)
    return spark.range(1).select(F.lit(fits).alias("within"))


@query("orphans_both_ways", "SELECT 'a' AS side, o_orderkey AS k FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber > 3) UNION ALL SELECT 'b', l_orderkey FROM lineitem WHERE l_linenumber > 3 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')")
def orphans_both_ways(spark, sf_dir):
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").where("l_linenumber > 3")
    a = snapshots.orphans(orders.select("o_orderkey"), items, "o_orderkey", "l_orderkey").select(F.lit("a").alias("side"), F.col("o_orderkey").alias("k"))
    return a.unionByName(snapshots.orphans(items.select("l_orderkey"), orders.where("o_orderstatus != 'F'"), "l_orderkey", "o_orderkey").select(F.lit("b").alias("side"), F.col("l_orderkey").alias("k")))


@query("first_chunk_of_symbol", "SELECT p_brand AS path, p_partkey::VARCHAR AS id FROM part WHERE p_name = (SELECT min(p_name) FROM part) QUALIFY row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_size, p_partkey::VARCHAR) = 1 ORDER BY p_brand, p_size, p_partkey::VARCHAR LIMIT 100")
def first_chunk_of_symbol(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    chunks = part.select(F.col("p_brand").alias("path"), F.col("p_type").alias("parent_symbol_key"), F.col("p_size").alias("start_line"), F.col("p_name").alias("name"), F.col("p_name").alias("qualified_name"), F.col("p_partkey").cast("string").alias("id"))
    none = chunks.where("false").drop("parent_symbol_key")
    return search.exact_lookup(none, chunks, part.agg(F.min("p_name")).first()[0]).select("path", "id")


@query("distinct_findings", "SELECT event_type AS category, value::INTEGER AS details FROM (SELECT DISTINCT event_type, value::INTEGER AS value FROM (SELECT event_type, floor(value) AS value FROM events)) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value) <= 25")
def distinct_findings(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("category"), F.lit("observation").alias("classification"), F.floor("value").cast("int").alias("details"))
    return evidence.distinct_findings(rows, 25).select("category", "details")


_RULES = _FACTS + ", named AS (SELECT id FROM nodes WHERE symbol_id IN ('p3', 'p6', 'p9'))"


@query("reference_test_analysis", _RULES + """, e AS (SELECT * FROM edges WHERE target IN (SELECT id FROM named))
SELECT 'references' AS category, source, target, relationship FROM e WHERE relationship = 'REFERENCES' UNION ALL SELECT 'callers', source, target, relationship FROM e WHERE relationship = 'CALLS'
UNION ALL SELECT * FROM (SELECT 'tests', source, target, relationship FROM e WHERE relationship IN ('CALLS', 'REFERENCES') AND file LIKE '%/m4.js' ORDER BY 'tests/' || file, pos, id LIMIT 100)""")
def reference_test_analysis(spark, sf_dir):
    made = _built(spark, sf_dir)
    path = F.when(F.col("evidence_file").endswith("/m4.js"), F.concat(F.lit("tests/"), "evidence_file")).otherwise(F.col("evidence_file"))
    edges = made["edges"].withColumns({"evidence_file": path, "evidence_line": F.col("start_byte")})
    return rules.reference_test_analysis(edges, made["nodes"].where("symbol_id IN ('p3', 'p6', 'p9')").select("id"))


@query("module_overview", _FACTS + """, m AS (SELECT id FROM nodes WHERE kind = 'Module' AND path LIKE '%/m1.js')
SELECT 'definitions' AS category, source, target, relationship FROM edges WHERE relationship = 'DEFINES' AND source IN (SELECT id FROM m)
UNION ALL SELECT 'exports', source, target, relationship FROM edges WHERE relationship = 'EXPORTS' AND source IN (SELECT id FROM m)""")
def module_overview(spark, sf_dir):
    made = _built(spark, sf_dir)
    return rules.module_overview(made["edges"], made["nodes"].where("kind = 'Module' AND path LIKE '%/m1.js'").select("id"))


@query("function_contracts", "SELECT p_partkey AS id, p_brand || '.' || p_name AS qualified_name, p_type AS parameters, CASE WHEN p_size > 25 THEN p_brand END AS return_annotation, '[]' AS modifiers, 'partial' AS status FROM part")
def function_contracts(spark, sf_dir):
    symbols = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(".", "p_brand", "p_name").alias("qualified_name"), F.col("p_type").alias("parameters"), F.when(F.col("p_size") > 25, F.col("p_brand")).alias("return_annotation"), F.lit("[]").alias("modifiers"))
    return rules.function_contract(symbols)


@query("valid_chains", "SELECT event_id, event_id % 4 <> 0 AND event_id % 3 <> 0 AS valid FROM events")
def valid_chains(spark, sf_dir):
    k = F.col("event_id")
    nodes = F.array(k, k + 1, k + 2)
    edge = lambda a, b: F.struct(a.alias("source"), b.alias("target"))
    edges = F.when(k % 3 == 0, F.array(edge(k, k + 1))).otherwise(F.array(edge(k, k + 1), edge(k + 1, F.when(k % 4 == 0, k).otherwise(k + 2))))
    return table(spark, sf_dir, "events").select("event_id", evidence.chain_is_valid(nodes, edges).alias("valid"))


# ── keyword search: phrases, accents, weighted fields ─────────────────────────────────────────────────────────────

@query("kw_phrase", r"""
WITH d AS (SELECT conv_id * 100 + turn AS id, regexp_extract_all(strip_accents(lower(text || CASE WHEN turn % 3 = 0 THEN ' create_access_token' WHEN turn % 3 = 1 THEN ' token access create' ELSE ' create.access token create_access' END)), '[\p{L}\p{N}]+') AS t FROM conversations),
c AS (SELECT *, len(t) AS size, len(list_filter(range(1, len(t) - 1), lambda i: t[i] = 'create' AND t[i + 1] = 'access' AND t[i + 2] = 'token')) AS tf FROM d),
s AS (SELECT count(*) AS n, avg(size) AS mean, count(*) FILTER (tf > 0) AS df FROM c)
SELECT id, round(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean)), 9) AS score FROM c, s WHERE tf > 0""")
def kw_phrase(spark, sf_dir):
    k = F.col("turn") % 3
    end = F.when(k == 0, " create_access_token").when(k == 1, " token access create").otherwise(" create.access token create_access")
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.concat("text", end).alias("text"))
    return search.bm25(rows, ["create_access_token"], "id").select("id", F.round("score", 9).alias("score"))


@query("kw_accents", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(coalesce(text, '') || CASE WHEN doc_id % 4 = 0 THEN ' Café' WHEN doc_id % 4 = 1 THEN ' CAFE' ELSE '' END)), '[\p{L}\p{N}]+') AS t FROM documents),
c AS (SELECT doc_id, len(t) AS size, len(list_filter(t, lambda x: x = 'cafe')) AS tf FROM d), s AS (SELECT count(*) AS n, avg(size) AS mean, count(*) FILTER (tf > 0) AS df FROM c)
SELECT doc_id, round(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean)), 9) AS score FROM c, s WHERE tf > 0""")
def kw_accents(spark, sf_dir):
    end = F.when(F.col("doc_id") % 4 == 0, " Café").when(F.col("doc_id") % 4 == 1, " CAFE").otherwise("")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), end).alias("text"))
    return search.bm25(rows, ["cafe\u0301"]).select(F.col("id").alias("doc_id"), F.round("score", 9).alias("score"))


@query("kw_weighted_fields", r"""
WITH d AS (SELECT p_partkey, list_transform([p_brand, p_name, p_type, p_name, p_brand], lambda x: regexp_extract_all(lower(x), '[\p{L}\p{N}]+')) AS f, (SELECT lower(regexp_extract(min(p_type), '[\p{L}\p{N}]+')) FROM part) AS w FROM part),
c AS (SELECT p_partkey, list_sum(list_transform(f, lambda x: len(x))) AS size, list_sum(list_transform(f, lambda x, i: [1, 4, 2, 1, 2][i] * len(list_filter(x, lambda y: y = w)))) AS tf FROM d),
s AS (SELECT count(*) AS n, avg(size) AS mean, count(*) FILTER (tf > 0) AS df FROM c)
SELECT p_partkey, round(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean)), 9) AS score FROM c, s WHERE tf > 0""")
def kw_weighted_fields(spark, sf_dir):
    """Path, name, comments, source and terms, at their weights."""
    part = table(spark, sf_dir, "part")
    word = part.agg(F.min("p_type")).first()[0].split()[0]
    rows = part.select("p_partkey", F.col("p_brand").alias("path"), F.col("p_name").alias("name"), F.col("p_type").alias("comments"), F.col("p_name").alias("source"), F.col("p_brand").alias("terms"))
    hits = search.bm25(rows, [word], "p_partkey", {"path": 1, "name": 4, "comments": 2, "source": 1, "terms": 2})
    return hits.select(F.col("id").alias("p_partkey"), F.round("score", 9).alias("score"))
