"""Queries of proofs, incremental maintenance and streams over the given tables, and SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphquarry.operators import maintenance, packing, proofs, traversal

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


# ── proofs: events are nodes, a user's next event is the target of an edge; findings are paths of two edges ─────────

_PROVED = """
WITH nodes AS (SELECT event_id AS k, 'n' || event_id AS id, event_type AS label, CASE WHEN event_id % 3 = 0 THEN 's' || event_id END AS symbol_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS next FROM events),
edges AS (SELECT k, 'e' || k AS id, id AS source, 'n' || next AS target, CASE k % 2 WHEN 0 THEN 'CALLS' ELSE 'DEPENDS_ON' END AS relationship, CASE WHEN k % 29 = 0 THEN 'unresolved' ELSE 'resolved' END AS resolution, md5('e' || k) AS hash, k % 90 + 1 AS line FROM nodes WHERE next IS NOT NULL),
f AS (
  SELECT a.k, b.k AS k2, c.k AS k3, a.label AS l1, CASE WHEN a.k % 7 = 0 THEN 'other' ELSE b.label END AS l2, c.label AS l3,
    CASE WHEN a.k % 5 = 0 THEN c.k ELSE b.k END AS chain2, CASE WHEN a.k % 11 = 0 THEN 'CALLS' ELSE ea.relationship END AS said,
    CASE WHEN a.k % 31 = 0 THEN 'none' ELSE ea.id END AS proof1, ea.hash || CASE WHEN a.k % 13 = 0 THEN 'x' ELSE '' END AS hash1, ea.line + CASE WHEN a.k % 17 = 0 THEN 1 ELSE 0 END AS line1,
    CASE WHEN a.k % 19 = 0 THEN 'g1' ELSE 'g2' END AS snapshot1, CASE WHEN a.k % 23 = 0 THEN 'inferred' ELSE ea.resolution END AS res1, ea.relationship AS r1, eb.relationship AS r2, ea.resolution AS q1, eb.resolution AS q2, CASE WHEN a.k % 37 = 0 THEN 's1' ELSE a.symbol_id END AS claimed, a.symbol_id
  FROM nodes a JOIN edges ea ON ea.k = a.k JOIN nodes b ON b.k = a.next JOIN edges eb ON eb.k = b.k JOIN nodes c ON c.k = b.next
), v AS (
  SELECT 'f' || k AS finding_id, CASE WHEN snapshot1 <> 'g2' THEN 'generation_mismatch' WHEN proof1 = 'none' THEN 'missing' WHEN k % 13 = 0 THEN 'source_hash' WHEN k % 17 = 0 THEN 'source_range' WHEN res1 <> q1 THEN 'provenance'
    WHEN q1 <> 'resolved' OR q2 <> 'resolved' OR r1 <> said OR r2 <> said THEN 'claim_provenance' WHEN chain2 <> k2 THEN 'claim_provenance' WHEN k % 7 = 0 THEN 'canonical_identity' WHEN claimed IS DISTINCT FROM symbol_id AND claimed IS NOT NULL THEN 'canonical_identity' END AS code
  FROM f
)"""


def _proved(spark, sf_dir):
    """Nodes, stored entities, findings and their proofs, with plants of every kind; the context of generation g2."""
    k = F.col("k")
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    in_turn = Window.partitionBy("user_id").orderBy("event_id")
    events = table(spark, sf_dir, "events").select("event_id", "event_type", F.lead("event_id").over(in_turn).alias("next"), F.lead("event_id", 2).over(in_turn).alias("third"), F.lead("event_type").over(in_turn).alias("next_type"), F.lead("event_type", 2).over(in_turn).alias("third_type"))
    symbol = F.when(F.col("event_id") % 3 == 0, text("s", F.col("event_id"))).alias("symbol_id")
    nodes = events.select(F.col("event_id").alias("k"), text("n", F.col("event_id")).alias("id"), F.col("event_type").alias("label"), symbol, "next")
    none = lambda kind: F.lit(None).cast(kind)
    relationship = F.when(k % 2 == 0, "CALLS").otherwise("DEPENDS_ON")
    resolution = F.when(k % 29 == 0, "unresolved").otherwise("resolved")
    line = (k % 90 + 1).cast("int")
    edges = nodes.where("next IS NOT NULL").select(
        "k", text("e", k).alias("id"), F.lit("relationship").alias("kind"), F.lit("file").alias("file_id"), none("string").alias("symbol_id"), F.md5(text("e", k)).alias("source_hash"), line.alias("start_line"), line.alias("end_line"),
        resolution.alias("resolution"), F.col("id").alias("source"), text("n", F.col("next")).alias("target"), relationship.alias("relationship"),
    )
    # event ids are keys, so the two next events of a user are the nodes that two edges lead to
    ways = events.where("third IS NOT NULL").select(
        F.col("event_id").alias("k"), F.col("event_id").alias("a_k"), F.col("next").alias("b_k"), text("n", F.col("event_id")).alias("a_id"), text("n", F.col("next")).alias("b_id"), text("n", F.col("third")).alias("c_id"),
        F.col("event_type").alias("a_label"), F.col("next_type").alias("b_label"), F.col("third_type").alias("c_label"), symbol.alias("a_symbol_id"),
    )
    findings = ways.select(
        text("f", k).alias("finding_id"), F.lit("graph").alias("kind"), F.when(k % 11 == 0, "CALLS").otherwise(relationship).alias("relationship"),
        F.array("a_id", F.when(k % 5 == 0, F.col("c_id")).otherwise(F.col("b_id")), "c_id").alias("path_node_ids"), F.array("a_label", F.when(k % 7 == 0, "other").otherwise(F.col("b_label")), "c_label").alias("path_names"),
        F.col("a_id").alias("source_node_id"), F.when(k % 37 == 0, "s1").otherwise(F.col("a_symbol_id")).alias("source_symbol_id"), none("string").alias("source_name"), none("string").alias("target_node_id"), none("string").alias("target_symbol_id"), F.col("c_label").alias("target_name"),
        none("string").alias("entity_id"), none("string").alias("entity_name"), none("string").alias("chunk_id"),
    )
    cited = ways.select(text("f", k).alias("finding_id"), F.col("a_k").alias("of"), F.posexplode(F.array("a_k", "b_k")).alias("position", "k"))
    cited = cited.select("finding_id", "of", "position", text("e", k).alias("id"), F.md5(text("e", k)).alias("source_hash"), line.alias("start_line"), resolution.alias("resolution"))
    first = F.col("position") == 0
    plant = lambda n, bad, good: F.when(first & (F.col("of") % n == 0), bad).otherwise(good)
    shown = plant(17, F.col("start_line") + 1, F.col("start_line"))
    made = cited.select(
        "finding_id", "position", plant(31, F.lit("none"), F.col("id")).alias("evidence_id"), F.lit("r").alias("repository_id"), plant(19, F.lit("g1"), F.lit("g2")).alias("snapshot_id"), F.lit("stage").alias("stage_id"), F.lit("graph_relationship").alias("evidence_type"),
        plant(23, F.lit("inferred"), F.col("resolution")).alias("resolution"), plant(13, F.concat("source_hash", F.lit("x")), F.col("source_hash")).alias("source_hash"), shown.alias("start_line"), shown.alias("end_line"), F.lit("file").alias("file_id"), none("string").alias("symbol_id"),
    )
    return nodes.select("id", "label", "symbol_id"), edges.drop("k"), findings, made, proofs.Context("r", "g2", ("stage",))


@query("proved_findings", _PROVED + " SELECT finding_id, CASE WHEN code IS NULL THEN 'proved' ELSE 'rejected' END AS verdict, code FROM v")
def proved_findings(spark, sf_dir):
    """The verdict and code of every path, with wrong hashes, ranges, names, chains, generations and ids among them."""
    nodes, entities, findings, made, context = _proved(spark, sf_dir)
    return proofs.prove(findings, made, entities, nodes, context).select("finding_id", "verdict", "code")


_SAVED = _PROVED + """, items AS (SELECT finding_id, substr(finding_id, 2)::BIGINT // 4 AS answer, substr(finding_id, 2)::BIGINT % 2 AS requirement, code IS NULL AND substr(finding_id, 2)::BIGINT % 41 <> 0 AS stays FROM v),
answers AS (SELECT answer, CASE WHEN answer % 10 = 0 THEN 'unauthorized' WHEN answer % 10 = 1 THEN 'stale' END AS scope, count(*) AS n, count(*) FILTER (stays) AS ok FROM items GROUP BY answer)"""


def _saved(spark, sf_dir):
    """Saved answers over the findings, proved again."""
    nodes, entities, findings, made, context = _proved(spark, sf_dir)
    verdicts = proofs.prove(findings, made, entities, nodes, context)
    k = F.substring("finding_id", 2, 20).cast("long")
    answer = F.floor(k / 4)
    items = findings.select(answer.alias("answer_id"), (k % 2).alias("requirement_id"), F.concat(F.lit("i"), "finding_id").alias("item_id"), "finding_id", F.array(F.concat(F.lit("x"), k.cast("string"))).alias("evidence_ids"))
    answers = items.select("answer_id").distinct().select("answer_id", F.when(F.col("answer_id") % 10 == 0, "q").otherwise("r").alias("repository_id"), F.when(F.col("answer_id") % 10 == 1, "g1").otherwise("g2").alias("snapshot_id"))
    bad = findings.where(k % 41 == 0).select(answer.alias("answer_id"), F.concat(F.lit("x"), k.cast("string")).alias("evidence_id"))
    return proofs.preview(answers, items, verdicts, bad, context)


@query("saved_answers", _SAVED + " SELECT answer::BIGINT AS answer_id, coalesce(scope, CASE WHEN ok = n THEN 'verified' WHEN ok > 0 THEN 'partial' ELSE 'error' END) AS status FROM answers")
def saved_answers(spark, sf_dir):
    return _saved(spark, sf_dir)[0]


@query("saved_requirements", _SAVED + """ SELECT answer::BIGINT AS answer_id, requirement::BIGINT AS requirement_id, CASE WHEN bool_and(stays) THEN 'unchanged' WHEN bool_or(stays) THEN 'partially_satisfied' ELSE 'error' END AS state
FROM items JOIN answers USING (answer) WHERE scope IS NULL GROUP BY 1, 2""")
def saved_requirements(spark, sf_dir):
    return _saved(spark, sf_dir)[1].drop("left")


# ── incremental maintenance: customers are files, orders symbols, line items call sites; a generation later some customers
#    have changed, gone or come ──────────────────────────────────────────────────────────────────────────────────────────

_LATER = """
WITH o AS (SELECT o_orderkey, 'c' || o_custkey AS path, o_custkey % 10 AS k FROM orders WHERE o_custkey % 10 <> 4),
symbols AS (SELECT DISTINCT path || ':n' || (CASE WHEN k = 3 THEN o_orderkey * 7 ELSE o_orderkey END) % 20011 AS id, path, 'n' || (CASE WHEN k = 3 THEN o_orderkey * 7 ELSE o_orderkey END) % 20011 AS name FROM o),
calls AS (SELECT 'o' || l_orderkey AS source, path AS file, 'n' || (CASE WHEN k = 3 THEN l_partkey * 17 ELSE l_partkey * 13 END + l_orderkey) % 20011 AS name, l_linenumber AS line FROM lineitem JOIN o ON o_orderkey = l_orderkey),
names AS (SELECT name, count(*) AS n, CASE WHEN count(*) = 1 THEN min(id) END AS "only" FROM symbols GROUP BY name)"""


def _facts_of(spark, sf_dir, later: bool):
    """The inventory, and all facts of a generation."""
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    k = F.col("o_custkey") % 10
    there = k != (4 if later else 5)
    path, changed = text("c", F.col("o_custkey")), (k == 3) & F.lit(later)
    orders = table(spark, sf_dir, "orders").where(there).select("o_orderkey", path.alias("path"), changed.alias("changed"))
    name = text("n", F.when(F.col("changed"), F.col("o_orderkey") * 7).otherwise(F.col("o_orderkey")) % 20011)
    symbols = orders.select(F.concat("path", F.lit(":"), name).alias("id"), "path", F.lit("function").alias("kind"), name.alias("name")).distinct()
    called = text("n", (F.when(F.col("changed"), F.col("l_partkey") * 17).otherwise(F.col("l_partkey") * 13) + F.col("l_orderkey")) % 20011)
    items = table(spark, sf_dir, "lineitem").join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
    calls = items.select(text("o", F.col("l_orderkey")).alias("source"), F.col("path").alias("file"), called.alias("name"), F.col("l_linenumber").alias("line"))
    digest = F.md5(F.concat("path", F.col("changed").cast("string")))
    files = orders.groupBy("path").agg(F.max("changed").alias("changed")).select("path", digest.alias("content_sha256"), F.lit("included").alias("status"))
    chunks = symbols.select(F.md5(F.concat("id", F.lit("chunk"))).alias("id"), "path")
    return files, {"symbols": symbols, "calls": calls, "chunks": chunks, "vectors": chunks.select("id")}


def _maintained(spark, sf_dir, *without: str):
    """The earlier generation, updated by the facts of the files that differ; tables that a query doesn't ask for are left out."""
    files, facts = _facts_of(spark, sf_dir, later=False)
    had = {t: None if t in without else facts[t] for t in facts}
    state = maintenance.build(files, had["symbols"], had["calls"], had["chunks"], had["vectors"])
    now, facts = _facts_of(spark, sf_dir, later=True)
    differ = maintenance.changes(files, now).where("change != 'deleted'").select("path")
    own = {t: facts[t].join(differ.withColumnRenamed("path", of), of, "left_semi") for t, of in (("symbols", "path"), ("calls", "file"), ("chunks", "path")) if t not in without}
    return maintenance.update(state, now, own | {"vectors": facts["vectors"]})


@query("updated_edges", _LATER + """ SELECT source, file, c.name, line, coalesce(s.id, n."only", c.name) AS target FROM calls c LEFT JOIN symbols s ON s.id = c.file || ':' || c.name
LEFT JOIN (SELECT name AS m, "only" FROM names WHERE n = 1) n ON m = c.name""")
def updated_edges(spark, sf_dir):
    """Call sites after an update: the same as of everything built anew."""
    return _maintained(spark, sf_dir, "chunks", "vectors")["edges"].select("source", "file", "name", "line", "target")


@query("updated_names", _LATER + ' SELECT name, n, "only" FROM names')
def updated_names(spark, sf_dir):
    return _maintained(spark, sf_dir, "calls", "chunks", "vectors")["names"]


@query("updated_chunks", _LATER + " SELECT md5(id || 'chunk') AS id, path FROM symbols")
def updated_chunks(spark, sf_dir):
    state = _maintained(spark, sf_dir, "calls")
    return state["chunks"].join(state["vectors"], "id").select("id", "path")


# ── bounded retrieval over several hops: what depends on each part, over orders and customers ─────────────


def _bounded_sql(limit: int, budget: int, depth: int) -> str:
    """The walks of all parts, a few common tables for each hop."""
    steps = ["""
WITH edges AS (
  SELECT 's' || l_suppkey AS here, 'p' || l_partkey AS other, 'a' || l_orderkey || '-' || l_linenumber || '-' || l_partkey AS edge, l_linenumber AS line, l_returnflag AS file FROM lineitem
  UNION ALL SELECT 'p' || l_partkey, 'o' || l_orderkey, 'b' || l_orderkey || '-' || l_linenumber || '-' || l_suppkey, l_linenumber, l_returnflag FROM lineitem
  UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 'c' || o_orderkey, 1, o_orderstatus FROM orders
), adj AS (SELECT here, other, edge, row_number() OVER (PARTITION BY here ORDER BY file, line, edge) AS rank FROM edges QUALIFY rank <= 100),
f1 AS (SELECT 'p' || p_partkey AS q, 'p' || p_partkey AS node, 1 AS at_, []::VARCHAR[] AS chain FROM part), v1 AS (SELECT q, node FROM f1), c1 AS (SELECT q, 0 AS examined, 0 AS found FROM f1)"""]
    for h in range(1, depth + 1):
        steps.append(f"""
r{h} AS MATERIALIZED (SELECT f.q, f.at_, a.rank, a.other, a.edge, f.chain, c.examined, c.found, row_number() OVER (PARTITION BY f.q ORDER BY f.at_, a.rank) AS nth FROM f{h} f JOIN adj a ON a.here = f.node JOIN c{h} c ON c.q = f.q QUALIFY examined + nth <= {budget}),
o{h} AS (SELECT * FROM r{h} QUALIFY row_number() OVER (PARTITION BY q, other ORDER BY at_, rank) = 1),
n{h} AS MATERIALIZED (SELECT o.*, row_number() OVER (PARTITION BY o.q ORDER BY at_, rank) AS hits FROM o{h} o ANTI JOIN v{h} v ON v.q = o.q AND v.node = o.other QUALIFY found + hits - 1 < {limit}),
c{h + 1} AS MATERIALIZED (
  SELECT c.q, CASE WHEN c.found + coalesce(g.n, 0) >= {limit} THEN c.examined + g.last ELSE least(c.examined + coalesce(m.n, 0), {budget}) END AS examined, c.found + coalesce(g.n, 0) AS found
  FROM c{h} c LEFT JOIN (SELECT q, count(*) AS n, max(nth) AS last FROM n{h} GROUP BY q) g ON g.q = c.q LEFT JOIN (SELECT f.q, count(*) AS n FROM f{h} f JOIN adj a ON a.here = f.node GROUP BY f.q) m ON m.q = c.q),
f{h + 1} AS (SELECT n.q, other AS node, row_number() OVER (PARTITION BY n.q ORDER BY at_, rank) AS at_, list_append(chain, edge) AS chain FROM n{h} n JOIN c{h + 1} c ON c.q = n.q WHERE c.found < {limit} AND c.examined < {budget}),
v{h + 1} AS (SELECT q, node FROM v{h} UNION ALL SELECT q, other FROM n{h})""")
    parts = [f"SELECT q AS question, (found + hits)::BIGINT AS position, other AS node, {h} AS distance, array_to_string(list_append(chain, edge), '>') AS chain FROM n{h}" for h in range(1, depth + 1)]
    return ",".join(steps) + " " + " UNION ALL ".join(parts)


@query("bounded_impact", _bounded_sql(45, 100, 3))
def bounded_impact(spark, sf_dir):
    """The first 45 nodes that depend on each part, each with the chain of edges that leads to it, from one budget of edges a
    part."""
    text = lambda prefix, *cs: F.concat(F.lit(prefix), F.concat_ws("-", *(F.col(c).cast("string") for c in cs)))
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    place = [F.col("l_linenumber").alias("evidence_line"), F.col("l_returnflag").alias("evidence_file")]
    edges = (
        items.select(text("p", "l_partkey").alias("source"), text("s", "l_suppkey").alias("target"), text("a", "l_orderkey", "l_linenumber", "l_partkey").alias("id"), *place)
        .unionByName(items.select(text("o", "l_orderkey").alias("source"), text("p", "l_partkey").alias("target"), text("b", "l_orderkey", "l_linenumber", "l_suppkey").alias("id"), *place))
        .unionByName(orders.select(text("c", "o_custkey").alias("source"), text("o", "o_orderkey").alias("target"), text("c", "o_orderkey").alias("id"), F.lit(1).alias("evidence_line"), F.col("o_orderstatus").alias("evidence_file")))
    ).withColumns({"relationship": F.lit("DEPENDS_ON"), "resolution": F.lit("resolved")})
    seeds = table(spark, sf_dir, "part").select(text("p", "p_partkey").alias("question"), text("p", "p_partkey").alias("node"))
    found = traversal.walk(seeds, traversal.first_edges(edges, "DEPENDS_ON", reverse=True), limit=45)["results"]
    return found.select("question", "position", "node", "distance", F.array_join("chain", ">").alias("chain"))


@query("packed_findings")
def packed_findings(spark, sf_dir):
    """Findings of many answers that fit their budgets: a user's events are the findings of their answers, one for each
    five hundred events. Tested against a plain loop over one answer at a time."""
    k = F.col("event_id")
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    answer = F.concat_ws("-", F.col("user_id").cast("string"), F.floor(k / 500).cast("string"))
    events = table(spark, sf_dir, "events").withColumn("answer_id", answer)
    claims = events.select("answer_id", F.col("event_type").alias("requirement_id"), F.length("event_type").alias("requirement_at"), k.alias("position"), text("f", k).alias("finding_id"), F.array(text("e", k % 20), text("e", k % 7)).alias("evidence_ids"), (k % 35).cast("int").alias("items"), (100 + k % 900).cast("int").alias("bytes"))
    records = events.groupBy("answer_id", text("e", k % 20).alias("evidence_id")).agg(F.max(50 + k % 200).alias("bytes"), F.max(k % 3 * 100).alias("context_bytes"), F.sort_array(F.collect_set("event_type")).alias("requirement_ids"))
    return packing.pack(claims, records, packing.Limits(records=12, context_bytes=600, findings=3, package_bytes=6_000))["findings"]
