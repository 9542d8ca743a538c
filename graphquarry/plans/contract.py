"""One query for each operator over the given tables, and SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphquarry.functions import identity, text, vectors
from graphquarry.operators import chunking, evidence, filters, graph, metrics, postings, ranges, rules, search, snapshots
from graphquarry.plans import contract_graph, contract_state, documentation, understanding
from graphquarry.streaming import events as change_events
from graphquarry.streaming import state as stream_state

QUERIES: dict = contract_graph.QUERIES | contract_state.QUERIES
ORACLES: dict[str, str] = contract_graph.ORACLES | contract_state.ORACLES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["kw_bm25_topk"](spark, sf_dir)


# ── retrieval ─────────────────────────────────────────────────────────────────────────────────────────────────────

TERMS = ["license", "und", "worthless", "de", "token"]
_TOKENS = r"regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\p{L}\p{N}]+')"
_BM25 = f"""
WITH d AS (SELECT doc_id, len({_TOKENS}) AS size, {_TOKENS} AS t FROM documents),
corpus AS (SELECT count(*) AS n, avg(size) AS mean FROM d),
hit AS (SELECT doc_id, size, w, len(list_filter(t, lambda x: x = w)) AS tf FROM d, unnest({TERMS}) AS q(w)),
df AS (SELECT w, count(*) FILTER (tf > 0) AS df FROM hit GROUP BY w),
scored AS (
  SELECT doc_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) AS score
  FROM hit JOIN df USING (w), corpus GROUP BY doc_id HAVING sum(tf) > 0
)"""


@query("kw_bm25_topk", _BM25 + " SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY round(score, 6) DESC, doc_id LIMIT 50")
def kw_bm25_topk(spark, sf_dir):
    scored = search.bm25(table(spark, sf_dir, "documents"), TERMS)
    rows = scored.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))
    return search.top(rows, 50, F.desc("score"), "doc_id")


@query(
    "kw_bm25_batch",
    r"""
WITH p AS (SELECT doc_id, unnest(regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\p{L}\p{N}]+')) AS term FROM documents),
i AS (SELECT doc_id, term, count(*) AS tf FROM p GROUP BY ALL),
s AS (SELECT doc_id, len(regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\p{L}\p{N}]+')) AS size FROM documents),
c AS (SELECT count(*) AS n, avg(size) AS mean FROM s),
df AS (SELECT term, count(*) AS df FROM i GROUP BY 1),
q AS (SELECT DISTINCT item_id, unnest(list_distinct(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+'))) AS term FROM benchmark),
r AS (SELECT item_id, doc_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score
      FROM q JOIN i USING (term) JOIN df USING (term) JOIN s USING (doc_id), c GROUP BY ALL)
SELECT item_id, doc_id, score FROM r QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 5
""",
)
def kw_bm25_batch(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), text.tokens(F.col("text")).alias("terms"))
    best = search.bm25_batch(table(spark, sf_dir, "documents"), asked, 5)
    return best.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "score")


@query("kw_postings_topk", ORACLES["kw_bm25_topk"])
def kw_postings_topk(spark, sf_dir):
    """The best documents by an inverted index: the same as without one."""
    index = postings.build(table(spark, sf_dir, "documents"))
    asked = spark.range(1).select(F.col("id").alias("query_id"), F.array(*map(F.lit, TERMS)).alias("terms"))
    return postings.ranked(index, asked, 50).select(F.col("id").alias("doc_id"), "score")


@query("kw_postings_batch", ORACLES["kw_bm25_batch"])
def kw_postings_batch(spark, sf_dir):
    """All questions from one index."""
    index = postings.build(table(spark, sf_dir, "documents"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), text.tokens(F.col("text")).alias("terms"))
    return postings.ranked(index, asked, 5).select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "score")


@query("kw_ready_hits", _BM25 + " SELECT doc_id, round(score, 6) AS score FROM scored WHERE doc_id % 5 < 3 ORDER BY round(score, 6) DESC, doc_id LIMIT 50")
def kw_ready_hits(spark, sf_dir):
    """The best documents among those of ready snapshots: rows of others are gone before the ranking."""
    docs = table(spark, sf_dir, "documents")
    states = docs.select((F.col("doc_id") % 5).alias("snapshot_id")).distinct().select("snapshot_id", F.when(F.col("snapshot_id") < 3, "ready").otherwise("building").alias("state"))
    ready = docs.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 5).alias("snapshot_id")).join(states.where("state = 'ready'"), "snapshot_id", "left_semi")
    asked = spark.range(1).select(F.col("id").alias("query_id"), F.array(*map(F.lit, TERMS)).alias("terms"))
    return postings.ranked(postings.build(docs), asked, 50, among=ready).select(F.col("id").alias("doc_id"), "score")


def _first_vector(spark, sf_dir) -> list[float]:
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]


_COS = """
WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id, label, round(
  list_sum(list_transform(list_zip(embedding, e), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))
  / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) / sqrt(list_sum(list_transform(e, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS score
  FROM embeddings, q)"""


@query("vec_cosine_topk", _COS + " SELECT vec_id, label, score FROM s ORDER BY score DESC, vec_id LIMIT 20")
def vec_cosine_topk(spark, sf_dir):
    rows = search.nearest(table(spark, sf_dir, "embeddings"), _first_vector(spark, sf_dir), 20)
    return rows.withColumn("score", F.round("score", 6))


@query("vec_filtered_topk", _COS + " SELECT vec_id, label, score FROM s WHERE label IN (2, 9) AND label <> 3 AND vec_id >= 10 ORDER BY score DESC, vec_id LIMIT 20")
def vec_filtered_topk(spark, sf_dir):
    where = filters.payload_filter({"must": [{"key": "vec_id", "range": {"gte": 10}}], "should": [{"key": "label", "match": {"any": [2, 9]}}], "must_not": [{"key": "label", "match": {"value": 3}}]})
    return search.nearest(table(spark, sf_dir, "embeddings"), _first_vector(spark, sf_dir), 20, where).withColumn("score", F.round("score", 6))


@query("vec_threshold", _COS + " SELECT vec_id, label, score FROM s WHERE score >= 0.5")
def vec_threshold(spark, sf_dir):
    return search.nearest(table(spark, sf_dir, "embeddings"), _first_vector(spark, sf_dir), None, least=0.5).withColumn("score", F.round("score", 6))


@query("vec_valid", "SELECT label, count(*) AS n, round(sum(abs(n2 - 1)) , 6) AS off FROM (SELECT label, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n2 FROM embeddings WHERE len(embedding) = 64) GROUP BY label")
def vec_valid(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").where(vectors.is_valid(F.col("embedding"), 64))
    off = F.abs(vectors.norm(vectors.unit(F.col("embedding"))) - 1)
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.floor(F.sum(off) * 100) / 100, 6).alias("off"))


@query("vec_checked", """
WITH p AS (SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN embedding[1:63]::DOUBLE[] WHEN vec_id % 13 = 0 THEN list_transform(embedding, lambda x: 0.0::DOUBLE) WHEN vec_id % 17 = 0 THEN list_concat(['nan'::DOUBLE], embedding[2:64]::DOUBLE[])
  WHEN vec_id % 19 = 0 THEN list_concat(['inf'::DOUBLE], embedding[2:64]::DOUBLE[]) WHEN vec_id % 23 = 0 THEN list_concat([NULL::DOUBLE], embedding[2:64]::DOUBLE[]) WHEN vec_id % 29 = 0 THEN NULL ELSE embedding::DOUBLE[] END AS v FROM embeddings),
c AS (SELECT vec_id, v, coalesce(len(v) = 64 AND len(list_filter(v, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(v, lambda x: x <> 0)) > 0, false) AS valid FROM p)
SELECT vec_id, valid, CASE WHEN valid THEN round(list_sum(list_transform(list_zip(u, range(1, 65)), lambda x: x[1] * x[2])), 4) END AS weighed
FROM (SELECT *, list_transform(v, lambda x: (x / norm)::FLOAT::DOUBLE) AS u FROM (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM c))""")
def vec_checked(spark, sf_dir):
    """Which vectors are valid, with wrong sizes, zeros, NaN, infinity, nulls and missing ones among them, and of those that
    are the components of their unit vector, weighed by place."""
    k, v = F.col("vec_id") % 1_000_000_007, F.col("embedding").cast("array<double>")
    first = lambda x: F.concat(F.array(F.lit(x).cast("double")), F.slice(v, 2, 63))
    planted = (
        F.when(k % 11 == 0, F.slice(v, 1, 63)).when(k % 13 == 0, F.transform(v, lambda x: F.lit(0.0))).when(k % 17 == 0, first(float("nan"))).when(k % 19 == 0, first(float("inf"))).when(k % 23 == 0, first(None))
        .when(k % 29 == 0, F.lit(None).cast("array<double>")).otherwise(v)
    )
    rows = table(spark, sf_dir, "embeddings").select("vec_id", planted.alias("v")).withColumn("valid", vectors.is_valid(F.col("v"), 64))
    weighed = vectors.dot(vectors.unit(F.col("v")), F.sequence(F.lit(1), F.lit(64)))
    return rows.select("vec_id", "valid", F.when(F.col("valid"), F.round(weighed, 4)).alias("weighed"))


_TWO = """
WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS pa FROM documents QUALIFY pa <= 100),
b AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR), doc_id) AS pb FROM documents QUALIFY pb <= 100),
f AS (SELECT doc_id, pa, pb, coalesce(1.0 / (60 + pa), 0) + coalesce(1.0 / (60 + pb), 0) AS s FROM a FULL JOIN b USING (doc_id))
"""


@query("rrf_hybrid", _TWO + "SELECT doc_id, round(s, 9) AS score, concat_ws(',', CASE WHEN pa IS NOT NULL THEN 'length' END, CASE WHEN pb IS NOT NULL THEN 'shuffled' END) AS channels FROM f ORDER BY s DESC, doc_id LIMIT 100")
def rrf_hybrid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    length = search.ranked(docs, F.desc("n_chars"), "doc_id")
    shuffled = search.ranked(docs, F.md5(F.col("doc_id").cast("string")), "doc_id")
    return search.fused({"length": length, "shuffled": shuffled}, ["doc_id"]).withColumn("score", F.round("score", 9))


@query("final_order", "SELECT doc_id, source, lang, n_chars FROM documents ORDER BY source <> 'src3', lang = 'de', lang <> 'en', n_chars DESC, doc_id LIMIT 100")
def final_order(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    order = search.final_order(F.col("source") == "src3", F.col("lang") == "de", F.col("lang") != "en", F.col("n_chars"))
    return search.top(docs, 100, *order, "doc_id")


@query(
    "literal_line_search",
    r"""SELECT doc_id, line, text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1)::INTEGER AS line FROM documents)
WHERE contains(regexp_replace(lower(text), '\s+', '', 'g'), 'underthemitlicense') OR contains(regexp_replace(lower(text), '\s+', '', 'g'), 'underthemit license')""",
)
def literal_line_search(spark, sf_dir):
    return search.literal_lines(table(spark, sf_dir, "documents"), "Under the  MIT License").withColumnRenamed("id", "doc_id")


@query("metadata_filter", "SELECT doc_id, source, lang FROM documents WHERE source IN ('src1', 'src2') AND lang IN ('en', 'fr')")
def metadata_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    wanted = {"files": ["src1", "src2"], "languages": ["en", "fr"], "modules": []}
    return docs.where(filters.metadata_filter(wanted, {"files": "source", "languages": "lang", "modules": "source"}))


@query(
    "exact_lookup",
    "SELECT p_partkey AS id, p_name AS name FROM part WHERE p_brand = (SELECT min(p_brand) FROM part) AND p_name = (SELECT min(p_name) FROM part WHERE p_brand = (SELECT min(p_brand) FROM part)) ORDER BY p_partkey LIMIT 100",
)
def exact_lookup(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    brand = part.agg(F.min("p_brand")).first()[0]
    name = part.where(F.col("p_brand") == brand).agg(F.min("p_name")).first()[0]
    # a part stands at the line of its key, so that the first hundred are the first by number; as texts, 10 is before 9
    symbols = part.select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("start_line"), F.col("p_name").alias("name"), F.col("p_name").alias("qualified_name"), F.col("p_partkey").cast("string").alias("id"))
    none = symbols.where("false").withColumn("parent_symbol_key", F.lit(""))
    return search.exact_lookup(symbols, none, name, F.col("path") == brand).select(F.col("id").cast("long").alias("id"), "name")


# ── scans and scalar functions ────────────────────────────────────────────────────────────────────────────────────

_STATUS = r"""
WITH f AS (SELECT doc_id, source || '/' || doc_id || CASE lang WHEN 'en' THEN '.ts' WHEN 'de' THEN '.js' WHEN 'fr' THEN '.json' ELSE '.bin' END AS path, text, strlen(coalesce(text, '')) AS size FROM documents),
k AS (SELECT *, CASE WHEN path LIKE '%.ts' OR path LIKE '%.js' THEN 'source' ELSE 'unsupported' END AS kind FROM f),
s AS (SELECT doc_id, path, kind, size AS size_bytes,
  CASE WHEN path LIKE 'src7/%' THEN 'custom_exclusion' WHEN kind = 'unsupported' THEN 'unsupported_file_type' WHEN size > 5000 THEN 'too_large'
       WHEN regexp_matches(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----|\bAKIA[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36,}\b|\bsk-[A-Za-z0-9_-]{20,}\b') THEN 'possible_embedded_secret' ELSE 'eligible' END AS reason FROM k)"""
_CASES = "CASE reason WHEN 'custom_exclusion' THEN 'ignored' WHEN 'unsupported_file_type' THEN 'unsupported' WHEN 'eligible' THEN 'included' ELSE 'skipped' END"


def _inventory(spark, sf_dir) -> DataFrame:
    from graphquarry.sources import inventory

    docs = table(spark, sf_dir, "documents")
    suffix = F.when(F.col("lang") == "en", ".ts").when(F.col("lang") == "de", ".js").when(F.col("lang") == "fr", ".json").otherwise(".bin")
    files = docs.select("doc_id", F.concat("source", F.lit("/"), "doc_id", suffix).alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return inventory.classified(files, exclusions=("src7/*",), max_bytes=5000)


@query("inventory_status", _STATUS + f" SELECT doc_id, path, kind, reason, {_CASES} AS status FROM s")
def inventory_status(spark, sf_dir):
    return _inventory(spark, sf_dir).select("doc_id", "path", "kind", "reason", "status")


@query("inventory_stats", _STATUS + f" SELECT kind, {_CASES} AS status, count(*) AS files, sum(size_bytes)::BIGINT AS bytes FROM s GROUP BY 1, 2")
def inventory_stats(spark, sf_dir):
    return snapshots.statistics(_inventory(spark, sf_dir))


_NAME = r"""(?i)\b(?:[A-Za-z0-9]+[_-])*(?:api[_-]?key|secret|token|passw(?:or)?d|credential|authorization)(?:[_-][A-Za-z0-9]+)*\b[''"]?\s*[:=]\s*"""
_REDACT = "text"
for _p in text.SECRET_SHAPES:
    _REDACT = f"regexp_replace({_REDACT}, '{_p}', '[REDACTED]', 'g')"
for _quote in ('"', "''"):
    _REDACT = f"regexp_replace({_REDACT}, '{_NAME.replace('(?i)', '(?i)(')}){_quote}[^''\"\\n]{{8,}}{_quote}', '\\1{_quote}[REDACTED]{_quote}', 'g')"


@query(
    "redact_secrets",
    rf"""WITH r AS (SELECT doc_id, text, {_REDACT} AS t FROM documents),
m AS (SELECT *, regexp_extract_all(t, '{_NAME}[A-Za-z0-9_./+=-]{{8,}}') AS found FROM r),
v AS (SELECT *, list_transform(found, lambda x: regexp_extract(x, '[:=]\s*([A-Za-z0-9_./+=-]{{8,}})$', 1)) AS vals FROM m),
w AS (SELECT doc_id, text, list_reduce(list_prepend(t, list_filter(found, lambda x, i: NOT regexp_full_match(vals[i], '[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*'))),
  lambda acc, x: replace(acc, x, regexp_replace(x, '[A-Za-z0-9_./+=-]{{8,}}$', '[REDACTED]'))) AS t FROM v)
SELECT doc_id, md5(t) AS digest FROM w WHERE t <> text""",
)
def redact_secrets(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", text.redact(F.col("text")).alias("t"))
    return rows.where("t != text").select("doc_id", F.md5("t").alias("digest"))


@query("secret_marker_scan", r"SELECT doc_id, regexp_matches(coalesce(text, ''), '-----BEGIN [A-Z ]*PRIVATE KEY-----|\bAKIA[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36,}\b|\bsk-[A-Za-z0-9_-]{20,}\b') AS secret FROM documents")
def secret_marker_scan(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.has_secret(F.coalesce("text", F.lit(""))).alias("secret"))


@query("camel_split_terms", r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(url, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '_', ' ', 'g'), '\s+', ' ', 'g')) AS terms FROM pages")
def camel_split_terms(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.camel_terms(F.col("url")).alias("terms"))


@query("query_terms", r"SELECT item_id, array_to_string((list_distinct_ordered)[1:32], ' ') AS terms FROM (SELECT item_id, list_filter(t, lambda x, i: list_position(t, x) = i) AS list_distinct_ordered FROM (SELECT item_id, regexp_extract_all(text, '[a-zA-Z0-9_]+') AS t FROM benchmark))")
def query_terms(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(text.query_terms(F.col("text")), " ").alias("terms"))


@query("keywords", "SELECT conv_id, turn, array_to_string(list_filter(regexp_extract_all(text, '[a-zA-Z0-9_]+'), lambda w: lower(w) NOT IN (" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + ")), ' ') AS words FROM conversations")
def keywords(spark, sf_dir):
    words = F.regexp_extract_all(F.col("text"), F.lit("[a-zA-Z0-9_]+"), F.lit(0))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(text.without_stop_words(words), " ").alias("words"))


@query("line_spans", r"SELECT doc_id, array_to_string((string_split(coalesce(text, ''), chr(10)))[2:4], chr(10)) AS span, len(string_split((coalesce(text, ''))[1:200], chr(10))) AS line FROM documents")
def line_spans(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", text.lines(t, F.lit(2), F.lit(4)).alias("span"), text.line_of(t, F.lit(200)).cast("long").alias("line"))


@query("entity_ids", """SELECT n_nationkey, 'File:' || sha256('["' || n_nationkey || '", "' || n_name || '"]') AS file_id, substr(sha256(n_name), 1, 24) AS repository_id FROM nation""")
def entity_ids(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    return nation.select("n_nationkey", identity.file_id(F.col("n_nationkey"), F.col("n_name")).alias("file_id"), identity.repository_id(F.col("n_name")).alias("repository_id"))


@query(
    "uuid5_ids",
    """WITH h AS (SELECT doc_id, sha1(unhex('a3f1b2c4d5e67890abcdef1234567890') || encode('repo::' || source || '::' || doc_id)) AS h, sha256(source || doc_id) AS v FROM documents)
SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || substr(h, 17, 1))::INTEGER & 3) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS chunk_id,
       (('0x' || substr(v, 1, 8))::BIGINT & 2147483647) * 4294967296 + ('0x' || substr(v, 9, 8))::BIGINT AS vector_id FROM h""",
)
def uuid5_ids(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    key = F.col("doc_id").cast("string")
    return docs.select("doc_id", identity.chunk_id(F.lit("repo"), F.col("source"), key).alias("chunk_id"), identity.vector_id(F.concat("source", key)).alias("vector_id"))


# ── graph ─────────────────────────────────────────────────────────────────────────────────────────────────────────

_EDGES = """
WITH RECURSIVE edges AS (SELECT 's' || l_suppkey AS source, 'p' || l_partkey AS target, l_orderkey * 10 + l_linenumber AS id FROM lineitem)"""
#: Suppliers call parts, parts call orders, orders call customers.
_CHAIN = """
WITH RECURSIVE edges AS (
  SELECT DISTINCT 's' || l_suppkey AS source, 'p' || l_partkey AS target FROM lineitem
  UNION SELECT DISTINCT 'p' || l_partkey, 'o' || l_orderkey FROM lineitem
  UNION SELECT DISTINCT 'o' || o_orderkey, 'c' || o_custkey FROM orders)"""


def _call_edges(spark, sf_dir) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    return items.select(name("s", "l_suppkey").alias("source"), name("p", "l_partkey").alias("target"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.lit("CALLS").alias("relationship"), F.lit("resolved").alias("resolution"))


def _chain_edges(spark, sf_dir) -> DataFrame:
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    one = items.select(name("s", "l_suppkey").alias("source"), name("p", "l_partkey").alias("target"))
    two = items.select(name("p", "l_partkey").alias("source"), name("o", "l_orderkey").alias("target"))
    three = orders.select(name("o", "o_orderkey").alias("source"), name("c", "o_custkey").alias("target"))
    return one.union(two).union(three).distinct()


@query("callers_1hop", _EDGES + " SELECT source, target, id FROM edges WHERE target IN ('p7', 'p11')")
def callers_1hop(spark, sf_dir):
    wanted = spark.createDataFrame([("p7",), ("p11",)], "id string")
    return graph.callers(_call_edges(spark, sf_dir), wanted).select("source", "target", "id")


@query("callees_1hop", _EDGES + " SELECT source, target, id FROM edges WHERE source IN ('s3', 's5')")
def callees_1hop(spark, sf_dir):
    wanted = spark.createDataFrame([("s3",), ("s5",)], "id string")
    return graph.callees(_call_edges(spark, sf_dir), wanted).select("source", "target", "id")


@query(
    "impact_bfs_3",
    _CHAIN + """, walk AS (
  SELECT source AS id, 1 AS depth FROM edges WHERE target IN ('c1', 'c2', 'c4', 'c5')
  UNION SELECT e.source, w.depth + 1 FROM walk w JOIN edges e ON e.target = w.id WHERE w.depth < 3)
SELECT id, min(depth)::INTEGER AS depth FROM walk WHERE id NOT IN ('c1', 'c2', 'c4', 'c5') GROUP BY id""",
)
def impact_bfs_3(spark, sf_dir):
    seeds = spark.createDataFrame([("c1",), ("c2",), ("c4",), ("c5",)], "id string")
    return graph.reach(_chain_edges(spark, sf_dir), seeds, 3).select("id", "depth")


@query(
    "affected_closure",
    _CHAIN + """, walk AS (SELECT 'c7' AS id UNION SELECT e.source FROM walk w JOIN edges e ON e.target = w.id) SELECT id FROM walk""",
)
def affected_closure(spark, sf_dir):
    return graph.closure(_chain_edges(spark, sf_dir), spark.createDataFrame([("c7",)], "id string"))


_RING = """
WITH RECURSIVE edges AS (
  SELECT (n_nationkey * 10 + k)::BIGINT AS id, n_nationkey::BIGINT AS source, ((n_nationkey * (k + 1) + k) % 25)::BIGINT AS target FROM nation, unnest([1, 2, 3]) AS u(k))"""


@query(
    "paths_bounded",
    _RING + """, walk AS (
  SELECT [0::BIGINT] AS nodes, []::BIGINT[] AS way, 0::BIGINT AS place
  UNION ALL SELECT list_append(nodes, target), list_append(way, edges.id), target FROM walk JOIN edges ON source = place
  WHERE NOT list_contains(nodes, target) AND len(way) < 4 AND place <> 7)
SELECT array_to_string(way, '>') AS path, len(way)::INTEGER AS hops FROM walk WHERE place = 7""",
)
def paths_bounded(spark, sf_dir):
    k = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))
    n = F.col("n_nationkey").cast("long")
    edges = table(spark, sf_dir, "nation").withColumn("k", k).select((n * 10 + F.col("k")).alias("id"), n.alias("source"), ((n * (F.col("k") + 1) + F.col("k")) % 25).alias("target"))
    one = lambda x: spark.createDataFrame([(x,)], "id long")
    found, _ = graph.paths(edges, one(0), one(7), 4, 1000, 50_000)
    return found.select(F.array_join(F.transform("edges", lambda e: e.cast("string")), ">").alias("path"), F.size("edges").alias("hops"))


@query("graph_stats", _EDGES + " SELECT (SELECT count(*) FROM (SELECT source FROM edges UNION SELECT target FROM edges)) AS nodes, count(*) AS edges, count(*) AS resolved, 0::BIGINT AS inferred, 0::BIGINT AS unresolved FROM edges")
def graph_stats(spark, sf_dir):
    edges = _call_edges(spark, sf_dir)
    return graph.statistics(edges, edges.select("source").union(edges.select("target")).distinct())


@query("edge_histogram", "SELECT coalesce(CASE WHEN event_type <> 'error' THEN event_type END, 'unknown') AS kind, count(*) AS n FROM events GROUP BY 1")
def edge_histogram(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("kind", F.expr("CASE WHEN event_type != 'error' THEN event_type END"))
    return graph.histogram(rows, "kind")


@query("test_references", "SELECT o_orderkey AS id FROM orders WHERE o_orderpriority LIKE '1%' AND o_custkey = (SELECT min(o_custkey) FROM orders) ORDER BY 1 LIMIT 25")
def test_references(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    first = orders.agg(F.min("o_custkey").alias("id"))
    path = F.when(F.col("o_orderpriority").startswith("1"), "src/tests/a.js").otherwise("src/attest/a.js")
    edges = orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("target"), F.lit("resolved").alias("resolution"), F.lit("CALLS").alias("relationship"), path.alias("evidence_file"), F.lit(1).alias("evidence_line"))
    return graph.test_references(edges, first, 25)[0].select("id")


@query("last_edge_wins", "SELECT l_suppkey, l_partkey, max(l_orderkey * 10 + l_linenumber) AS seq FROM lineitem GROUP BY 1, 2")
def last_edge_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return graph.last_wins(rows, ["l_suppkey", "l_partkey"], "seq")


@query("contains_edges", """
WITH u AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '^https?://', ''), '\\?.*$', '') AS path FROM pages),
p AS (SELECT string_split(path, '/') AS x FROM u)
SELECT DISTINCT CASE WHEN i = 1 THEN '.' ELSE array_to_string(x[1:i - 1], '/') END AS source, array_to_string(x[1:i], '/') AS target, 'CONTAINS' AS relationship
FROM (SELECT x, unnest(range(1, len(x) + 1)) AS i FROM p)""")
def contains_edges(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), r"\?.*$", "")
    return graph.contains_edges(table(spark, sf_dir, "pages").select(path.alias("path")).distinct())


@query("resolve_calls", """
WITH n AS (SELECT p_brand || ':' || p_name AS id, p_name AS name FROM part),
u AS (SELECT name, min(id) AS sole FROM n GROUP BY name HAVING count(*) = 1)
SELECT e_id AS source, coalesce((SELECT min(id) FROM n WHERE id = file || ':' || called), sole, called) AS target
FROM (SELECT p_partkey AS e_id, p_brand AS file, (SELECT p_name FROM part q WHERE q.p_partkey = part.p_partkey % 97 + 1) AS called FROM part) LEFT JOIN u ON u.name = called""")
def resolve_calls(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    nodes = part.select(F.concat_ws(":", "p_brand", "p_name").alias("id"), F.col("p_name").alias("name"), F.lit("function").alias("kind"))
    called = part.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"))
    calls = part.select(F.col("p_partkey").alias("source"), F.col("p_brand").alias("file"), (F.col("p_partkey") % 97 + 1).alias("k")).join(called, "k").select("source", "file", "name")
    return graph.resolve_calls(calls, nodes)


@query("resolve_imports", """
SELECT c_custkey AS source, CASE WHEN s_name IS NOT NULL THEN s_name WHEN c_mktsegment <> 'BUILDING' THEN 'external:' || c_mktsegment END AS target, r AS relationship,
  CASE WHEN s_name IS NOT NULL THEN 'resolved' WHEN c_mktsegment <> 'BUILDING' THEN 'inferred' ELSE 'unresolved' END AS resolution
FROM (SELECT c_custkey, c_mktsegment, s_name, unnest(CASE WHEN s_name IS NOT NULL THEN ['IMPORTS', 'DEPENDS_ON'] ELSE ['IMPORTS'] END) AS r
      FROM customer LEFT JOIN (SELECT DISTINCT s_name FROM supplier) ON s_name = 'Supplier#' || lpad(c_custkey::VARCHAR, 9, '0'))""")
def resolve_imports(spark, sf_dir):
    wanted = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source"), F.col("c_mktsegment").alias("specifier"), F.concat(F.lit("Supplier#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("resolved_path"))
    files = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("path")).distinct()
    return graph.resolve_imports(wanted, files, ["BUILDING"])


# ── ranges ────────────────────────────────────────────────────────────────────────────────────────────────────────

_SPANS = """
WITH s AS (SELECT event_id AS id, user_id AS file_id, (event_id % 50) AS a, (event_id % 50) + 1 + (event_id * 7) % 40 AS b FROM events WHERE event_type <> 'view'),
p AS (SELECT event_id AS point_id, user_id AS file_id, (event_id * 3) % 90 AS x FROM events WHERE event_type = 'view')"""


def _spans(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    a = F.col("event_id") % 50
    spans = e.where("event_type != 'view'").select(F.col("event_id").alias("id"), F.col("user_id").alias("file_id"), a.alias("start_byte"), (a + 1 + (F.col("event_id") * 7) % 40).alias("end_byte"))
    points = e.where("event_type = 'view'").select(F.col("event_id").alias("point_id"), F.col("user_id").alias("file_id"), ((F.col("event_id") * 3) % 90).alias("offset"))
    return points, spans


@query("innermost_enclosing", _SPANS + """
SELECT point_id, coalesce(e, -1) AS enclosing FROM (SELECT point_id, (SELECT id FROM s WHERE s.file_id = p.file_id AND a <= x AND x < b ORDER BY b - a, id LIMIT 1) AS e FROM p)""")
def innermost_enclosing(spark, sf_dir):
    points, spans = _spans(spark, sf_dir)
    return ranges.innermost(points, spans).select("point_id", F.coalesce("enclosing", F.lit(-1)).alias("enclosing"))


@query("chunk_to_symbol", _SPANS + """,
m AS (SELECT p.point_id, s.id, s.a, s.b FROM p JOIN s ON s.file_id = p.file_id AND s.a <= p.x + 5 AND s.b >= p.x),
f AS (SELECT *, first_value(a) OVER w AS fa, first_value(b) OVER w AS fb, first_value(id) OVER w AS fid FROM m WINDOW w AS (PARTITION BY point_id ORDER BY b - a, a, id)),
v AS (SELECT point_id, any_value(fid) AS symbol_id FROM f GROUP BY point_id HAVING bool_and(a <= fa AND b >= fb))
SELECT p.point_id, coalesce(v.symbol_id, -1) AS symbol_id FROM p LEFT JOIN v USING (point_id)""")
def chunk_to_symbol(spark, sf_dir):
    points, spans = _spans(spark, sf_dir)
    chunks = points.select(F.col("point_id").alias("id"), "file_id", F.col("offset").alias("start_line"), (F.col("offset") + 5).alias("end_line"))
    symbols = spans.select("file_id", "id", F.col("start_byte").alias("start_line"), F.col("end_byte").alias("end_line"))
    return ranges.most_specific(chunks, symbols).select(F.col("id").alias("point_id"), F.coalesce("symbol_id", F.lit(-1)).alias("symbol_id"))


@query("unique_target_bind", """
WITH t AS (SELECT l_orderkey AS o_orderkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1)
SELECT o_orderkey, coalesce(l_suppkey, -1) AS l_suppkey FROM orders LEFT JOIN t USING (o_orderkey)""")
def unique_target_bind(spark, sf_dir):
    targets = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    return ranges.unique_targets(table(spark, sf_dir, "orders").select("o_orderkey"), targets, ["o_orderkey"], "l_suppkey").select("o_orderkey", F.coalesce("l_suppkey", F.lit(-1)).alias("l_suppkey"))


@query("hit_callers", _SPANS + """
SELECT p.point_id, array_to_string(list_sort(list(DISTINCT e.user_id)) , ',') AS callers FROM p
JOIN s ON s.file_id = p.file_id AND s.a <= p.x + 3 AND s.b >= p.x JOIN events e ON e.event_id = s.id + 1 GROUP BY p.point_id""")
def hit_callers(spark, sf_dir):
    points, spans = _spans(spark, sf_dir)
    hits = points.select(F.col("point_id").alias("hit_id"), "file_id", F.col("offset").alias("start_line"), (F.col("offset") + 3).alias("end_line"))
    symbols = spans.select("file_id", "id", F.col("start_byte").alias("start_line"), F.col("end_byte").alias("end_line"))
    calls = table(spark, sf_dir, "events").select((F.col("event_id") - 1).alias("target"), F.col("user_id").alias("source"))
    found = ranges.with_callers(hits, symbols, calls).where("graph_verified")
    return found.select(F.col("hit_id").alias("point_id"), F.array_join(F.transform("callers", lambda c: c.cast("string")), ",").alias("callers"))


# ── snapshots ─────────────────────────────────────────────────────────────────────────────────────────────────────

_GENERATIONS = """
WITH old AS (SELECT o_orderkey AS k, md5(o_orderstatus) AS h FROM orders WHERE o_orderkey % 10 <> 3),
new AS (SELECT o_orderkey AS k, md5(CASE WHEN o_orderkey % 7 = 0 THEN o_orderpriority ELSE o_orderstatus END) AS h FROM orders WHERE o_orderkey % 10 <> 4)"""


def _generations(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    old = o.where("o_orderkey % 10 != 3").select(F.col("o_orderkey").alias("k"), F.md5("o_orderstatus").alias("h"))
    new = o.where("o_orderkey % 10 != 4").select(F.col("o_orderkey").alias("k"), F.md5(F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderpriority")).otherwise(F.col("o_orderstatus"))).alias("h"))
    return old, new


@query("snapshot_diff", _GENERATIONS + " SELECT coalesce(old.k, new.k) AS k, CASE WHEN old.k IS NULL THEN 'added' WHEN new.k IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM old FULL JOIN new ON old.k = new.k WHERE old.h IS DISTINCT FROM new.h")
def snapshot_diff(spark, sf_dir):
    return snapshots.difference(*_generations(spark, sf_dir), "k", "h")


@query("snapshot_merge", _GENERATIONS + " SELECT new.k::VARCHAR AS path, new.h AS content_sha256, CASE WHEN old.h = new.h THEN 'parsed' ELSE 'pending' END AS parse_status FROM new LEFT JOIN old USING (k)")
def snapshot_merge(spark, sf_dir):
    old, new = _generations(spark, sf_dir)
    shape = lambda d: d.select(F.col("k").cast("string").alias("path"), F.col("h").alias("content_sha256"))
    return snapshots.merged(shape(old).withColumn("parse_status", F.lit("parsed")), shape(new))


@query("audit_orphans", """SELECT 'order_of_item' AS "check", count(*) AS violations FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')
UNION ALL SELECT 'customer_of_order', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def audit_orphans(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    return snapshots.audit({"order_of_item": (t("lineitem"), t("orders").where("o_orderstatus != 'F'"), "l_orderkey", "o_orderkey"), "customer_of_order": (t("orders"), t("customer"), "o_custkey", "c_custkey")})


@query("stale_rows", _GENERATIONS + " SELECT k::VARCHAR AS path FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.k = old.k AND new.h = old.h)")
def stale_rows(spark, sf_dir):
    old, new = _generations(spark, sf_dir)
    rows = old.select(F.col("k").cast("string").alias("path"), F.col("h").alias("source_hash"))
    files = new.select(F.col("k").cast("string").alias("path"), F.col("h").alias("content_sha256"))
    return filters.stale(rows, files).select("path")


@query("dedupe_embedding_hash", "SELECT sha256(text) AS embedding_hash, min(doc_id) AS id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'de') GROUP BY 1")
def dedupe_embedding_hash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", F.sha2("text", 256).alias("embedding_hash"))
    return snapshots.to_embed(docs.drop("lang"), docs.where("lang = 'de'"))


# ── metrics and evidence ──────────────────────────────────────────────────────────────────────────────────────────


@query("set_precision_recall", """
WITH e AS (SELECT doc_id FROM labels WHERE quality = 1), a AS (SELECT doc_id FROM documents WHERE n_chars > 800)
SELECT (SELECT count(*) FROM e JOIN a USING (doc_id)) / greatest((SELECT count(*) FROM a), 1)::DOUBLE AS precision,
       (SELECT count(*) FROM e JOIN a USING (doc_id)) / greatest((SELECT count(*) FROM e), 1)::DOUBLE AS recall,
       (SELECT count(*) FROM e ANTI JOIN a USING (doc_id)) AS missing, (SELECT count(*) FROM a ANTI JOIN e USING (doc_id)) AS unexpected""")
def set_precision_recall(spark, sf_dir):
    expected = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return metrics.precision_recall(expected, table(spark, sf_dir, "documents").where("n_chars > 800").select("doc_id"), "doc_id")


_RANKS = "SELECT d.source AS query_id, row_number() OVER (PARTITION BY d.source ORDER BY n_chars DESC, d.doc_id) AS rank, coalesce(toxic, 0) = 1 AS relevant FROM documents d LEFT JOIN labels USING (doc_id)"


@query("recall_mrr", f"SELECT avg((f IS NOT NULL)::INTEGER) AS recall, round(avg(coalesce(1.0 / f, 0)), 9) AS mrr FROM (SELECT query_id, min(rank) FILTER (relevant AND rank <= 5) AS f FROM ({_RANKS}) GROUP BY 1)")
def recall_mrr(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    ranks = rows.select(F.col("source").alias("query_id"), rank.alias("rank"), (F.coalesce("toxic", F.lit(0)) == 1).alias("relevant"))
    return metrics.recall_mrr(ranks).select("recall", F.round("mrr", 9).alias("mrr"))


@query("nearest_rank_percentile", "SELECT event_type, l[greatest(ceil(len(l) * 0.5), 1)::BIGINT] AS p50, l[greatest(ceil(len(l) * 0.95), 1)::BIGINT] AS p95 FROM (SELECT event_type, list_sort(list(value)) AS l FROM events WHERE value IS NOT NULL GROUP BY 1)")
def nearest_rank_percentile(spark, sf_dir):
    return metrics.nearest_rank(table(spark, sf_dir, "events"), F.col("value"), {"p50": 0.5, "p95": 0.95}, ["event_type"])


@query("category_accuracy", "SELECT source, count(*) AS n, avg((quality = 1 AND n_chars > 500)::INTEGER) AS accuracy FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def category_accuracy(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return metrics.accuracy(rows, "source", (F.col("quality") == 1) & (F.col("n_chars") > 500))


@query("repeated_names", "SELECT p_name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, p_name LIMIT 8")
def repeated_names(spark, sf_dir):
    return metrics.repeated_names(table(spark, sf_dir, "part"), "p_name")


@query("fair_admission", "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) ORDER BY rn, conv_id LIMIT 60")
def fair_admission(spark, sf_dir):
    return evidence.admitted(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], 60).select("conv_id", "turn")


@query("evidence_quarantine", """
WITH links AS (SELECT l_partkey || '-' || l_suppkey AS claim, l_orderkey AS e FROM lineitem), bad AS (SELECT o_orderkey AS e FROM orders WHERE o_orderstatus = 'F')
SELECT DISTINCT claim FROM links WHERE claim NOT IN (SELECT claim FROM links JOIN bad USING (e))""")
def evidence_quarantine(spark, sf_dir):
    """Claims are pairs of part and supplier; the orders that hold them are their evidence."""
    claim = F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    links = table(spark, sf_dir, "lineitem").select(claim.alias("claim"), F.col("l_orderkey").alias("evidence"))
    bad = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("evidence"))
    return evidence.quarantined(links, bad).select("claim").distinct()


@query("claim_classes", """
SELECT event_id, CASE WHEN event_type IN ('error') THEN 'unresolved_assertion' WHEN event_type = 'signup' THEN 'hypothetical_consequence' WHEN event_type = 'purchase' THEN 'derived_analysis'
  WHEN user_id % 2 = 0 THEN 'verified_graph_relationship' ELSE 'verified_source_observation' END AS claim_class FROM events""")
def claim_classes(spark, sf_dir):
    kind = F.when(F.col("event_type") == "error", "candidate").when(F.col("event_type") == "signup", "possible_impact").otherwise("direct")
    rows = table(spark, sf_dir, "events").select("event_id", kind.alias("category"), F.when(F.col("event_type") == "purchase", "derived_finding").otherwise("observation").alias("classification"), (F.col("user_id") % 2 == 0).alias("has_edge"))
    return rows.select("event_id", evidence.claim_class(F.lit("rule"), F.col("category"), F.col("classification"), F.col("has_edge")).alias("claim_class"))


@query("requirement_coverage", """
SELECT user_id, CASE WHEN bool_and(event_type <> 'error') THEN 'complete' WHEN bool_or(event_type <> 'error') THEN 'partial' ELSE 'missing' END AS coverage, count(*) FILTER (event_type <> 'error') AS findings FROM events GROUP BY 1""")
def requirement_coverage(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"))
    return evidence.coverage(rows, "user_id")


@query("dependency_summary", _CHAIN + """
SELECT 'incoming' AS category, source, target FROM edges WHERE target = 'p7' UNION ALL SELECT 'outgoing', source, target FROM edges WHERE source = 'p7'""")
def dependency_summary(spark, sf_dir):
    edges = _chain_edges(spark, sf_dir).withColumns({"relationship": F.lit("CALLS"), "resolution": F.lit("resolved")})
    return rules.dependency_summary(edges, spark.createDataFrame([("p7",)], "id string")).select("category", "source", "target")


@query("change_impact", _CHAIN + """, walk AS (
  SELECT source AS id, 1 AS depth FROM edges WHERE target = 'c4' UNION SELECT e.source, w.depth + 1 FROM walk w JOIN edges e ON e.target = w.id WHERE w.depth < 3)
SELECT CASE WHEN d = 1 THEN 'direct_impact' ELSE 'possible_impact' END AS category, id, d::INTEGER AS depth FROM (SELECT id, min(depth) AS d FROM walk GROUP BY id)""")
def change_impact(spark, sf_dir):
    edges = _chain_edges(spark, sf_dir).withColumns({"relationship": F.lit("CALLS"), "resolution": F.lit("resolved")})
    return rules.change_impact(edges, spark.createDataFrame([("c4",)], "id string"), 3)


# ── understanding, documentation, streams ─────────────────────────────────────────────────────────────────────────


@query("chat_intent", f"""
WITH n AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '[.!?]+$', '')) AS m, text FROM
 (SELECT conv_id, turn, text FROM conversations UNION ALL SELECT -1 - i, 0, t FROM (SELECT unnest({list(understanding.EXAMPLES)}) AS t, generate_subscripts({list(understanding.EXAMPLES)}, 1) AS i)))
SELECT conv_id, turn, CASE WHEN length(text) > 2000 THEN NULL {" ".join(f"WHEN regexp_full_match(m, '(?i){p.replace(chr(39), chr(39) * 2)}') THEN '{k}'" for k, p in understanding.CHAT.items())} END AS intent FROM n""")
def chat_intent(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    more = spark.createDataFrame([(-2 - i, 0, t) for i, t in enumerate(understanding.EXAMPLES)], "conv_id long, turn long, text string")
    return rows.unionByName(more).select("conv_id", "turn", understanding.chat_intent(F.col("text")).alias("intent"))


@query("docs_overview", "SELECT source, count(*) AS documents, sum(n_chars)::BIGINT AS chars, string_agg(DISTINCT lang, ',' ORDER BY lang) AS languages, min(doc_id) AS first FROM documents GROUP BY source")
def docs_overview(spark, sf_dir):
    return documentation.overview(table(spark, sf_dir, "documents"))


@query("debounce_sessions", """
WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 5 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, count(*) AS changes, max(event_id) AS last_event FROM s GROUP BY user_id, n""")
def debounce_sessions(spark, sf_dir):
    return change_events.debounced(table(spark, sf_dir, "events"), "5 minutes").select("user_id", "changes", "last_event")


_CHUNKS = r"""
WITH RECURSIVE d AS (SELECT doc_id, source || '/' || doc_id || '.md' AS path, text FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM d),
pos AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM l),
heads AS (SELECT doc_id, a FROM pos WHERE regexp_matches(line || chr(10), '^#{1,6}\s') UNION SELECT doc_id, 0 FROM d),
s AS (SELECT h.doc_id, h.a::BIGINT AS a, coalesce(lead(h.a) OVER (PARTITION BY h.doc_id ORDER BY h.a), length(d.text))::BIGINT AS b FROM heads h JOIN d USING (doc_id)),
k AS (SELECT s.doc_id, path, text, a, b, trim(string_split(substr(text, a + 1, b - a), chr(10))[1], ' ' || chr(9) || chr(13)) AS label FROM s JOIN d USING (doc_id) WHERE b > a),
w AS (
  SELECT doc_id, a, b, a AS start, CASE WHEN a + 1200 >= b THEN b ELSE coalesce(cut, a + 1200) END AS stop
  FROM (SELECT *, CASE WHEN strpos(reverse(substr(text, a + 601, 600)), chr(10)) > 0 THEN a + 600 + 601 - strpos(reverse(substr(text, a + 601, 600)), chr(10)) END AS cut FROM k)
  UNION ALL
  SELECT doc_id, a, b, start, CASE WHEN start + 1200 >= b THEN b ELSE coalesce(cut, start + 1200) END
  FROM (SELECT v.*, CASE WHEN strpos(reverse(substr(text, v.start + 601, 600)), chr(10)) > 0 THEN v.start + 600 + 601 - strpos(reverse(substr(text, v.start + 601, 600)), chr(10)) END AS cut
        FROM (SELECT doc_id, a, b, greatest(start + 1, stop - 150) AS start FROM w WHERE stop < b) v JOIN d USING (doc_id))
),
t AS (SELECT w.*, path, label, text, substr(text, start + 1, stop - start) AS piece FROM w JOIN k USING (doc_id, a, b)),
u AS (SELECT *, regexp_replace(piece, '^\s+', '') AS tail, regexp_replace(regexp_replace(piece, '^\s+', ''), '\s+$', '') AS body FROM t),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, a ORDER BY start) - 1 AS ordinal, start + length(piece) - length(tail) AS f FROM u WHERE length(body) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label, ordinal ORDER BY a) - 1 AS again FROM o),
h AS (SELECT *, sha1(unhex('a3f1b2c4d5e67890abcdef1234567890') || encode('repo::' || path || '::section:' || label || '::' || ordinal || '::' || again)) AS h,
  (length(substr(text, 1, f)) - length(replace(substr(text, 1, f), chr(10), '')) + 1)::INTEGER AS start_line,
  (length(substr(text, 1, f + length(body) - 1)) - length(replace(substr(text, 1, f + length(body) - 1), chr(10), '')) + 1)::INTEGER AS end_line FROM r),
c AS (SELECT *, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || substr(h, 17, 1))::INTEGER & 3) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS chunk_id FROM h)
SELECT path, (row_number() OVER (PARTITION BY path ORDER BY start_line, end_line, chunk_id) - 1)::INTEGER AS chunk_index, chunk_id, 'documentation' AS kind, start_line, end_line,
  label AS name, label AS qualified_name, '' AS signature, '' AS comments, body AS text FROM c"""


@query("chunk_windows", _CHUNKS)
def chunk_windows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "text")
    return chunking.chunked(docs, "repo")


# ── further predicates, projections and joins ─────────────────────────────────────────────────────────────────────

_PATHS = "SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '\\?.*$', '') || CASE page_id % 4 WHEN 0 THEN '.test.js' WHEN 1 THEN '/docs/a.md' WHEN 2 THEN '/tests/b.py' ELSE '/c.ts' END AS path FROM pages"


def _paths(spark, sf_dir) -> DataFrame:
    bare = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), r"\?.*$", "")
    k = F.col("page_id") % 4
    end = F.when(k == 0, ".test.js").when(k == 1, "/docs/a.md").when(k == 2, "/tests/b.py").otherwise("/c.ts")
    return table(spark, sf_dir, "pages").select("page_id", F.concat(bare, end).alias("path"))


@query("path_predicates", f"""SELECT page_id, path = 'docs/a.md' OR ends_with(path, '/docs/a.md') AS scoped,
  regexp_matches(path, '(^|/)(tests?|__tests__)/|\\.(test|spec)\\.|(^|/)test_') AS is_test,
  regexp_matches(lower(path), '\\.(md|markdown)$|(^|/)(tests|test|__tests__)(/|$)') AS demoted,
  regexp_extract(path, '[^/]*$') IN ('c', 'c.ts') OR regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^./]*$', '') = 'c' AS of_module FROM ({_PATHS})""")
def path_predicates(spark, sf_dir):
    p = F.col("path")
    return _paths(spark, sf_dir).select("page_id", filters.in_scope(p, "docs/a.md").alias("scoped"), filters.is_test_path(p).alias("is_test"), filters.is_document_or_test(p).alias("demoted"), filters.names_module(p, "c").alias("of_module"))


@query("relative_paths", f"SELECT page_id, NOT list_has_any(string_split(p, '/'), ['', '.', '..']) AS ok FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '/' || path WHEN page_id % 3 = 1 THEN path ELSE 'a/../' || path END AS p FROM ({_PATHS}))")
def relative_paths(spark, sf_dir):
    k = F.col("page_id") % 3
    p = F.when(k == 0, F.concat(F.lit("/"), "path")).when(k == 1, F.col("path")).otherwise(F.concat(F.lit("a/../"), "path"))
    return _paths(spark, sf_dir).select("page_id", identity.is_relative_path(p).alias("ok"))


@query("sensitive_names", f"SELECT page_id, regexp_extract(p, '[^/]*$') IN ('.env', 'id_rsa') OR regexp_matches(lower(regexp_extract(p, '[^/]*$')), '^(\\.env\\..*|service-account.*\\.json|.*\\.(pem|key|p12|pfx|jks|keystore))$') AS sensitive FROM (SELECT page_id, path || CASE page_id % 5 WHEN 0 THEN '/.env' WHEN 1 THEN '/id_rsa' WHEN 2 THEN '/a.PEM' WHEN 3 THEN '/service-account-1.json' ELSE '.x' END AS p FROM ({_PATHS}))")
def sensitive_names(spark, sf_dir):
    from graphquarry.sources import inventory

    k = F.col("page_id") % 5
    end = F.when(k == 0, "/.env").when(k == 1, "/id_rsa").when(k == 2, "/a.PEM").when(k == 3, "/service-account-1.json").otherwise(".x")
    return _paths(spark, sf_dir).select("page_id", inventory.is_sensitive(F.concat("path", end)).alias("sensitive"))


@query("declared_symbols", _SPANS + """,
d AS (SELECT point_id, file_id, x AS d_start, x + 4 AS d_end FROM p),
m AS (SELECT point_id, id, abs(a - d_start) + abs(b - d_end) AS far, b - a AS wide FROM d JOIN s USING (file_id) WHERE (a <= d_start AND d_end <= b) OR (d_start <= a AND b <= d_end))
SELECT point_id, id AS symbol_id FROM m QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY far, wide, id) = 1""")
def declared_symbols(spark, sf_dir):
    points, spans = _spans(spark, sf_dir)
    d = points.select("point_id", "file_id", F.lit("n").alias("name"), F.col("offset").alias("d_start"), (F.col("offset") + 4).alias("d_end"))
    return ranges.declared(d, spans.withColumn("name", F.lit("n"))).select("point_id", "symbol_id")


@query("unparsed_files", _GENERATIONS + " SELECT k::VARCHAR AS path FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.k = new.k AND old.h = new.h AND old.k % 2 = 0)")
def unparsed_files(spark, sf_dir):
    old, new = _generations(spark, sf_dir)
    shape = lambda d: d.select(F.col("k").cast("string").alias("path"), F.col("h").alias("content_sha256"))
    state = F.when(F.col("path").cast("long") % 2 == 0, "ready").otherwise("building")
    return snapshots.unparsed(shape(new), shape(old).withColumn("state", state)).select("path")


@query("payload_agreement", _GENERATIONS + " SELECT new.k FROM old JOIN new ON old.k = new.k AND old.h IS NOT DISTINCT FROM new.h")
def payload_agreement(spark, sf_dir):
    old, new = _generations(spark, sf_dir)
    return old.alias("a").join(new.alias("b"), filters.agrees("a", "b", ["k", "h"])).select(F.col("b.k").alias("k"))


@query("scroll_page", "SELECT vec_id, label FROM embeddings WHERE vec_id >= 50 ORDER BY vec_id LIMIT 20")
def scroll_page(spark, sf_dir):
    from graphquarry.sources import vector_journal

    journal = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("vector_id"), "label")
    return vector_journal.scroll(journal, 20, 50)[0].withColumnRenamed("vector_id", "vec_id")


@query("depth_caps", "SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) <= 8")
def depth_caps(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id"))
    return table(spark, sf_dir, "events").withColumn("n", n).where("n <= 8").select("event_type", "event_id")


@query("symbols_and_relationships", "SELECT s_name AS name FROM supplier UNION SELECT 'Supplier#' || lpad(l_suppkey::VARCHAR, 9, '0') FROM lineitem")
def symbols_and_relationships(spark, sf_dir):
    named = F.concat(F.lit("Supplier#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0"))
    return table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name")).union(table(spark, sf_dir, "lineitem").select(named)).distinct()


@query("embedding_texts", """SELECT p_partkey, md5('File: ' || p_brand || chr(10) || 'Language: ' || p_type || chr(10) || 'Symbol: ' || p_name || chr(10) || 'Kind: part' || chr(10) || 'Signature: ' || chr(10) || 'Meaning terms: ' || trim(regexp_replace(regexp_replace(regexp_replace(p_name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '_', ' ', 'g'), '\\s+', ' ', 'g')) || chr(10) || 'Comments: ' || p_type || chr(10) || p_name) AS digest FROM part""")
def embedding_texts(spark, sf_dir):
    c = F.col
    made = text.embedding_text(c("p_brand"), c("p_type"), c("p_name"), F.lit("part"), F.lit(""), c("p_type"), c("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", F.md5(made).alias("digest"))


@query("module_groups", f"SELECT split_part(path, '/', 1) AS module, count(DISTINCT path) AS files, count(*) AS symbols FROM ({_PATHS}) GROUP BY 1")
def module_groups(spark, sf_dir):
    return documentation.modules(_paths(spark, sf_dir))


@query("legacy_nodes", "SELECT CASE WHEN count(*) = 1 THEN min(p_name) ELSE 'none' END AS id FROM part WHERE contains(lower(p_name), (SELECT substr(lower(min(p_name)), 2) FROM part))")
def legacy_nodes(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    needle = part.agg(F.min("p_name")).first()[0].lower()[1:]
    nodes = part.select(F.col("p_name").alias("id"), F.concat(F.lit("x"), "p_name").alias("name"), F.lit("function").alias("kind"))
    found = graph.legacy_node(nodes, needle).select("id")
    return found.unionByName(spark.range(1).select(F.lit("none").alias("id"))).orderBy(F.col("id") == "none").limit(1)


@query("retrieval_plans")
def retrieval_plans(spark, sf_dir):
    """Plans of the questions among the user's turns, in Arrow batches; `invalid` where a turn is no question in bounds."""

    def planned(turn):
        try:
            return understanding.plan_query(turn)
        except ValueError:
            return understanding.RetrievalPlan(turn, "invalid")

    def plans(batches):
        import pandas as pd

        for batch in batches:
            made = [planned(t or "") for t in batch["text"]]
            yield pd.DataFrame({"conv_id": batch["conv_id"], "turn": batch["turn"], "intent": [p.intent for p in made], "reference": [p.reference for p in made], "keywords": [p.keywords for p in made]})

    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    return turns.mapInPandas(plans, "conv_id long, turn long, intent string, reference string, keywords string")


@query("stream_debounce", ORACLES["debounce_sessions"])
def stream_debounce(spark, sf_dir):
    """The bursts of a stream over the same events, each closed by the next one of its key or by its timer."""
    import uuid

    source = table(spark, sf_dir, "events")
    home = f"{graph.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    source.select("event_id", "ts", "user_id").write.parquet(f"{home}/in")
    stream = stream_state.bursts(change_events.file_events(spark, f"{home}/in", "event_id long, ts timestamp, user_id long"), 300_000, quiet_ms=1000)
    return stream_state.run_until_idle(stream, f"{home}/out", f"{home}/state").select("user_id", "changes", "last_event")


@query("stream_jobs", """
WITH p AS (SELECT user_id, event_id, event_type, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS epoch FROM events)
SELECT user_id AS repository, event_id::VARCHAR AS request, (min(event_id) OVER w)::VARCHAR AS job, event_id <> min(event_id) OVER w AS coalesced
FROM p WHERE event_type <> 'purchase' WINDOW w AS (PARTITION BY user_id, epoch)""")
def stream_jobs(spark, sf_dir):
    """Requests of a stream and the jobs that serve them; a purchase completes the job of its user."""
    import uuid

    source = table(spark, sf_dir, "events")
    home = f"{graph.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    ends = F.col("event_type") == "purchase"
    epoch = F.sum(F.when(ends, 1).otherwise(0)).over(Window.partitionBy("user_id").orderBy("event_id"))
    own = source.select("user_id", "event_id", ends.alias("ends"), F.when(ends, epoch - 1).otherwise(epoch).alias("epoch"))
    ended = F.min(F.when(~F.col("ends"), F.col("event_id"))).over(Window.partitionBy("user_id", "epoch"))  # the job that a completion names
    own.select(F.col("user_id").alias("repository"), F.when(F.col("ends"), ended).otherwise(F.col("event_id")).alias("job"), F.when(F.col("ends"), "completed").otherwise("requested").alias("event"), F.col("event_id").alias("at")).write.parquet(f"{home}/in")
    stream = stream_state.queued(change_events.file_events(spark, f"{home}/in", "repository long, job long, event string, at long"))
    return stream_state.run_until_idle(stream, f"{home}/out", f"{home}/state", free=False)
