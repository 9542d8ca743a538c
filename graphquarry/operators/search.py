"""Keyword, vector and literal search, and the fusion of rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphquarry.functions import text as T
from graphquarry.functions import vectors as V

from .graph import cut

RRF_K = 60
MOST_CANDIDATES = 100


def bm25(docs: DataFrame, terms: list[str], id_col: str = "doc_id", fields: dict[str, float] | None = None) -> DataFrame:
    """id, score for documents that hold one of the terms; a term of several tokens is a phrase.

    Each document is tokenised once: its length and the counts of the asked terms, a few numbers, are written to the shared
    folder, and both the corpus statistics (one row) and the hits are read from there.
    """
    fields = fields or {"text": 1.0}
    wanted = [list(p) for p in dict.fromkeys(tuple(T.phrase_of(t)) for t in terms) if p]
    lines = docs.select(F.col(id_col).alias("id"), *(T.token_line(F.col(f)).alias(f"_{k}") for k, f in enumerate(fields)))
    size = sum((T.n_tokens(F.col(f"_{k}")) for k in range(len(fields))), F.lit(0))
    count = lambda p: sum((F.lit(float(w)) * T.n_phrase(F.col(f"_{k}"), p) for k, w in enumerate(fields.values())), F.lit(0.0))
    rows = cut(lines.select("id", size.alias("len"), F.array(*map(count, wanted)).cast("array<double>").alias("tf")))
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"), *(F.count_if(F.get("tf", F.lit(i)) > 0).alias(f"df{i}") for i in range(len(wanted))))
    share = lambda i: F.get("tf", F.lit(i)) * (T.K1 + 1) / (F.get("tf", F.lit(i)) + T.K1 * (1 - T.B + T.B * F.col("len") / F.col("mean")))
    score = sum((idf(F.col("n"), F.col(f"df{i}")) * share(i) for i in range(len(wanted))), F.lit(0.0))
    found = rows.where(F.exists("tf", lambda x: x > 0))
    return found.crossJoin(F.broadcast(stats)).select("id", score.alias("score"))  # stats is one row


def idf(n: Column, df: Column) -> Column:
    return F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(1e-6))


#: Distinct tokens of a set of questions, and questions, that bm25_batch holds against all documents at once.
MOST_TERMS, MOST_QUESTIONS = 200_000, 20_000
PLACES = 6


def bm25_batch(docs: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """query_id, id, score: the k best documents of each question (query_id, terms), best score first, then by id.

    The questions are a stated set and go to every task. Documents are tokenised once: length and counts of asked tokens are
    written to the shared folder. From there come the corpus statistics, and the scores, in blocks of documents against all
    questions; of each block only the k best of a question go on, so pairs are never shuffled.
    """
    spark = docs.sparkSession
    asked = queries.select("query_id", F.array_distinct(F.transform("terms", F.lower)).alias("terms")).limit(MOST_QUESTIONS + 1).toArrow()
    terms = sorted({t for ts in asked.column("terms").to_pylist() for t in ts or ()})
    if asked.num_rows > MOST_QUESTIONS or len(terms) > MOST_TERMS:
        raise ValueError("more questions than one pass takes: give them in several sets")
    names = spark.sparkContext.broadcast(terms)
    rows = docs.select(F.col(id_col).alias("id"), T.tokens(F.col(text_col)).alias("tokens"))
    kind = dict(rows.dtypes)["id"]

    def counted(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        known = pa.array(names.value, pa.string())
        for batch in batches:
            lists = batch.column(1)
            code = pc.index_in(lists.flatten(), known).fill_null(-1).to_numpy(zero_copy_only=False)
            size = lists.value_lengths().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(lists)), size)[code >= 0].astype(np.int64)
            pair, n = np.unique(owner * max(1, len(known)) + code[code >= 0], return_counts=True)
            edges = pa.array(np.searchsorted(pair // max(1, len(known)), np.arange(len(lists) + 1)), pa.int32())
            term = pa.ListArray.from_arrays(edges, pa.array((pair % max(1, len(known))).astype(np.int32)))
            yield pa.record_batch({"id": batch.column(0), "len": pa.array(size, pa.int32()), "term": term, "tf": pa.ListArray.from_arrays(edges, pa.array(n.astype(np.int32)))})

    index = cut(rows.mapInArrow(counted, f"id {kind}, len int, term array<int>, tf array<int>"))
    corpus = index.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean")).first()
    holds = index.select(F.explode("term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = {r["term"]: r["w"] for r in holds.select("term", idf(F.lit(corpus["n"]), F.col("df")).alias("w")).collect()}  # at most MOST_TERMS
    place = {t: i for i, t in enumerate(terms)}
    shared = spark.sparkContext.broadcast((asked, [[place[t] for t in ts or ()] for ts in asked.column("terms").to_pylist()], weight, corpus["mean"]))

    def best(batches):
        import numpy as np
        import pyarrow as pa

        table, questions, weights, mean = shared.value
        users = {}  # the questions that have a token
        for q, ts in enumerate(questions):
            for t in ts:
                users.setdefault(t, []).append(q)
        for batch in batches:
            size = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            lists = batch.column(2)
            term, tf = lists.flatten().to_numpy(zero_copy_only=False), batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            doc = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            part = np.array([weights[t] for t in term.tolist()]) * tf * (T.K1 + 1) / (tf + T.K1 * (1 - T.B + T.B * size[doc] / mean)) if len(term) else tf
            scores, met = np.zeros((len(questions), len(lists))), np.zeros((len(questions), len(lists)), bool)
            order = np.argsort(term, kind="stable")
            edges = np.flatnonzero(np.r_[True, np.diff(term[order]) != 0, True]) if len(term) else np.zeros(0, int)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                own = order[a:b]
                for q in users.get(int(term[own[0]]), ()):
                    scores[q, doc[own]] += part[own]
                    met[q, doc[own]] = True
            ids, out = np.array(batch.column(0).to_pylist(), object), []
            rank = np.argsort(np.argsort(np.array([str(x) for x in ids]))) if kind == "string" else np.argsort(np.argsort(np.array([x if x is not None else -1 for x in ids])))
            for q in range(len(questions)):
                hit = np.flatnonzero(met[q])
                value = np.round(scores[q, hit], PLACES)
                top_ = np.lexsort((rank[hit], -value))[:k]
                out += [(q, hit[j], value[j]) for j in top_]
            yield pa.record_batch({"query_id": table.column("query_id").take(pa.array([x[0] for x in out], pa.int64())).combine_chunks(), "id": batch.column(0).take(pa.array([x[1] for x in out], pa.int64())), "score": pa.array([float(x[2]) for x in out], pa.float64())})

    first = index.mapInArrow(best, f"query_id {dict(queries.dtypes)['query_id']}, id {kind}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return first.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")


def top(rows: DataFrame, k: int, *order) -> DataFrame:
    return rows.orderBy(*order).limit(k)


def nearest(vectors: DataFrame, query: list[float], k: int | None, where: Column | None = None, least: float | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Exact cosine ranking. The filter stands before the ranking, so it never hides hits. Without `k` all hits, in no order."""
    rows = vectors if where is None else vectors.where(where)
    rows = rows.withColumn("score", V.cosine(F.col(vector_col), F.array(*(F.lit(float(x)) for x in query))))
    if least is not None:
        rows = rows.where(F.col("score") >= least)
    rows = rows.drop(vector_col)
    return rows if k is None else top(rows, k, F.desc("score"), F.asc(id_col))


def fused(channels: dict[str, DataFrame], key: list[str], k: int = RRF_K, most: int = MOST_CANDIDATES) -> DataFrame:
    """Reciprocal rank fusion. Each channel has the key columns and `position` (from 1). A key that occurs twice in a
    channel counts once, at its first position, but the second occurrence keeps its place in the ranking."""
    union = None
    for name, rows in channels.items():
        best = rows.groupBy(*key).agg(F.min("position").alias("position")).withColumn("channel", F.lit(name))
        union = best if union is None else union.unionByName(best)
    out = union.groupBy(*key).agg(F.sum(1.0 / (k + F.col("position"))).alias("score"), F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("channels"))
    return top(out, most, F.desc("score"), *key)


def ranked(rows: DataFrame, *order, most: int = MOST_CANDIDATES) -> DataFrame:
    """The best rows with their position from 1."""
    best = top(rows, most, *order)
    return best.withColumn("position", F.row_number().over(Window.orderBy(*order)))  # at most `most` rows


def final_order(exact: Column, demoted: Column, other_kind: Column, score: Column) -> list[Column]:
    """Exact hits first, then what is not demoted, then the asked kind, then by score."""
    return [(~exact).asc(), demoted.asc(), other_kind.asc(), score.desc()]


def literal_lines(docs: DataFrame, literal: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, line (from 1), text of each line that holds the literal, without regard to case and white space. Documents
    that can't hold it are left out before their lines are made."""
    may = docs.where(T.contains_literal(F.col(text_col), F.lit(literal)))
    long = may.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("at", "text"))
    return long.where(T.contains_literal(F.col("text"), F.lit(literal))).select("id", (F.col("at") + 1).alias("line"), "text")


def exact_lookup(symbols: DataFrame, chunks: DataFrame, reference: str, scope: Column | None = None, most: int = 100) -> DataFrame:
    """Symbols and parsed chunks of a name; the scope filters before the limit, and of one symbol's chunks the first
    counts. Both have path, start_line, name, qualified_name, id; chunks also parent_symbol_key."""
    named = (F.col("name") == reference) | (F.col("qualified_name") == reference) | (F.col("id") == reference)
    keep = named if scope is None else named & scope
    shape = ["path", "start_line", "name", "qualified_name", "id"]
    first = Window.partitionBy("path", "parent_symbol_key").orderBy("start_line", "id")
    own = chunks.where(keep).withColumn("n", F.row_number().over(first)).where("n = 1")
    return top(symbols.where(keep).select(shape).unionByName(own.select(shape)), most, "path", "start_line", "id")
