"""Quality of documents by hierarchical empirical Bayes.

A document classifier gives the evidence of each text. Hosts and paths within hosts get posteriors by grouped
aggregation: a host's rate of good documents is shrunk toward the global rate, a path's toward its host's, with as many
pseudo-documents as the spread between sites warrants (by moments). A document's posterior odds are the classifier's odds
times the path's odds over the global odds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import if_small, materialise, small_batches
from .linear import bounded_labels, fit_dense, sigmoid
from .shingles import WIDTH, WEIGHTS, WINDOW, mix, text_bytes, word_hashes

#: At most so many labelled documents are learned from.
SAMPLE_DOCS = 8_000
THRESHOLD = 0.5
#: Pseudo-documents of a site's prior are within these bounds.
LEAST_PRIOR, MOST_PRIOR = 5.0, 10_000.0
#: Sites that are broadcast (two short strings and two numbers each), and the parts that a large site is dealt to beyond it.
BROADCAST_SITES, SALTS = 100_000, 64
FEATURES = ("log_words", "short", "symbols", "upper", "marks", "word_length", "odd_length", "repeated", "stutter", "distinct", "letters", "repeated_lines")

_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_MARK = np.isin(np.arange(256), list(b"!?"))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_LETTER = _UPPER | ((np.arange(256) >= 97) & (np.arange(256) <= 122)) | (np.arange(256) >= 128)
_HEAD = (np.arange(256) & 0xC0) != 0x80
_LINE = np.arange(256) == 10


def features(column) -> np.ndarray:
    """A row of FEATURES for each text of an Arrow column. A null or empty text has the values of no words."""
    data, edges = text_bytes(column)
    out, k = [np.zeros((0, len(FEATURES)))], 0
    while k < len(edges) - 1:
        stop = max(k + 1, int(np.searchsorted(edges, edges[k] + 2 * WINDOW, "right")) - 1)
        own = edges[k : stop + 1]
        out.append(_block(data[own[0] : own[-1]], own - own[0]))
        k = stop
    return np.concatenate(out)


def _block(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return (sums[edges[1:]] - sums[edges[:-1]]).astype(np.float64)

    words, n = word_hashes(data, edges)
    n_texts = len(edges) - 1
    text = np.repeat(np.arange(n_texts), n)

    def repeats(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
        key = mix(hashes ^ mix(owner.astype(np.uint64)))
        order = np.argsort(key)
        again = np.zeros(len(key), bool)
        again[1:] = key[order][1:] == key[order][:-1]
        return np.bincount(owner[order][again], minlength=n_texts)

    m = max(0, len(words) - WIDTH + 1)
    five = np.zeros(m, np.uint64)
    for j in range(WIDTH):
        five += words[j : j + m] * WEIGHTS[j]
    inside = text[:m] == text[WIDTH - 1 :] if m else np.zeros(0, bool)
    same = (words[1:] == words[:-1]) & (text[1:] == text[:-1])
    lines, n_lines = word_hashes(data, edges, _LINE)
    line_text = np.repeat(np.arange(n_texts), n_lines)
    count, one = n.astype(np.float64), np.maximum(n, 1).astype(np.float64)
    heads = np.maximum(per_text(_HEAD[data]), 1)
    length = per_text(_HEAD[data] & ~np.isin(data, [32, 9, 10, 11, 12, 13])) / one
    columns = (
        np.log1p(count),
        count < 3,
        np.minimum(per_text(_SYMBOL[data]) / one, 1.0),
        np.minimum(per_text(_UPPER[data]) / heads, 0.5),
        np.minimum(per_text(_MARK[data]) / one, 1.0),
        np.minimum(np.abs(length - 5.0) / 5.0, 1.0),
        (length < 3.0) | (length > 12.0),
        repeats(five[inside], text[:m][inside]) / one,
        np.bincount(text[1:][same], minlength=n_texts) / one,
        (count - repeats(words, text)) / one,
        per_text(_LETTER[data] & _HEAD[data]) / heads,
        repeats(lines, line_text) / np.maximum(n_lines, 1),
    )
    return np.stack([np.asarray(c, np.float64) for c in columns], 1)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_docs: int = SAMPLE_DOCS) -> tuple[np.ndarray, float]:
    """Weights and bias of the document classifier, from at most `sample_docs` labelled documents (the stated bound)."""
    small_batches(docs.sparkSession)
    chosen = bounded_labels(labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")), sample_docs)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")  # at most sample_docs rows

    def measure(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.record_batch({"doc_id": batch.column(0), "label": batch.column(1), "x": pa.array(list(features(batch.column(2))), pa.list_(pa.float64()))})

    table = rows.select(F.col("doc_id").cast("long"), "label", "text").mapInArrow(measure, "doc_id long, label int, x array<double>").toArrow().sort_by("doc_id")
    if not table.num_rows:
        return np.zeros(len(FEATURES)), 10.0
    return fit_dense(np.array(table.column("x").to_pylist()), np.array(table.column("label").to_pylist(), np.float64))


def evidence(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str, text_col: str, host: Column, path: Column) -> DataFrame:
    """doc_id, host, path, p: the classifier's probability of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        import pyarrow as pa

        weights, bias = shared.value
        for batch in batches:
            p = sigmoid(features(batch.column(3)) @ weights + bias)
            yield pa.record_batch({"doc_id": batch.column(0), "host": batch.column(1), "path": batch.column(2), "p": pa.array(p)})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), F.col(text_col).alias("text"))
    return rows.mapInArrow(predict, "doc_id long, host string, path string, p double")


def prior_strength(groups: DataFrame, rate: Column) -> float:
    """Pseudo-documents of a site's prior by moments: of sites with n, s (sum of p), how much more their rates spread
    around `rate` than chance makes them."""
    weight = F.col("n")
    chance = rate * (1 - rate) / F.col("n")
    row = groups.where("n > 1").agg(
        (F.sum(weight * ((F.col("s") / F.col("n") - rate) * (F.col("s") / F.col("n") - rate) - chance)) / F.sum(weight)).alias("between"),
        (F.sum(weight * rate * (1 - rate)) / F.sum(weight)).alias("within"),
    ).first()
    if row["between"] is None or row["within"] is None or row["between"] <= row["within"] / MOST_PRIOR:
        return MOST_PRIOR
    return float(min(MOST_PRIOR, max(LEAST_PRIOR, row["within"] / row["between"] - 1)))


def with_sites(scored: DataFrame, sites: DataFrame) -> DataFrame:
    """The documents with what is known of their site. Few sites are broadcast; of many each is repeated for every salt, so
    that a site that holds a third of the documents is dealt to SALTS tasks."""
    if sites.limit(BROADCAST_SITES + 1).count() <= BROADCAST_SITES:
        return scored.join(F.broadcast(sites), ["host", "path"])
    salted = sites.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = scored.withColumn("salt", F.pmod(F.xxhash64("doc_id", "p"), F.lit(SALTS)).cast("int"))
    return rows.join(salted, ["host", "path", "salt"]).drop("salt")


def classify(docs: DataFrame, model: tuple[np.ndarray, float], host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, p_document, p_host, p_path, p_posterior, kept (p_posterior reaches the threshold).

    One row per row of the table. A null host or path counts as the empty one; a null text as one without words. An
    empty table gives an empty result; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    scored = materialise(evidence(docs, model, id_col, text_col, host, path), "site-evidence")
    paths = materialise(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s")), "site-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    top = min(max(total["s"] / total["n"], 1e-3), 1 - 1e-3) if total["n"] else 0.5
    k_host = prior_strength(hosts, F.lit(top))
    hosts = hosts.select("host", ((F.col("s") + k_host * top) / (F.col("n") + k_host)).alias("p_host"))
    under = paths.join(hosts, "host")
    k_path = prior_strength(under, F.col("p_host"))
    sites = under.select("host", "path", "p_host", ((F.col("s") + k_path * F.col("p_host")) / (F.col("n") + k_path)).alias("p_path"))
    odds = lambda c: F.log(F.greatest(F.least(c, F.lit(1 - 1e-6)), F.lit(1e-6)) / (1 - F.greatest(F.least(c, F.lit(1 - 1e-6)), F.lit(1e-6))))
    out = with_sites(scored, materialise(sites, "site-posteriors"))
    together = odds(F.col("p")) + odds(F.col("p_path")) - odds(F.lit(top))
    out = out.withColumn("p_posterior", 1 / (1 + F.exp(-together)))
    return out.select("doc_id", F.col("p").alias("p_document"), "p_host", "p_path", "p_posterior", (F.col("p_posterior") >= threshold).alias("kept"))


def survivors(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are not rejected, with their own columns; rows without an id stay."""
    verdict = classify(docs, fit(docs, labels, id_col, text_col), host, path, id_col, text_col)
    rejected = if_small(materialise(verdict.where("NOT kept").select(F.col("doc_id").alias(id_col)).distinct(), "site-rejected"))
    return docs.join(rejected, id_col, "left_anti").select(*docs.columns)
