"""Toxicity by a classifier chain.

Categories are predicted in a fixed order by linear models over units of a document: its words and their first letters, so
that inflected words of one stem are one unit, and how often a unit occurs. The probabilities of earlier categories are
features of the later models; in training they come from models that have not seen the document (out of fold), so that
later models learn how far the earlier ones can be trusted. The labels have no categories besides `toxic`, the last one:
the earlier ones are groups of toxic documents that share a stem, learned from the labels in any language.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches
from .linear import Sparse, bounded_labels, fit_sparse, sigmoid
from .shingles import WINDOW, text_bytes, unit_hashes

GROUPS = 3
CATEGORIES = (*(f"stem_group_{k + 1}" for k in range(GROUPS)), "toxic")
#: At most so many labelled documents are learned from.
SAMPLE_DOCS = 12_000
FOLDS, THRESHOLD = 5, 0.5
#: Letters of the prefixes, and the counts of a unit in a document that are features each.
PREFIXES, LEVELS = (4, 5, 6, 7), (1, 2, 4, 8)
#: What a feature must show in the labelled sample to be learned from: documents, and by how many standard deviations the
#: toxic ones among them differ from chance. FIRST_Z, over the whole sample, only saves moving what no fold could choose.
LEAST_DOCS, LEAST_Z, FIRST_Z = 5, 5.0, 3.0
#: Strength of the L1 penalties.
PENALTY, REFIT_PENALTY = 3e-3, 2e-5

#: Bytes between words: all but ASCII letters and the bytes of other characters.
BETWEEN = np.ones(256, bool)
BETWEEN[65:91] = BETWEEN[97:123] = BETWEEN[128:] = False


def unit_blocks(column):
    """For blocks of whole texts of an Arrow column: the hashes of their units, the text of each, and the number of texts."""
    data, edges = text_bytes(column)
    k = 0
    while k < len(edges) - 1:
        stop = max(k + 1, int(np.searchsorted(edges, edges[k] + 2 * WINDOW, "right")) - 1)
        own = edges[k : stop + 1]
        hashes, text = unit_hashes(data[own[0] : own[-1]], own - own[0], BETWEEN, PREFIXES)
        yield hashes, text, stop - k
        k = stop


def counted(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct units of one text, sorted, and the number of LEVELS that each reaches."""
    units, n = np.unique(hashes, return_counts=True)
    return units, np.searchsorted(LEVELS, n, "right")


class Features:
    """units: sorted hashes; column[i, k]: the feature of unit i at LEVELS[k], or -1; size: the number of features."""

    def __init__(self, units: np.ndarray, column: np.ndarray):
        order = np.argsort(units)
        self.units, self.column, self.size = units[order], column[order], int(column.max(initial=-1)) + 1

    def of(self, units: np.ndarray, reached: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places among `units` and the features of those that are known."""
        if not len(self.units):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.units, units), len(self.units) - 1)
        hit = np.flatnonzero(self.units[at] == units)
        table = np.where(np.arange(len(LEVELS)) < reached[hit][:, None], self.column[at[hit]], -1)
        row, level = np.nonzero(table >= 0)
        return hit[row], table[row, level]


class Chain:
    """features; weights: one row for each category; onto: weights of earlier probabilities; bias."""

    def __init__(self, features: Features, weights, onto, bias):
        self.features, self.weights, self.onto, self.bias = features, weights, onto, bias

    def probabilities(self, hashes: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
        total = np.zeros((n, len(self.bias)))
        known = self.features.units
        if len(known) and len(hashes):
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            hit = known[at] == hashes
            pair, count = np.unique(text[hit] * len(known) + at[hit], return_counts=True)
            place, feature = self.features.of(known[pair % len(known)], np.searchsorted(LEVELS, count, "right"))
            row = (pair // len(known))[place]
            for k in range(len(self.bias)):
                total[:, k] = np.bincount(row, self.weights[k][feature], n)
        out = np.zeros_like(total)
        for k in range(len(self.bias)):
            out[:, k] = sigmoid(total[:, k] + out[:, :k] @ self.onto[k] + self.bias[k])
        return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_docs: int = SAMPLE_DOCS) -> Chain:
    """Learn from at most `sample_docs` labelled documents (the stated bound). Without labels nothing is toxic. Null labels
    and labels without an id are left out; an id that repeats among documents or labels counts each time."""
    spark = docs.sparkSession
    small_batches(spark)
    chosen = bounded_labels(labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")), sample_docs)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")  # at most sample_docs rows

    def units(batches):
        import pyarrow as pa

        for batch in batches:
            sets = []
            for hashes, text, n in unit_blocks(batch.column(2)):
                order = np.argsort(text, kind="stable")
                cuts = np.searchsorted(text[order], np.arange(n + 1))
                sets += [counted(hashes[order[cuts[k] : cuts[k + 1]]]) for k in range(n)]
            yield pa.record_batch({"doc_id": batch.column(0), "label": batch.column(1), "units": pa.array([u.view(np.int64) for u, _ in sets], pa.list_(pa.int64())), "reached": pa.array([r.astype(np.int32) for _, r in sets], pa.list_(pa.int32()))})

    sample = materialise(rows.select(F.col("doc_id").cast("long"), "label", "text").mapInArrow(units, "doc_id long, label int, units array<long>, reached array<int>"), "toxicity-sample")
    shape = sample.agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("mean")).first()
    if not shape["n"] or not shape["mean"]:
        return fit_chain(Features(np.zeros(0, np.uint64), np.zeros((0, len(LEVELS)), np.int64)), [], np.zeros(0))
    features = telling(sample, float(shape["mean"]))
    shared = spark.sparkContext.broadcast(features)  # bounded by the units of the sample

    def places(batches):
        import pyarrow as pa

        for batch in batches:
            found = [np.sort(shared.value.of(np.asarray(u, np.int64).view(np.uint64), np.asarray(r))[1]) for u, r in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.record_batch({"doc_id": batch.column(0), "label": batch.column(1), "at": pa.array(found, pa.list_(pa.int64()))})

    table = sample.mapInArrow(places, "doc_id long, label int, at array<long>").toArrow().sort_by("doc_id")
    shared.unpersist()
    return fit_chain(features, [np.asarray(x, np.int64) for x in table.column("at").to_pylist()], np.array(table.column("label").to_pylist(), np.float64))


def telling(sample: DataFrame, mean: float) -> Features:
    """The features of the sample's units that enough documents have and that differ enough between labels."""
    long = sample.select("label", F.explode(F.arrays_zip("units", "reached")).alias("u")).select("label", "u.units", "u.reached")
    parts = {}
    for k in range(len(LEVELS)):
        has = F.col("reached") > k
        parts |= {f"n{k}": F.count_if(has), f"s{k}": F.sum(F.when(has, F.col("label") - mean).otherwise(0.0))}
    sums = long.groupBy("units").agg(*(c.alias(n) for n, c in parts.items()))
    good = [(F.col(f"n{k}") >= LEAST_DOCS) & (F.abs(F.col(f"s{k}")) >= FIRST_Z * F.sqrt(F.col(f"n{k}") * F.lit(max(mean * (1 - mean), 1e-9)))) for k in range(len(LEVELS))]
    kept = sums.where(F.greatest(*good)).select("units", *(g.alias(f"g{k}") for k, g in enumerate(good))).toArrow().sort_by("units")
    flags = np.stack([kept.column(f"g{k}").to_numpy() for k in range(len(LEVELS))], 1).astype(bool)
    column = np.full(flags.shape, -1)
    column[flags] = np.arange(int(flags.sum()))
    return Features(kept.column("units").to_numpy().view(np.uint64), column)


def z_scores(places: list[np.ndarray], n: int, y: np.ndarray, use: np.ndarray) -> np.ndarray:
    """By how many standard deviations the labels of each feature's documents differ from chance."""
    flat, row = np.concatenate([*places, np.zeros(0, np.int64)]), np.repeat(np.arange(len(places)), [len(x) for x in places])
    mean = float(y[use].mean())
    has = np.bincount(flat, use[row].astype(float), n)
    return np.bincount(flat, np.where(use, y - mean, 0.0)[row], n) / np.sqrt(np.maximum(has * mean * (1 - mean), 1e-9))


def stem_groups(places: list[np.ndarray], n: int, label: np.ndarray) -> list[np.ndarray]:
    """Labels of GROUPS categories: the toxic documents that hold the most telling feature, then of those left over."""
    left, groups = label > 0, []
    for _ in range(GROUPS):
        own = np.zeros(len(label), bool)
        if left.any() and n:
            best = int(z_scores(places, n, left.astype(float), left | (label == 0)).argmax())
            own = left & np.array([best in p for p in places], bool)
        groups.append(own.astype(float))
        left = left & ~own
    return groups


def fit_chain(features: Features, places: list[np.ndarray], label: np.ndarray) -> Chain:
    """places: the features of each document; label: 0 or 1."""
    n = features.size
    if not len(places) or not label.any():
        k = len(CATEGORIES)
        return Chain(features, np.zeros((k, n)), [np.zeros(j) for j in range(k)], np.full(k, -30.0))
    fold = np.arange(len(places)) % FOLDS
    earlier = np.zeros((len(places), 0))
    weights, onto, bias = [], [], []
    for y in (*stem_groups(places, n, label), label):
        out_of_fold, chosen = np.zeros(len(places)), np.zeros(n)
        for k in range(FOLDS):
            w, v, b = selected(places, n, earlier, y, fold != k, np.ones(n, bool))
            out_of_fold[fold == k] = sigmoid(Sparse(places, n, earlier).dot(w, v) + b)[fold == k]
            chosen += w != 0
        w, v, b = selected(places, n, earlier, y, np.ones(len(places), bool), chosen >= FOLDS - 1)
        weights.append(w)
        onto.append(v)
        bias.append(b)
        earlier = np.hstack([earlier, out_of_fold[:, None]])
    weights = np.array(weights)
    used = np.abs(weights).max(0) > 1e-6 if n else np.zeros(0, bool)
    to = np.append(np.where(used, np.cumsum(used) - 1, -1), -1)  # the last one for -1 itself
    column = to[features.column]
    some = (column >= 0).any(1)
    return Chain(Features(features.units[some], column[some]), weights[:, used], onto, np.array(bias))


def selected(places: list[np.ndarray], n: int, dense: np.ndarray, y: np.ndarray, use: np.ndarray, may: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Features that the penalised model selects among those of `may`, weighed again with hardly a penalty, so that a single
    telling one is not shrunk."""
    if not y[use].any():  # nothing to learn from: the category doesn't occur
        return np.zeros(n), np.zeros(dense.shape[1]), -30.0
    tried, own = narrowed(places, n, np.flatnonzero((np.abs(z_scores(places, n, y, use)) >= LEAST_Z) & may))
    first, _, _ = fit_sparse(Sparse(own, len(tried), dense), y, use, PENALTY)
    tried, own = narrowed(places, n, tried[first != 0])
    w, v, b = fit_sparse(Sparse(own, len(tried), dense), y, use, REFIT_PENALTY)
    full = np.zeros(n)
    full[tried] = w
    return full, v, b


def narrowed(places: list[np.ndarray], n: int, keep: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    to = np.full(n, -1)
    to[keep] = np.arange(len(keep))
    return keep, [to[x][to[x] >= 0] for x in places]


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, a probability for each category, and toxic (the last one reaches the threshold).

    One row per row of the table, repeated rows and null ids included. A null or empty text has the probabilities of a text
    without words. An empty table gives an empty result; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # bounded by the units of the training sample

    def predict(batches):
        import pyarrow as pa

        for batch in batches:
            p = np.concatenate([shared.value.probabilities(*x) for x in unit_blocks(batch.column(1))] or [np.zeros((0, len(CATEGORIES)))])
            yield pa.record_batch({"doc_id": batch.column(0)} | {f"p_{c}": pa.array(p[:, k]) for k, c in enumerate(CATEGORIES)} | {"toxic": pa.array(p[:, -1] >= threshold)})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(predict, "doc_id long, " + ", ".join(f"p_{c} double" for c in CATEGORIES) + ", toxic boolean")
