"""Grouping of spelling variants: words that differ by one code point, found by two-dimensional range reporting.

1. Runs are counted with DataFrame functions; only words that are frequent and long enough go on.
2. Two words at distance one agree in the half that doesn't hold the edit (pigeonhole). So each word is dealt by its first
   and by its second half, and as a target of an insertion by the halves that are left without the code point between
   them. A half that more than `hot` words share is dealt out in blocks of queries and targets.
3. In a task the words of one length stand in forward order and in reverse order: a point each. For each edit position of a
   word the prefix before it is an interval of the forward order and the suffix after it one of the reverse order. A
   wavelet tree over the points reports those in both intervals. All reported words are near, but for the word itself and
   for insertions that a later position reports as well.
4. What a task found for a word is one row (its number of near words, the best of them); these rows are aggregated.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, shuffle_partitions, text_or_empty

#: What a run is, and the letters that are lower-cased.
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_CHARS, LEAST_N, FACTOR = 5, 3, 2
#: Rows of one task's words, and words of one half from which on it is dealt in blocks. Only the work depends on them.
TASK_ROWS, HOT = 100_000, 50_000
#: Rectangles that are searched at once.
SEARCHED = 1 << 17


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit: Callable[[Column, Column], Column] | None = None, least_chars: int = LEAST_CHARS, least_n: int = LEAST_N) -> DataFrame:
    """word, n: the lower-cased runs (A-Z only) of all texts that are long and frequent enough.

    `edit` makes another run of (id, lower-cased run) before words are counted; it may shorten a run, not lengthen it.
    A null text has no run. Very long texts are read whole. Repeated rows count each; other columns are ignored.
    """
    runs = F.regexp_extract_all(F.translate(text_or_empty(F.col(text_col)), UPPER, LOWER), F.lit(RUN), F.lit(0))
    rows = docs.select(F.col(id_col).alias("id"), F.explode(runs).alias("word")).where(F.length("word") >= least_chars)
    if edit is not None:
        rows = rows.select(edit(F.col("id"), F.col("word")).alias("word")).where(F.length("word") >= least_chars)
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_n)


class WaveletTree:
    """A permutation of 0 to n - 1 by levels of bits, the highest first; each level has the zeros before the ones."""

    def __init__(self, values: np.ndarray):
        self.levels = []
        for k in range(max(1, int(len(values) - 1).bit_length()) - 1, -1, -1):
            bit = (values >> k) & 1
            ones = np.zeros(len(values) + 1, np.int64)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((1 << k, ones, len(values) - int(ones[-1])))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def report(self, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rectangles of places [left, right) and values [low, high): the rectangle and the value of each point inside."""
        which = np.flatnonzero((left < right) & (low < high))
        a, b, value = left[which], right[which], np.zeros(len(which), np.int64)
        for weight, ones, zeros in self.levels:
            in_a, in_b = ones[a], ones[b]
            which = np.concatenate([which, which])
            value = np.concatenate([value, value + weight])
            a, b = np.concatenate([a - in_a, zeros + in_a]), np.concatenate([b - in_b, zeros + in_b])
            keep = (a < b) & (value < high[which]) & (value + weight > low[which])
            which, a, b, value = which[keep], a[keep], b[keep], value[keep]
        return which, value


class Order:
    """Words in one order: the place of each, what neighbours have in common, and the targets before each place."""

    def __init__(self, chars: np.ndarray, is_target: np.ndarray):
        n, width = chars.shape
        self.at = np.argsort(np.ascontiguousarray(chars).view(f"U{width}").ravel(), kind="stable")
        self.place = np.empty(n, np.int64)
        self.place[self.at] = np.arange(n)
        self.common = np.full(n + 1, -1, np.int64)  # code points that the words at places k - 1 and k begin with alike
        self.common[1:n] = (chars[self.at[1:]] != chars[self.at[:-1]]).argmax(axis=1)
        self.before = np.concatenate([[0], np.cumsum(is_target[self.at])])
        self.targets = self.at[is_target[self.at]]

    def most(self, rows: np.ndarray) -> np.ndarray:
        """The most code points that a word begins with as any other does."""
        return np.maximum(self.common[self.place[rows]], self.common[self.place[rows] + 1])

    def intervals(self, rows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The targets that begin with the first `length` code points of each row's word: an interval of target places."""
        low, high = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
        by = np.argsort(length, kind="stable")
        edges = np.flatnonzero(np.diff(length[by], prepend=-1, append=-1)) if len(by) else []
        for first, end in zip(edges[:-1], edges[1:], strict=True):
            own = by[first:end]
            starts = np.flatnonzero(self.common < length[own[0]])  # the last one is the end of all
            k = np.searchsorted(starts, self.place[rows[own]], "right") - 1
            low[own], high[own] = self.before[starts[k]], self.before[starts[k + 1]]
        return low, high


def near_pairs(words: np.ndarray, is_query: np.ndarray, is_target: np.ndarray, m: int, gap: int, positions: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows (query, target) of distinct words that differ by one replaced (gap 0) or inserted (gap 1) code point at one of
    the positions. Queries have m code points, targets m + gap."""
    width = m + gap
    chars = words.astype(f"U{width}").view(np.uint32).reshape(len(words), width)
    back = np.ascontiguousarray(chars[:, ::-1])
    if gap:  # of a query the code points stand first, as in the targets
        back[is_query] = np.roll(back[is_query], -1, axis=1)
    ahead, behind = Order(chars, is_target), Order(back, is_target)
    query = np.flatnonzero(is_query)
    first = np.maximum(positions[0], m - (1 - gap) - behind.most(query))
    n = np.maximum(np.minimum(positions[1] - 1, ahead.most(query)) + 1 - first, 0)
    row = np.repeat(query, n)
    at = np.repeat(first, n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    left, right = ahead.intervals(row, at)
    low, high = behind.intervals(row, m - (1 - gap) - at)
    tree = WaveletTree(behind.before[behind.place[ahead.targets]])
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for k in range(0, len(row), SEARCHED):
        part = slice(k, k + SEARCHED)
        which, value = tree.report(left[part], right[part], low[part], high[part])
        a, b, edit = row[part][which], behind.targets[value], at[part][which]
        differ = chars[a, edit] != chars[b, edit]  # so each pair is reported at the first place where the two differ
        found.append((a[differ], b[differ]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def best_near(table):
    """word, n_near, best_n, best of the words of one task, as far as it sees them. `table` has side (0: the first halves
    agree), m (code points of the queries), block, word, n, is_query, is_target."""
    import pyarrow as pa
    import pyarrow.compute as pc

    word, n = table.column("word").combine_chunks(), table.column("n").to_numpy()
    chars = pc.utf8_length(word).to_numpy()
    flags = [table.column(c).to_numpy() for c in ("is_query", "is_target")]
    side, m, block = (table.column(c).to_numpy() for c in ("side", "m", "block"))
    order = np.lexsort((block, m, side))
    new = np.flatnonzero(np.any([np.diff(x[order]) != 0 for x in (side, m, block)], axis=0)) + 1
    word_of, near = [], []
    for rows in np.split(order, new):
        length, second = int(m[rows[0]]), int(side[rows[0]])
        half = length // 2
        strings = np.array(word.take(pa.array(rows)).to_pylist())
        long = chars[rows] > length
        for gap in (0, 1):
            use = np.flatnonzero((~long & (flags[0][rows] | flags[1][rows])) if not gap else long | flags[0][rows])
            is_query, is_target = flags[0][rows][use] & ~long[use], flags[1][rows][use] & (long[use] == bool(gap))
            if not is_query.any() or not is_target.any() or len(use) < 2:
                continue
            if not gap:  # in a block a word may be there as a query and as a target
                names, at = np.unique(strings[use], return_inverse=True)
                both = [np.bincount(at, f, len(names)) > 0 for f in (is_query, is_target)]
                one = np.zeros(len(names), np.int64)
                one[at] = use
                use, (is_query, is_target) = one, both
            a, b = near_pairs(strings[use], is_query, is_target, length, gap, (0, half) if second else (half, length + gap))
            a, b = rows[use[a]], rows[use[b]]
            word_of += [a, b] if gap else [a]
            near += [b, a] if gap else [b]
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (word_of, near))
    rank = np.empty(len(word), np.int64)
    rank[pc.sort_indices(word).to_numpy()] = np.arange(len(word))
    name = pc.dictionary_encode(word).indices.to_numpy()  # rows of one word, whichever block or key they came by
    sorted_ = np.lexsort((rank[b], -n[b], name[a]))
    a, b = a[sorted_], b[sorted_]
    first = np.flatnonzero(np.diff(name[a], prepend=-1)) if len(a) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(a)))
    return pa.table({"word": word.take(pa.array(a[first])), "n_near": pa.array(count, pa.int64()), "best_n": pa.array(n[b[first]], pa.int64()), "best": word.take(pa.array(b[first]))})


def dealt(words: DataFrame, hot: int) -> DataFrame:
    """side, m, half, block, word, n, is_query, is_target: each word under the halves that it shares with near words."""
    n, word = F.length("word"), F.col("word")
    under = lambda side, m, half, query: F.struct(F.lit(side).alias("side"), m.alias("m"), half.alias("half"), F.lit(query).alias("is_query"))
    half, less = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    keys = F.array(
        under(0, n, F.substring(word, F.lit(1), half), True),
        under(1, n, F.substring(word, half + 1, n), True),
        under(0, n - 1, F.substring(word, F.lit(1), less), False),
        under(1, n - 1, F.substring(word, less + 2, n), False),
    )
    rows = words.select("word", "n", F.explode(keys).alias("key")).select("key.*", "word", "n", F.lit(True).alias("is_target"))
    shared = rows.groupBy("side", "m", "half").agg(F.count(F.lit(1)).alias("words")).where(F.col("words") > hot)
    shared = shared.withColumn("blocks", F.ceil(F.col("words") / hot).cast("int")).drop("words")  # at most one key for `hot` rows
    rows = rows.join(F.broadcast(shared), ["side", "m", "half"], "left")
    own = lambda seed: F.pmod(F.xxhash64("word", F.lit(seed)), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    at = lambda place, query, target: F.struct(place.alias("block"), query.alias("is_query"), target.alias("is_target"))
    as_query = F.transform(every, lambda k: at(own(1) * F.col("blocks") + k, F.lit(True), F.lit(False)))
    as_target = F.transform(every, lambda k: at(k * F.col("blocks") + own(2), F.lit(False), F.lit(True)))
    places = F.when(F.col("blocks").isNull(), F.array(at(F.lit(-1), F.col("is_query"), F.lit(True)))).when(F.col("is_query"), F.concat(as_query, as_target)).otherwise(as_target)
    return rows.select("side", "m", "half", "word", "n", F.explode(places).alias("place")).select("side", "m", "half", "word", "n", "place.*")


def near_words(words: DataFrame, hot: int = HOT, task_rows: int = TASK_ROWS) -> DataFrame:
    """word, n, n_near, best, best_n: the number of near words, and the near word of the largest n (of several the
    smallest in code-point order; null if none). `words` has distinct words and n; a null word is left out."""
    words = words.where("word IS NOT NULL").select("word", F.col("n").cast("long").alias("n"))
    tasks = max(shuffle_partitions(words.sparkSession), ceil(4 * words.count() / task_rows))
    task = F.pmod(F.xxhash64("side", "m", "half", "block"), F.lit(tasks)).cast("int")
    rows = dealt(words, hot).select(task.alias("task"), "side", "m", "block", "word", "n", "is_query", "is_target")
    found = rows.groupBy("task").applyInArrow(best_near, "word string, n_near long, best_n long, best string")
    best = F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    alone = words.select("word", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"), "n")
    both = found.withColumn("n", F.lit(None).cast("long")).unionByName(alone)
    out = both.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min(best).alias("top"))
    return out.select("word", "n", "n_near", F.col("top.word").alias("best"), (-F.col("top.less")).alias("best_n"))


def last_forms(links: DataFrame) -> DataFrame:
    """word, root: where the links (word, form) end. They have no ring; each round doubles the steps that are made."""
    ways = links.select("word", F.col("form").alias("root"))
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = materialise(ways.join(on, "root", "left").select("word", "root", "further"), "variants-ways")
        if step.where("further IS NOT NULL").isEmpty():
            return step.select("word", "root")
        ways = step.select("word", F.coalesce("further", "root").alias("root"))


def variants(words: DataFrame, factor: int = FACTOR, hot: int = HOT, task_rows: int = TASK_ROWS) -> DataFrame:
    """word, form, root, n, n_near, form_n for distinct words with their number n.

    Near words differ by one inserted, deleted or replaced code point. A word's form is its near word of the largest n (of
    several the smallest in code-point order) if that n is at least `factor` times its own; else null. root follows the
    forms to the last. An empty table gives an empty result; other columns are ignored.
    """
    near = near_words(words, hot, task_rows)
    taken = F.col("best_n") >= factor * F.col("n")
    near = materialise(near.select("word", "n", "n_near", F.when(taken, F.col("best")).alias("form"), F.when(taken, F.col("best_n")).alias("form_n")), "variants-near")
    roots = last_forms(near.where("form IS NOT NULL").select("word", "form"))
    out = near.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit: Callable[[Column, Column], Column] | None = None, least_chars: int = LEAST_CHARS, least_n: int = LEAST_N, factor: int = FACTOR) -> DataFrame:
    """variants() of the words of all texts. Null and empty texts have no words; an id may be null if `edit` takes nulls."""
    return variants(materialise(count_words(docs, id_col, text_col, edit, least_chars, least_n), "variants-words"), factor)
