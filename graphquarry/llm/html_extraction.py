"""Main text of web pages: gradient-boosted trees over nodes of the block tree, and a decoding that keeps the tree consistent.

Each node of a page (an element, or a run of text between block boundaries) gets the log probabilities of three states:
all of its text is main, none is, or both kinds are in it. Trees see the node's kind, attribute tokens, densities of its
subtree, depth and siblings. Decoding chooses the states of the whole page together, with the largest sum: below a node
that is all main or not at all every node is the same, and only a mixed node leaves the choice to its children. So an
ancestor and a descendant can't contradict each other.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Trees, fit_trees
from .common import fresh, small_batches, text_or_empty
from .page_tree import Nodes, describe, read_page, texts_of
from .sample_pages import sample

MAIN, OTHER, MIXED = 0, 1, 2
#: Labelled pages that the trees are fitted on unless others are given.
FIT_PAGES, FIT_SEED = 1200, 11
#: Nodes that are described at once.
BLOCK_NODES = 20_000


def states(nodes: Nodes) -> tuple[np.ndarray, np.ndarray]:
    """By the labels of texts: the state of each node, and whether it has a text at all."""
    n, end = len(nodes.parent), np.array(nodes.end, np.int64)
    chars = np.array([len(t) if t else 0 for t in nodes.text], np.int64)
    label = np.array(nodes.label, np.int64)
    main, every = (np.concatenate([[0], np.cumsum(x)]) for x in (chars * label, chars))
    a, b = main[end] - main[np.arange(n)], every[end] - every[np.arange(n)]
    return np.where(a == 0, OTHER, np.where(a == b, MAIN, MIXED)), b > 0


def fit(pages: list[str], rounds: int = 40, depth: int = 4) -> Trees:
    """Trees fitted on labelled pages: HTML in which data-main="1" marks main text and data-main="0" what isn't, inherited
    downwards. Each page counts alike, whatever its number of nodes."""
    nodes = Nodes()
    for page in pages:
        read_page(page, nodes)
    x, (y, use) = describe(nodes), states(nodes)
    page = np.searchsorted(nodes.pages, np.arange(len(y)), "right") - 1
    weight = 1 / np.sqrt(np.bincount(page[use], minlength=len(nodes.pages)))[page]
    weight = weight[use] / weight[use].mean() if use.any() else weight[use]
    return fit_trees(x[use], y[use], weight, 3, rounds, depth)


@lru_cache(maxsize=2)
def default_trees(n: int = FIT_PAGES, seed: int = FIT_SEED) -> Trees:
    """Trees fitted on pages that are made from a seed; a bounded number that no table determines."""
    return fit(sample(n, seed))


def decode(nodes: Nodes, log_p: np.ndarray) -> np.ndarray:
    """Whether each node is chosen as main, by the likeliest consistent states of each page. Nodes without text don't count."""
    n = len(nodes.parent)
    sums = np.concatenate([np.zeros((1, 2)), np.cumsum(log_p[:, :2], axis=0)])
    whole = sums[np.array(nodes.end, np.int64)] - sums[:-1]
    main, other, mixed = whole[:, MAIN].tolist(), whole[:, OTHER].tolist(), log_p[:, MIXED].tolist()
    inner, choice = [0.0] * n, [OTHER] * n
    parent, end, text = nodes.parent, nodes.end, nodes.text
    for k in range(n - 1, -1, -1):
        best, state = (main[k], MAIN) if main[k] > other[k] else (other[k], OTHER)
        if text[k] is None and end[k] > k + 1 and mixed[k] + inner[k] > best:
            best, state = mixed[k] + inner[k], MIXED
        choice[k] = state
        if parent[k] >= 0:
            inner[parent[k]] += best
    for k in range(n):
        if parent[k] >= 0 and choice[parent[k]] != MIXED:
            choice[k] = choice[parent[k]]
    return np.array([c == MAIN for c in choice], bool)


def main_texts(pages: list[str], trees: Trees) -> list[str]:
    """The main text of each page."""
    out, nodes = [], Nodes()

    def flush() -> None:
        nonlocal nodes
        if nodes.pages:
            _, has_text = states(nodes)
            log_p = np.zeros((len(has_text), 3))
            log_p[has_text] = trees.log_probabilities(describe(nodes)[has_text])
            out.extend(texts_of(nodes, decode(nodes, log_p)))
        nodes = Nodes()

    for page in pages:
        read_page(page, nodes)
        if len(nodes.parent) >= BLOCK_NODES:
            flush()
    flush()
    return out


def extract(pages: DataFrame, html_col: str = "html", keep=("page_id", "url"), trees: Trees | None = None) -> DataFrame:
    """The columns of `keep`, text (the main text of the page, empty if it has none), n_chars (its code points).

    Character references are decoded, white space inside a block is one blank, blocks stand in page order with a blank
    between them. One row per row of the table, repeated rows and null ids included; null counts as an empty page; an empty
    table gives an empty result. Very long pages are read whole; elements deeper than 512 stand beside one another at that
    depth. Columns of `keep` have other names than those that are added.
    """
    added = {"text", "n_chars"} & {c.lower() for c in keep}
    if added:
        raise ValueError(f"columns that are added here: {', '.join(sorted(added))}")
    small_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(trees or default_trees())  # some hundred small trees

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            texts = main_texts(batch.column(batch.num_columns - 1).to_pylist(), shared.value)
            own = {f: batch.column(k) for k, f in enumerate(batch.schema.names[:-1])}
            yield pa.record_batch(own | {"text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})

    rows = pages.select(*keep, text_or_empty(F.col(html_col)).alias(fresh(pages, "_html")))
    shape = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(read, f"{shape}text string, n_chars long")
