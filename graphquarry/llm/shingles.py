"""Word shingles of whole texts as 64-bit hashes, with numpy over the bytes of Arrow columns."""

from __future__ import annotations

import numpy as np

WIDTH = 5
#: Bytes of text that are worked on at once. A longer text is cut at white space, and its words are put together again.
WINDOW = 1 << 18

_rng = np.random.default_rng(20240229)
_odd = lambda n: _rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A random value for each byte, A-Z as a-z; the base of the polynomial over a word's bytes; the weights of a shingle's words.
BYTES = _odd(256)
BYTES[65:91] = BYTES[97:123]
BASE = int(_odd(1)[0])
WEIGHTS = _odd(WIDTH)
SHORT = _odd(WIDTH)
PREFIX = _odd(16)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse modulo 2 ** 64, to the powers 0 to n - 1."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, WINDOW + 1)
        _powers[:] = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            column = np.full(size, base, np.uint64)
            column[0] = 1
            _powers.append(np.cumprod(column, dtype=np.uint64))
    return _powers[0][:n], _powers[1][:n]


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and the edges of its texts; null counts as empty."""
    import pyarrow as pa

    column = column.cast(pa.large_string()).fill_null("")
    _, edges, data = column.buffers()
    edges = np.frombuffer(edges, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[edges[0] : edges[-1]], edges - edges[0]


def word_runs(data: np.ndarray, edges: np.ndarray, is_space: np.ndarray = IS_SPACE):
    """Windows of texts that end at white space or at an edge, as far as there is one: begin, the window's bytes, the first
    and the end of each word in it, and what hashes of byte ranges are made from."""
    begin, n = 0, len(data)
    while begin < n:
        end = min(n, begin + WINDOW)
        if end < n:  # not within a word
            spaces = np.flatnonzero(is_space[data[begin:end]])
            inner = edges[(edges > begin) & (edges <= end)]
            cut = max(begin + int(spaces[-1]) + 1 if len(spaces) else 0, int(inner[-1]) if len(inner) else 0)
            while cut <= begin and end < n:
                more = np.flatnonzero(is_space[data[end : end + WINDOW]])
                inner = edges[(edges >= end) & (edges <= end + WINDOW)]
                cuts = ([end + int(more[0]) + 1] if len(more) else []) + ([int(inner[0])] if len(inner) else [])
                end = min(cuts, default=min(n, end + WINDOW))
                cut = end if cuts else 0
            end = cut or end
        part = data[begin:end]
        inside = ~is_space[part]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        at = edges[(edges > begin) & (edges < end)] - begin
        first[at] |= inside[at]
        last[at - 1] |= inside[at - 1]
        up, down = powers(len(part))
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(BYTES[part] * up, out=sums[1:])
        yield begin, part, np.flatnonzero(first), np.flatnonzero(last) + 1, sums, down
        begin = end


def word_hashes(data: np.ndarray, edges: np.ndarray, is_space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of all texts, in order, and the number of words of each text. is_space: the bytes between."""
    hashes, starts = [], []
    for begin, _, a, b, sums, down in word_runs(data, edges, is_space):
        hashes.append(mix((sums[b] - sums[a]) * down[a]))
        starts.append(a + begin)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(edges) - 1, np.int64)
    starts = np.concatenate(starts)
    return np.concatenate(hashes), np.diff(np.searchsorted(starts, edges))


def unit_hashes(data: np.ndarray, edges: np.ndarray, is_space: np.ndarray, prefixes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts and of their prefixes of so many characters, and the text of each, in no order."""
    hashes, texts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for begin, part, a, b, sums, down in word_runs(data, edges, is_space):
        text = np.searchsorted(edges, a + begin, "right") - 1
        heads = np.append(np.flatnonzero((part & 0xC0) != 0x80), len(part))
        place = np.searchsorted(heads, a)
        hashes.append(mix((sums[b] - sums[a]) * down[a]))
        texts.append(text)
        for k in prefixes:
            end = heads[np.minimum(place + k, len(heads) - 1)]
            ok = (place + k < len(heads)) & (end <= b)
            hashes.append(mix((sums[end[ok]] - sums[a[ok]]) * down[a[ok]] + PREFIX[k]))
            texts.append(text[ok])
    return np.concatenate(hashes), np.concatenate(texts)


def shingle_sets(column):
    """For each text of a column, in order, its sorted distinct shingles; blocks of texts bound the memory."""
    data, edges = text_bytes(column)
    k = 0
    while k < len(edges) - 1:
        stop = max(k + 1, int(np.searchsorted(edges, edges[k] + 2 * WINDOW, "right")) - 1)
        own = edges[k : stop + 1]
        words, counts = word_hashes(data[own[0] : own[-1]], own - own[0])
        n = max(0, len(words) - WIDTH + 1)
        sums = np.zeros(n, np.uint64)
        for j in range(WIDTH):
            sums += words[j : j + n] * WEIGHTS[j]
        sums = mix(sums)
        at = 0
        for c in counts.tolist():
            if c >= WIDTH:
                yield np.unique(sums[at : at + c - WIDTH + 1])
            elif c:
                yield mix((words[at : at + c] * WEIGHTS[:c]).sum(keepdims=True, dtype=np.uint64) ^ SHORT[c])
            else:
                yield words[:0]
            at += c
        k = stop
