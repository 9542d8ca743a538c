"""Language identification by interpolated Kneser-Ney character models.

Letters are lower-cased; each run of other characters is one blank. For every language, 4-gram counts of a bounded sample
of labelled documents give an interpolated Kneser-Ney model: lower orders from continuation counts, one absolute discount
for each order. The models of all languages lie side by side in arrays sorted by n-gram hash: one search finds the
probability in every language. The lowest length-normalised cross-entropy wins; a document whose best cross-entropy is
above what the language's own texts reach, by a bound calibrated on part of the sample left out of the model, is marked.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .shingles import mix

ORDER = 4
EDGE, BLANK = 1, 2
#: At most about so many documents of each language are learned from; the model holds every n-gram of them.
SAMPLE_DOCS = 1_000
UNKNOWN = "und"
#: Characters worked on at once.
WINDOW = 1 << 20

_symbols: list[np.ndarray] = []


def symbols() -> np.ndarray:
    """The 16-bit symbol of each code point."""
    if not _symbols:
        table = np.full(0x110000, BLANK, np.uint16)
        for c in range(0x110000):
            if chr(c).isalpha():
                table[c] = c if 2 < c < 0xFFFF else 0xFFFF
        table[0] = EDGE
        _symbols.append(table)
    return _symbols[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Packed 4-grams of all texts (16 bits a symbol, the last symbol lowest), and the text that each belongs to.

    Before a text stand three edges. Edges are contexts and never predicted.
    """
    joined = "".join("\0\0\0" + t.replace("\0", " ") for t in texts).lower()
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    s = symbols()[points]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != BLANK) | ((s[:-1] != BLANK) & (s[:-1] != EDGE))
    s = s[keep].astype(np.uint64)
    if len(s) < ORDER:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    code = s[3:] | (s[2:-1] << np.uint64(16)) | (s[1:-2] << np.uint64(32)) | (s[:-3] << np.uint64(48))
    own = s[3:] != EDGE
    return code[own], np.cumsum(s == EDGE)[3:][own] // 3 - 1


def windows(texts: list[str]):
    """Slices of texts that hold about WINDOW characters each; a long text is cut, and each
    part begins with edges as a text does: of every WINDOW characters three are predicted from a shorter context."""
    part, owner, size = [], [], 0
    for k, t in enumerate(texts):
        for at in range(0, max(1, len(t)), WINDOW):
            part.append(t[at : at + WINDOW])
            owner.append(k)
            size += len(part[-1])
            if size >= WINDOW:
                yield part, owner
                part, owner, size = [], [], 0
    if part:
        yield part, owner


def find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of each key in a sorted array, or -1."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return np.where(table[at] == keys, at, -1)


class Model:
    """grams[k], logp[k]: hashes of order k + 1, sorted, and a row of log probabilities over the languages; contexts[k],
    backoff[k]: the same for the weight that a context leaves to the next lower order."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.languages = sorted(counts)
        n_lang = len(self.languages)
        self.grams, self.logp, self.contexts, self.backoff = [], [], [], []
        levels: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for lang, (code, n) in counts.items():
            own = [(code, n.astype(np.float64))]
            for k in range(ORDER - 1, 0, -1):
                lower, types = np.unique(own[0][0] & np.uint64((1 << (16 * k)) - 1), return_counts=True)
                own.insert(0, (lower, types.astype(np.float64)))
            levels[lang] = own
        below, below_p = None, None
        for k in range(ORDER):
            every = np.unique(np.concatenate([levels[x][k][0] for x in self.languages]))
            above = every >> np.uint64(16)
            ctx = np.unique(above)
            p, left = np.zeros((len(every), n_lang)), np.ones((len(ctx), n_lang))
            for j, lang in enumerate(self.languages):
                code, n = levels[lang][k]
                ones, twos = (n == 1).sum(), (n == 2).sum()
                cut = max(ones, 0.5) / max(ones + 2 * twos, 1.0)
                cut = min(max(cut, 0.1), 0.95)
                at = np.searchsorted(ctx, code >> np.uint64(16))
                total = np.bincount(at, n, len(ctx))
                types = np.bincount(at, minlength=len(ctx))
                seen = total > 0
                left[seen, j] = cut * types[seen] / total[seen]
                own = np.searchsorted(every, code)
                p[own, j] = np.maximum(n - cut, 0) / total[at]
            weight = left[np.searchsorted(ctx, above)]
            p += weight * (below_p[np.searchsorted(below, every & np.uint64((1 << (16 * k)) - 1))] if k else 1.0 / 65536)
            below, below_p = every, p
            for names, rows, source, values in ((self.grams, self.logp, every, p), (self.contexts, self.backoff, ctx, left)):
                hashes = mix(source)
                order = np.argsort(hashes)
                names.append(hashes[order])
                rows.append(np.log(values[order]).astype(np.float32))
        self.bounds = np.full(n_lang, np.inf)

    def log_probabilities(self, code: np.ndarray) -> np.ndarray:
        """A row over the languages for each packed 4-gram."""
        out = np.zeros((len(code), len(self.languages)), np.float32)
        todo = np.arange(len(code))
        for k in range(ORDER - 1, -1, -1):
            own = code[todo] & np.uint64((1 << (16 * (k + 1))) - 1)
            at = find(self.grams[k], mix(own))
            hit = at >= 0
            out[todo[hit]] += self.logp[k][at[hit]]
            todo, own = todo[~hit], own[~hit]
            if not len(todo):
                break
            if k:
                at = find(self.contexts[k], mix(own >> np.uint64(16)))
                hit = at >= 0
                out[todo[hit]] += self.backoff[k][at[hit]]
            else:
                out[todo] += np.float32(np.log(1.0 / 65536 / 4))
        return out

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text: nats a symbol in each language, and the number of symbols."""
        total, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for part, owner in windows(texts):
            code, text = grams(part)
            if not len(code):
                continue
            rows = self.log_probabilities(code)
            starts = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
            to = np.asarray(owner)[text[starts]]
            np.add.at(total, to, np.add.reduceat(rows, starts, axis=0, dtype=np.float64))
            np.add.at(n, to, np.diff(np.r_[starts, len(text)]))
        return -total / np.maximum(n, 1)[:, None], n

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score (the share of the best language, over at most 30 symbols) and whether it is within bounds."""
        entropy, n = self.cross_entropies(texts)
        best = entropy.argmin(1)
        lead = np.exp(-(entropy - entropy.min(1, keepdims=True)) * np.minimum(n, 30)[:, None])
        letters = np.array([any(map(str.isalpha, t)) for t in texts], bool)
        names = [self.languages[b] if has else UNKNOWN for b, has in zip(best, letters, strict=True)]
        score = np.where(letters, 1.0 / lead.sum(1), 0.0)
        within = letters & (entropy.min(1) <= self.bounds[best])
        return names, score, within


def counted(rows: DataFrame) -> DataFrame:
    """lang, code, n: 4-gram counts of the rows' texts."""

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                for part, _ in windows([t for x, t in zip(langs, texts, strict=True) if x == lang]):
                    code, n = np.unique(grams(part)[0], return_counts=True)
                    yield pa.record_batch({"lang": pa.array([lang] * len(code), pa.string()), "code": pa.array(code.view(np.int64)), "n": pa.array(n, pa.int64())})

    table = rows.select("lang", "text").mapInArrow(count, "lang string, code long, n long")
    return table.groupBy("lang", "code").agg(F.sum("n").alias("n"))


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """Learn from at most about `sample_docs` documents of each language (the stated bound), chosen by a hash of the id (of the
    text where there is no id).

    Rows without text or language are left out. One document in five of the sample only calibrates the bounds. None if
    there is nothing to learn from.
    """
    instead = F.when(F.col(id_col).isNull(), F.col(text_col))  # a hash leaves nulls out
    rows = train.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.pmod(F.xxhash64(id_col, instead, F.lit(5)), F.lit(1 << 30)).alias("u"))
    known = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # as many rows as languages
    if not sizes:
        return None
    share = F.create_map(*(x for k, v in sizes.items() for x in (F.lit(k), F.lit(int(min(1.0, sample_docs / v) * (1 << 30))))))
    chosen = known.where(F.col("u") < F.element_at(share, F.col("lang")))
    left_out = F.pmod(F.col("u"), F.lit(5)) == 4
    table = counted(chosen.where(~left_out)).toArrow()  # the distinct 4-grams of the bounded sample
    table = table if table.num_rows else counted(chosen).toArrow()
    if not table.num_rows:
        return None
    lang = table.column("lang").combine_chunks().dictionary_encode()
    owner = lang.indices.to_numpy()
    code, n = table.column("code").to_numpy().view(np.uint64), table.column("n").to_numpy()
    order = np.lexsort((code, owner))
    edges = np.searchsorted(owner[order], np.arange(len(lang.dictionary) + 1))
    parts = [order[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    model = Model({x: (code[part], n[part]) for x, part in zip(lang.dictionary.to_pylist(), parts, strict=True)})
    shared = train.sparkSession.sparkContext.broadcast(model)

    def own_entropy(batches):
        import pandas as pd

        for batch in batches:
            entropy, n = shared.value.cross_entropies(batch["text"].tolist())
            at = {x: k for k, x in enumerate(shared.value.languages)}
            own = [entropy[i, at[x]] if x in at else np.nan for i, x in enumerate(batch["lang"])]
            yield pd.DataFrame({"lang": batch["lang"], "h": own, "n": n})

    tried = chosen.where(left_out).select("lang", "text").mapInPandas(own_entropy, "lang string, h double, n double")
    for r in tried.where("n >= 20 AND NOT isnan(h)").groupBy("lang").agg(F.avg("h").alias("m"), F.stddev_pop("h").alias("s"), F.count("h").alias("k")).collect():
        if r["k"] >= 10:
            model.bounds[model.languages.index(r["lang"])] = r["m"] + 4 * r["s"] + 0.1
    return model


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", keep=("doc_id",)) -> DataFrame:
    """The columns of `keep`, lang_pred, score (0 to 1) and confident (the cross-entropy is within the calibrated bound).

    One row per row of the table, repeated rows and null ids included. A text that is null or has no letter is `und` with
    score 0; without a model all are. An empty table gives an empty result. Columns of `keep` have other names than those
    that are added.
    """
    added = {"lang_pred", "score", "confident"} & set(keep)
    if added:
        raise ValueError(f"columns that are added here: {', '.join(sorted(added))}")
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by sample_docs and the number of languages

    def predict(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            if shared.value is None:
                names, score, within = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            else:
                names, score, within = shared.value.predict(texts)
            own = {f: batch.column(k) for k, f in enumerate(batch.schema.names[:-1])}
            yield pa.record_batch(own | {"lang_pred": pa.array(names, pa.string()), "score": pa.array(score), "confident": pa.array(within)})

    rows = docs.select(*keep, F.col(text_col).alias("".join(keep) + "_text"))  # a name that none of them has
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(predict, f"{shape}, lang_pred string, score double, confident boolean")
