"""Quality rules as a short-circuit cascade. DataFrame operations only.

Each rule is a condition that rejects a document. On a bounded sample the cascade measures what each rule costs and how
many documents it rejects, and orders the rules by rejection per cost. The verdict is a CASE chain in that order: a
document that an early rule rejects never reaches the later ones. The order changes the cost and never the verdict.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, SPACES, fresh, text_or_empty, words_of

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5


@dataclass(frozen=True)
class Rule:
    """`rejects` gets a function from a measurement's name to its column; `needs` has the names that it asks for."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[[Callable[[str], Column]], Column]


#: Thresholds of the rules beside the base ones; each leaves ordinary prose, lists and dialogue alone.
RULES = (
    Rule("too_few_words", ("n_words",), lambda m: m("n_words") < MIN_WORDS),
    Rule("repeated_passages", ("n_repeat_words", "n_words"), lambda m: 100 * m("n_repeat_words") > MAX_REPEAT_PERCENT * m("n_words")),
    Rule("symbols", ("n_symbols", "n_words"), lambda m: 10 * m("n_symbols") > 3 * m("n_words")),
    Rule("repeated_lines", ("n_dup_lines", "n_lines"), lambda m: 10 * m("n_dup_lines") > 6 * m("n_lines")),
    Rule("word_length", ("word_chars", "n_words"), lambda m: (m("word_chars") < 2 * m("n_words")) | (m("word_chars") > 20 * m("n_words"))),
    Rule("upper_case", ("n_upper", "word_chars"), lambda m: 10 * m("n_upper") > 4 * m("word_chars")),
    Rule("stuttering", ("n_stutter", "n_words"), lambda m: 10 * m("n_stutter") > 3 * m("n_words")),
)
BASE = ("too_few_words", "repeated_passages")


def base_failed(measurement: Callable[[str], Column]) -> Column:
    few, repeated = (r.rejects(measurement) for r in RULES if r.name in BASE)
    return few | repeated


def without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def repeat_words(words: Column, width: int = WINDOW) -> Column:
    """Words inside windows of `width` words that the text has twice or more, the first time included."""
    last = width - 1
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(width))))
    # let-binding: a lambda variable is evaluated once, an outer expression inside a lambda once per element
    bound = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)

    def covered(h: Column) -> Column:
        def positions(s: Column) -> Column:
            at = lambda k: F.get(s, k)["h"]
            twins = F.filter(
                F.sequence(F.lit(0), F.size(s) - 1),
                lambda k: F.coalesce(at(k) == at(k - 1), F.lit(False)) | F.coalesce(at(k) == at(k + 1), F.lit(False)),
            )
            return F.array_sort(F.transform(twins, lambda k: F.get(s, k)["i"]))

        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        start = F.struct(F.lit(-width).cast("int").alias("seen"), F.lit(0).cast("int").alias("total"))
        return F.aggregate(
            bound(ordered, positions),
            start,
            lambda a, i: F.struct(i.alias("seen"), (a["total"] + F.least(F.lit(width), i - a["seen"])).alias("total")),
            lambda a: a["total"],
        )

    found = bound(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(words) <= last, F.lit(0)).otherwise(found).cast("long")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def measurements(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    letters = F.length(without(text, SPACES))
    pairs = F.zip_with(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), words, lambda b, a: F.when(a == b, 1))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": letters.cast("long"),
        "n_symbols": (F.length(text) - F.length(without(text, SYMBOLS))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeat_words(words),
        "n_upper": (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}", ""))).cast("long"),
        "n_stutter": F.size(F.array_compact(pairs)).cast("long"),
    }


def with_parts(docs: DataFrame, text_col: str) -> tuple[DataFrame, dict[str, Column], list[str]]:
    """The table with text, words and lines made once for all measurements; the measurements; the names that were added."""
    text = text_or_empty(F.col(text_col))
    names = [fresh(docs, n) for n in ("_text", "_words", "_lines")]
    parts = (text, words_of(F.col(text_col)), lines_with_words(text))
    return docs.withColumns(dict(zip(names, parts, strict=True))), measurements(*map(F.col, names)), names


def measured(docs: DataFrame, names, text_col: str) -> DataFrame:
    """Add the named measurements."""
    base, have, added = with_parts(docs, text_col)
    return base.withColumns({n: have[n] for n in names}).drop(*added)


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    seconds: float
    rejected: float


#: What a measurement takes beyond the words and lines that all rules share: seconds for each code point, word or line of a
#: text, and of a rule for each row. Measured on one core; the order only depends on their ratios.
WORK = {"n_words": {}, "n_lines": {}, "word_chars": {"chars": 57e-9}, "n_symbols": {"chars": 53e-9}, "n_upper": {"chars": 80e-9}, "n_stutter": {"words": 200e-9}, "n_repeat_words": {"words": 1400e-9}, "n_dup_lines": {"lines": 1900e-9}}
ROW = 50e-9


def estimate(docs: DataFrame, rules=RULES, text_col: str = "text", sample_rows: int = 500, keep=()) -> list[Estimate]:
    """Cost and selectivity of each rule on a sample of about `sample_rows` rows (the stated bound) from all partitions,
    in one job. Only the order of evaluation depends on it.

    A rule costs what its measurements take on the texts of the sample, by their code points, words and lines.
    Measurements of `keep` are taken for every row anyhow and cost nothing more.
    """
    rows = docs.count()
    sample = docs.select(F.col(text_col).alias("text"))
    sample = sample if rows <= sample_rows else sample.sample(sample_rows / rows, seed=11)
    base, have, added = with_parts(sample, "text")
    sizes = {"chars": F.length(added[0]), "words": F.size(added[1]), "lines": F.size(added[2])}
    base = base.withColumns({fresh(base, f"_{k}"): c for k, c in sizes.items()})
    names = dict(zip(sizes, base.columns[-len(sizes) :], strict=True))
    row = base.agg(F.count(F.lit(1)), *(F.coalesce(F.sum(F.col(names[k]).cast("long")), F.lit(0)) for k in sizes), *(F.count_if(r.rejects(have.__getitem__)) for r in rules)).first()
    total, size, hits = row[0], dict(zip(sizes, row[1:4], strict=True)), row[4:]
    out = []
    for rule, hit in zip(rules, hits, strict=True):
        seconds = ROW * max(1, total) + sum(unit * size[k] for n in rule.needs if n not in keep for k, unit in WORK[n].items())
        out.append(Estimate(rule, seconds, hit / max(1, total)))
    return out


def ordered(estimates: list[Estimate]) -> list[Rule]:
    """Most rejections for each second first; among rules that reject nothing in the sample, the cheapest."""
    return [e.rule for e in sorted(estimates, key=lambda e: (-e.rejected / e.seconds, e.seconds))]


def cascade(docs: DataFrame, rules=RULES, text_col: str = "text", order=None, sample_rows: int = 500, keep=()) -> DataFrame:
    """The documents with `failed_rule` (the first rule of the order that rejects; null if none) and `kept`.

    `keep` names measurements that are wanted as columns; all others are taken inside the chain, only for documents that
    no earlier rule has rejected. So the more measurements are kept, the less the cascade can save. Columns of the table
    stay as they are; one of a name that is added here is replaced. Repeated rows and null ids are passed on. A null or
    empty text has no words and is rejected. An empty table gives an empty result.
    """
    order = list(order or ordered(estimate(docs, rules, text_col, sample_rows, keep)))
    base, have, added = with_parts(docs, text_col)
    base = base.withColumns({n: have[n] for n in keep})
    value = lambda n: F.col(n) if n in keep else have[n]
    verdict = F
    for rule in order:
        verdict = verdict.when(rule.rejects(value), F.lit(rule.name))
    out = base.withColumn("failed_rule", verdict)
    return out.withColumn("kept", F.col("failed_rule").isNull()).drop(*added)
