"""Text functions: terms, redaction, normalisation."""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that carry no meaning in a question.
STOP_WORDS = tuple(
    "where what how why which who is are the a an of to in on for and or does do can i we it this that implemented "
    "implementation logic code function method file module explain describe tell me checked raised handled".split()
)
#: What secrets look like, and names that secrets are assigned to.
SECRET_SHAPES = (
    r"\bAKIA[0-9A-Z]{16}\b",
    r"\bgh[pousr]_[A-Za-z0-9]{36,}\b",
    r"\bxox[abprs]-[A-Za-z0-9-]{10,}\b",
    r"\bsk-[A-Za-z0-9_-]{20,}\b",
)
SECRET_MARKERS = (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"\bAKIA[0-9A-Z]{16}\b", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b", r"\bsk-[A-Za-z0-9_-]{20,}\b")
PRIVATE_KEY = r"(?s)-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----.*?-----END [A-Z0-9 ]*PRIVATE KEY-----"
SECRET_NAME = r"""(?i)(\b(?:[A-Za-z0-9]+[_-])*(?:api[_-]?key|secret|token|passw(?:or)?d|credential|authorization)(?:[_-][A-Za-z0-9]+)*\b['"]?\s*[:=]\s*)"""
QUOTED_SECRET = SECRET_NAME + r"""(["'])[^'"\n]{8,}\2"""
#: A bare value is no identifier or path of attributes, so that code stays.
BARE_SECRET = SECRET_NAME + r"(?![A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*\s*(?![A-Za-z0-9_./+=-]))[A-Za-z0-9_./+=-]{8,}"
ENVIRONMENT_SECRET = r"""(?im)^(\s*(?:API[_-]?KEY|SECRET(?:[_-]?KEY)?|TOKEN|ACCESS[_-]?TOKEN|REFRESH[_-]?TOKEN|CLIENT[_-]?SECRET|PASSWORD|PASSWD|CREDENTIAL|AUTHORIZATION)\s*=\s*)([^\s"']+)\s*$"""
SECRET_FIELD = r"(?i)(?:api[_-]?key|secret(?:[_-]?key)?|token|access[_-]?token|refresh[_-]?token|client[_-]?secret|password|passwd|credential|authorization)"
BEARER, JWT = r"(?i)\bBearer\s+[A-Za-z0-9._~+/-]{8,}=*", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b"
#: The tokens of the keyword index, and the BM25 parameters.
TOKEN = r"[\p{L}\p{N}]+"
K1, B = 1.2, 0.75


@functools.cache
def accents() -> tuple[str, str]:
    """Letters that are another letter with marks, and those letters, by Unicode's canonical decomposition."""
    marked, bare = [], []
    for c in map(chr, range(0xC0, 0xFFFF)):
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and parts[0].isalpha() and all(unicodedata.category(x) == "Mn" for x in parts[1:]):
            marked.append(c)
            bare.append(parts[0])
    return "".join(marked), "".join(bare)


def folded(text: Column) -> Column:
    """Lower case without accents; null counts as empty. A text of ASCII only has none to look for."""
    marked, bare = accents()
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(F.octet_length(text) == F.length(text), low).otherwise(F.translate(F.regexp_replace(low, r"\p{Mn}+", ""), marked, bare))


def tokens(text: Column) -> Column:
    """The tokens of the keyword index, in order."""
    return F.regexp_extract_all(folded(text), F.lit(TOKEN), F.lit(0))


def token_line(text: Column) -> Column:
    """The tokens in order, with one blank before and one behind each."""
    return F.concat(F.lit(" "), F.regexp_replace(folded(text), r"[^\p{L}\p{N}]+", "  "), F.lit(" "))


def n_tokens(line: Column) -> Column:
    """The number of tokens of a token line."""
    return F.regexp_count(line, F.lit(TOKEN))


def n_phrase(line: Column, phrase: list[str]) -> Column:
    """How often a token line holds tokens that follow one another."""
    inside = " " + "  ".join(phrase) + " "
    if len(phrase) > 1 and phrase[0] == phrase[-1]:  # it may overlap itself
        return F.regexp_count(line, F.lit(f"(?={inside})"))
    return ((F.length(line) - F.length(F.replace(line, F.lit(inside)))) / len(inside)).cast("int")


def phrase_of(term: str) -> list[str]:
    """The tokens of a term of a question; more than one are a phrase, as in snake_case."""
    plain = "".join(c for c in unicodedata.normalize("NFD", term.lower()) if unicodedata.category(c) != "Mn")
    found, word = [], ""
    for c in unicodedata.normalize("NFC", plain) + " ":
        if unicodedata.category(c)[0] in "LN":
            word += c
        elif word:
            found.append(word)
            word = ""
    return found


def camel_terms(name: Column) -> Column:
    """camelCase and snake_case as separate words."""
    split = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2")
    return F.trim(F.regexp_replace(F.regexp_replace(split, "_", " "), r"\s+", " "))


def without_stop_words(words: Column) -> Column:
    return F.filter(words, lambda w: ~F.lower(w).isin(*STOP_WORDS))


def query_terms(text: Column, most: int = 32) -> Column:
    """Distinct tokens of a question in order, the first ones."""
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\w+"), F.lit(0))), 1, most)


def has_secret(text: Column) -> Column:
    hit = F.lit(False)
    for p in SECRET_MARKERS:
        hit = hit | text.rlike(p)
    return hit


def redact(text: Column) -> Column:
    """Secrets become [REDACTED]; the number of lines stays, also inside private keys."""
    out = redact_blocks(text)
    for p in SECRET_SHAPES:
        out = F.regexp_replace(out, p, "[REDACTED]")
    out = F.regexp_replace(out, QUOTED_SECRET, "$1$2[REDACTED]$2")
    return F.regexp_replace(out, BARE_SECRET, "$1[REDACTED]")


def redact_blocks(text: Column) -> Column:
    """Private key blocks: as many line ends remain as the block had."""
    blocks = F.regexp_extract_all(text, F.lit(PRIVATE_KEY), F.lit(0))
    return F.aggregate(blocks, text, lambda acc, b: F.replace(acc, b, F.concat(F.lit("[REDACTED]"), F.regexp_replace(b, r"[^\n]+", ""))))


def redact_for_display(text: Column) -> Column:
    """Also values of environment settings, bearer tokens and web tokens."""
    out = F.regexp_replace(without_controls(redact(text)), ENVIRONMENT_SECRET, "$1[REDACTED]")
    out = F.regexp_replace(out, BEARER, "Bearer [REDACTED]")
    return F.regexp_replace(out, JWT, "[REDACTED]")


def redact_values(fields: Column) -> Column:
    """A map of names to texts as it may be shown: values of fields that are named like secrets go whole."""
    return F.transform_values(fields, lambda k, v: F.when(k.rlike(f"^{SECRET_FIELD}$"), F.lit("[REDACTED]")).otherwise(redact_for_display(v)))


def without_controls(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def contains_literal(line: Column, literal: Column) -> Column:
    """Containment that ignores case and white space."""
    plain = lambda c: F.regexp_replace(F.lower(c), r"\s+", "")
    return F.contains(plain(line), plain(literal))


def lines(text: Column, first: Column, last: Column) -> Column:
    """The lines first to last (from 1) of a text."""
    return F.array_join(F.slice(F.split(text, "\n", -1), first, F.greatest(last - first + 1, F.lit(0))), "\n")


def line_of(text: Column, offset: Column) -> Column:
    """The line, from 1, of a character offset from 0."""
    head = F.substring(text, F.lit(1), offset)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"))) + 1


def excerpt(text: Column, most: int) -> Column:
    return F.substring(text, 1, most)


def embedding_text(path: Column, language: Column, qualified: Column, kind: Column, signature: Column, comments: Column, source: Column) -> Column:
    line = lambda name, value: F.concat(F.lit(f"{name}: "), F.coalesce(value, F.lit("")))
    return F.concat_ws(
        "\n",
        line("File", path),
        line("Language", language),
        line("Symbol", qualified),
        line("Kind", kind),
        line("Signature", excerpt(signature, 200)),
        line("Meaning terms", camel_terms(qualified)),
        line("Comments", excerpt(comments, 300)),
        source,
    )


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility normalisation and single blanks. Spark has no built-in for it."""
    import unicodedata

    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()))


@F.pandas_udf(StringType())
def casefold(text: pd.Series) -> pd.Series:
    return text.str.casefold()
