"""Fill-in-middle transformation: each text is cut into prefix, middle and suffix, which are put in another order.

Texts are decoded to UTF-32 codepoint arrays in tasks. The classes of neighbouring code points tell where units end;
two ranks per document choose the boundaries at which its pieces begin; the pieces are sliced and encoded again. The
original text comes back from the output alone (restored()), with functions of the JVM.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, small_batches, text_or_empty

#: What marks prefix, suffix and middle in an output.
SENTINELS = ("<P>", "<S>", "<M>")
UNITS = ("lines", "words", "chars")
SPACE_POINTS = np.array([9, 10, 11, 12, 13, 32], np.uint32)


@dataclass(frozen=True)
class Plan:
    """Of each document, columns of whole numbers: two ranks (each is taken modulo the number of boundaries), whether the
    form is plain anyhow, and whether it is suffix-first (spm) rather than prefix-first (psm)."""

    first: Column
    second: Column
    plain: Column
    suffix_first: Column


def plan_of(id_col: Column, seed: int = 0, percent: int = 100, percent_spm: int = 50) -> Plan:
    """Ranks and forms by the hex SHA-256 of `<seed>:<id>`: its first four groups of eight digits. The same document gets
    the same cut wherever it is worked on. A null id counts as the empty text."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digits, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    return Plan(h[0], h[1], h[2] % 100 >= percent, h[3] % 100 < percent_spm)


def boundaries(points: np.ndarray, unit: str) -> np.ndarray:
    """The offsets at which units end, in order; the last is the length of the text. A line ends after its newline, a
    word where white space begins or ends, a char after each code point."""
    if unit == "chars":
        return np.arange(1, len(points) + 1)
    if unit == "lines":
        kind = points == 10
        ends = kind[:-1]  # whatever follows a newline begins a line
    else:
        kind = np.isin(points, SPACE_POINTS)
        ends = kind[:-1] != kind[1:]
    at = np.flatnonzero(ends) + 1
    return np.append(at, len(points)) if len(points) else at


def cut(text: str, unit: str, first: int, second: int) -> tuple[int, int, int]:
    """The number of units, and the offsets at which the middle begins and ends."""
    ends = boundaries(np.frombuffer(text.encode("utf-32-le"), np.uint32), unit)
    low, high = sorted((first % (len(ends) + 1), second % (len(ends) + 1)))
    at = lambda k: int(ends[k - 1]) if k else 0
    return len(ends), at(low), at(high)


def transform(docs: DataFrame, plan: Plan, text_col: str = "text", keep=("doc_id",), unit: str = "lines", sentinels=SENTINELS) -> DataFrame:
    """The columns of `keep`, n (units of the text), form (plain, psm or spm), prefix_chars, middle_chars (code points; null
    if plain), output.

    psm: P prefix S suffix M middle; spm: S suffix P prefix M middle; plain: the text. A text that is null counts as empty;
    an empty text, or one that holds a sentinel, is plain. One row per row of the table, repeated rows and null ids
    included; an empty table gives an empty result. Very long texts are transformed whole, one at a time. Columns of `keep`
    have other names than those that are added.
    """
    added = {"n", "form", "prefix_chars", "middle_chars", "output"} & {c.lower() for c in keep}
    if added:
        raise ValueError(f"columns that are added here: {', '.join(sorted(added))}")
    if unit not in UNITS:
        raise ValueError(f"unknown unit: {unit}")
    small_batches(docs.sparkSession)
    p, s, m = (np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in sentinels)

    def pieces(batches):
        import pyarrow as pa

        for batch in batches:
            own, (text, first, second, plain, spm) = batch.columns[:-5], batch.columns[-5:]
            n, form, before, inside, output = [], [], [], [], []
            for t, a, b, as_is, back in zip(text, first.to_pylist(), second.to_pylist(), plain.to_pylist(), spm.to_pylist(), strict=True):
                t = t.as_py()
                units, low, high = cut(t, unit, a, b)
                n.append(units)
                if not t or as_is or any(x in t for x in sentinels):
                    form.append("plain")
                    before.append(None)
                    inside.append(None)
                    output.append(t)
                    continue
                points = np.frombuffer(t.encode("utf-32-le"), np.uint32)
                prefix, middle, suffix = points[:low], points[low:high], points[high:]
                parts = (s, suffix, p, prefix, m, middle) if back else (p, prefix, s, suffix, m, middle)
                form.append("spm" if back else "psm")
                before.append(low)
                inside.append(high - low)
                output.append(np.concatenate(parts).tobytes().decode("utf-32-le"))
            named = dict(zip(batch.schema.names[:-5], own, strict=True))
            yield pa.record_batch(named | {"n": pa.array(n, pa.int64()), "form": pa.array(form, pa.string()), "prefix_chars": pa.array(before, pa.int64()), "middle_chars": pa.array(inside, pa.int64()), "output": pa.array(output, pa.string())})

    inner = [fresh(docs, f"_{x}") for x in ("text", "first", "second", "plain", "spm")]
    given = (text_or_empty(F.col(text_col)), plan.first, plan.second, F.coalesce(plan.plain, F.lit(False)), F.coalesce(plan.suffix_first, F.lit(False)))
    rows = docs.select(*keep, *(c.alias(name) for name, c in zip(inner, given, strict=True)))
    shape = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[: len(keep)])
    return rows.mapInArrow(pieces, f"{shape}n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, sentinels=SENTINELS) -> Column:
    """The original text. Outside their three places an output that isn't plain holds no sentinel."""
    parts = F.split(output, "|".join(map(re.escape, sentinels)), -1)
    piece = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(piece(1), piece(3), piece(2))).when(form == "spm", F.concat(piece(2), piece(3), piece(1))).otherwise(output)
