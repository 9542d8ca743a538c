import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphquarry.llm import fill_in_middle, queries_words, spelling_variants

SHAPE = "doc_id long, text string, word string, n string, output string"


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped_by_hand(counts):
    out = []
    form = {}
    for w, n in counts.items():
        others = [x for x in counts if near(w, x)]
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
        out.append([w, form[w], w, n, len(others), counts[form[w]] if form[w] else None])
    for row in out:
        while form[row[2]]:
            row[2] = form[row[2]]
    return sorted(map(tuple, out))


def counts(seed=1, letters="abé", n=400):
    r = random.Random(seed)
    found = {"".join(r.choice(letters) for _ in range(r.randint(5, 9))): r.choice([3, 3, 4, 6, 9, 20, 50]) for _ in range(n)}
    return found | {"a" * 8: 5, "a" * 9: 5, "a" * 7: 40, "𝒳bcde": 3, "𝒳bcdé": 8, "x" * 3000: 3, "x" * 2999: 9}


@pytest.mark.parametrize(("hot", "task_rows"), [(50_000, 100_000), (7, 100)])
def test_variants_equal_brute_force(spark, hot, task_rows):
    own = counts()
    df = spark.createDataFrame([(w, n, "y") for w, n in own.items()] + [(None, 9, "y")], "word string, n long, form string")
    out = spelling_variants.variants(df, hot=hot, task_rows=task_rows)
    assert sorted(map(tuple, out.collect())) == grouped_by_hand(own)
    assert spelling_variants.variants(df.limit(0)).count() == 0


def test_forms_are_followed_to_the_last(spark):
    own = {"abcdefgh"[:8] + "z" * 6: 3}
    w = list(next(iter(own)))
    for k in range(8):
        w[k] = "q"
        own["".join(w)] = 3 * 2 ** (k + 1)
    df = spark.createDataFrame(list(own.items()), "word string, n long")
    out = spelling_variants.variants(df).collect()
    assert {r["root"] for r in out} == {"q" * 8 + "z" * 6} and sum(r["form"] is None for r in out) == 1


def test_wavelet_tree_reports_all_points_of_rectangles():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 64, 100):
        values = rng.permutation(n)
        tree = spelling_variants.WaveletTree(values)
        box = np.sort(rng.integers(0, n + 1, (4, 50, 2)), axis=2)
        left, right, low, high = box[0, :, 0], box[0, :, 1], box[1, :, 0], box[1, :, 1]
        which, value = tree.report(left, right, low, high)
        want = {(k, int(v)) for k in range(50) for v in values[left[k] : right[k]] if low[k] <= v < high[k]}
        assert set(zip(which.tolist(), value.tolist(), strict=True)) == want and len(which) == len(want)


def words_by_hand(rows):
    found = Counter()
    for i, t in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def test_op11_over_odd_texts_equals_brute_force(spark, tmp_path):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcÉé") for _ in range(r.randint(3, 7)))
    rows = [(k % 50, " ".join(word() for _ in range(60))) for k in range(120)]
    rows += [(None, None), (3, None), (None, "abcab abcab,abcab"), (4, ""), (5, "×÷×÷× ×÷×÷× ×÷×÷×"), (6, "aaaaaa " * 5000), (7, "abcd" * 3000), rows[0], rows[0]]
    spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SHAPE).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries_words.op11_spelling_variants(spark, str(tmp_path))
    assert sorted(map(tuple, out.select("word", "form", "root", "n", "n_near", "form_n").collect())) == grouped_by_hand(words_by_hand(rows))


def middle_by_hand(i, text, unit="lines"):
    t = text or ""
    pattern = {"lines": r"[^\n]*\n|[^\n]+", "words": r"[ \t-\r]+|[^ \t-\r]+", "chars": r"[\s\S]"}[unit]
    units = re.findall(pattern, t)
    h = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")):
        return (i, len(units), "plain", None, None, t, t)
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 50 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return (i, len(units), form, len(p), len(m), out, t)


@pytest.mark.parametrize("unit", fill_in_middle.UNITS)
def test_middles_equal_brute_force_and_come_back(spark, unit):
    texts = [None, "", "\n", "\n\n\n", "a", "a\nb", "a\nb\n", "𝒳é\n\r\nß\n", "x <M> y\nz", "<P\n>P>\n<\nS>", "<M\n>\n<S\n<", "l\n" * 30_000, "no newline " * 20_000, " \x85\x0b\nq\x00r\ns"]
    rows = [(k % 40, t) for k, t in enumerate(texts * 6)] + [(None, "a\nb\nc"), (2, "q\nr"), (2, "q\nr")]
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SHAPE).withColumns({f"_{c}": F.lit(1) for c in ("text", "first", "plain", "spm")})
    out = fill_in_middle.transform(df, fill_in_middle.plan_of(F.col("doc_id"), seed=7), unit=unit, keep=("doc_id", "_text"))
    assert out.columns[:2] == ["doc_id", "_text"]
    got = out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(map(tuple, got), key=str) == sorted((middle_by_hand(i, t, unit) for i, t in rows), key=str)
    assert fill_in_middle.transform(df.limit(0), fill_in_middle.plan_of(F.col("doc_id"))).count() == 0


def test_middles_of_a_share_and_refusals(spark):
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a\nb").alias("text"))
    forms = Counter(r["form"] for r in fill_in_middle.transform(df, fill_in_middle.plan_of(F.col("doc_id"), percent=30, percent_spm=0)).collect())
    assert 80 < forms["psm"] < 160 and forms["psm"] + forms["plain"] == 400
    with pytest.raises(ValueError):
        fill_in_middle.transform(df, fill_in_middle.plan_of(F.col("doc_id")), unit="pages")
    with pytest.raises(ValueError):
        fill_in_middle.transform(df.withColumn("form", F.lit(1)), fill_in_middle.plan_of(F.col("doc_id")), keep=("form",))
