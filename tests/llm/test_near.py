import random
import re

import numpy as np
import pytest

from graphquarry.llm import minhash_dedup, shingles

SHAPE = "doc_id long, text string, component_id string, key string"


def sets_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [(i, sets_of(t)) for i, t in rows]
    comp = {i: i for i, _ in rows}
    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x
    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((root(i), root(j)))
                comp[y] = x
    return sorted((i, len(s), root(i), root(i) == i) for i, s in sets)


def corpus(seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    rows = []
    for base in range(6):
        words = [word() for _ in range(r.choice([7, 40, 120]))]
        for _ in range(30 if base else 120):
            own = list(words)
            for _ in range(r.randint(0, max(1, len(own) // 12))):
                own[r.randrange(len(own))] = word()
            rows.append(" ".join(own))
    rows += [" ".join(word() for _ in range(50)) for _ in range(40)]
    rows += [None, "", "  \n", "a b", "A  b", "a b c", "a b c d", "a b c d e", "x y z w v u", "É é", "é É", rows[0].upper(), rows[5] + " ", "w " * 5000]
    return list(enumerate(rows))


@pytest.mark.parametrize(("pair_limit", "block"), [(64, 256), (2, 16)])
def test_components_equal_brute_force(spark, pair_limit, block):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SHAPE)
    out = minhash_dedup.near_duplicates(df, pair_limit=pair_limit, block=block)
    assert sorted(map(tuple, out.collect())) == brute(rows)


def test_null_ids_repeats_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d e f", None, None), (5, "a b c d e f", "x", "y"), (5, "a b c d e f", "x", "y"), (9, "a b c d e f", "x", "y")], SHAPE)
    out = sorted(map(tuple, minhash_dedup.near_duplicates(df).collect()), key=str)
    assert out == sorted([(None, 2, None, True), (5, 2, 5, True), (5, 2, 5, True), (9, 2, 5, False)], key=str)
    assert minhash_dedup.near_duplicates(df.limit(0)).count() == 0
    assert minhash_dedup.survivors(df).columns == df.columns
    assert minhash_dedup.survivors(df).where("doc_id = 9").count() == 0


@pytest.mark.parametrize("turn", [1, -1])
def test_an_id_with_several_texts_is_linked_through_each(spark, turn):
    w = [" ".join(f"w{k}x{j}" for j in range(40)) for k in range(4)]
    rows = [(1, w[0]), (1, w[1]), (2, w[0] + " z"), (3, w[1] + " z"), (7, w[2]), (8, w[2]), (8, w[3]), (9, w[3] + " z"), (10, "q r s t u v")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows[::turn]], SHAPE)
    out = {(r["doc_id"], r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(df).collect()}
    assert out == {(i, r, i == r) for i, t, r, _ in [(i, None, {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 10: 10}[i], 0) for i, _ in rows]}


def test_few_pairs_over_the_similarity_agree_in_less_lanes_than_asked():
    """Measured at the least similarity: 20,000 pairs of sets with 0.75 of their union in common."""
    rng = np.random.default_rng(4)
    a, b = [], []
    for _ in range(20_000):
        s = rng.integers(0, 1 << 63, 80, dtype=np.uint64)
        a.append(s[:70])
        b.append(s[10:])
    lanes = (minhash_dedup.signature(a) == minhash_dedup.signature(b)).sum(axis=1)
    assert (lanes < minhash_dedup.MATCHES).mean() <= 1e-4 and (lanes < 25).mean() <= 1e-3


def test_words_over_window_edges(monkeypatch):
    import pyarrow as pa

    texts = ["ab cd  ef", "", None, "abc" * 50 + " d e f g h i", "\tA b\nC d e f", "q"] * 3
    whole = [s.tolist() for s in shingles.shingle_sets(pa.array(texts))]
    for size in (7, 16, 64):
        monkeypatch.setattr(shingles, "WINDOW", size)
        assert [s.tolist() for s in shingles.shingle_sets(pa.array(texts))] == whole
    assert [len(s) for s in whole] == [len(sets_of(t)) for t in texts]


def test_matches_counts_equal_lanes(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 16, (20, 48)).astype(np.uint16)
    b = np.where(rng.random((20, 48)) < 0.5, a, rng.integers(0, 1 << 16, (20, 48))).astype(np.uint16)
    b[0], b[1] = a[0], a[0] ^ 0x8000
    df = spark.createDataFrame([(x.view("<i8").tolist(), y.view("<i8").tolist(), int((x == y).sum())) for x, y in zip(a, b, strict=True)], "a array<long>, b array<long>, n int")
    from pyspark.sql import functions as F

    assert df.where(minhash_dedup.matches(F.col("a"), F.col("b")) != F.col("n")).count() == 0


def test_every_pair_within_the_distance_shares_a_key(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(200):
        a = rng.integers(0, 1 << 16, 48).astype(np.uint16)
        b = a.copy()
        b[rng.choice(48, 23, replace=False)] ^= 1
        rows.append((k, a.view("<i8").tolist(), b.view("<i8").tolist()))
    df = spark.createDataFrame(rows, "k int, a array<long>, b array<long>")
    from pyspark.sql import functions as F

    assert df.where(~F.arrays_overlap(minhash_dedup.keys_of(F.col("a")), minhash_dedup.keys_of(F.col("b")))).count() == 0


def test_long_chains_become_one_component(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 2000), (2000, 1500)], "a long, b long")
    got = {r["node"]: r["component"] for r in minhash_dedup.components(df).collect()}
    assert all(got[i] == 0 for i in range(301)) and got[1000] == got[1500] == got[2000] == 1000
