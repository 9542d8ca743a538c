import random


from pyspark.sql import functions as F

from graphquarry.operators import intervals, ranges


def spans(seed, n=300, files=3, top=2000):
    r = random.Random(seed)
    out = []
    for k in range(n):
        a = r.randrange(-50, top)
        out.append((k, r.randrange(files), a, a + r.choice([0, 1, 2, 7, 8, 9, 63, 64, 65, 300, 1500])))
    return out


def test_blocks_of_a_span_are_its_union(spark):
    rows = [(a, b) for a, b in ((0, 0), (0, 1), (3, 3), (5, 4), (-9, 70), (1, 8), (0, 512), (7, 4097), (-513, -1), (8, 16))]
    df = spark.createDataFrame(rows, "a int, b int")
    for levels in (0, 1, 4, 6):
        got = df.select("a", "b", intervals.blocks_of_span(F.col("a"), F.col("b"), levels).alias("k")).collect()
        for r in got:
            numbers = [x for k in r["k"] for x in range(k["_block"] << (3 * k["_level"]), (k["_block"] + 1) << (3 * k["_level"]))]
            assert sorted(numbers) == list(range(r["a"], r["b"])) and (levels < 4 or len(r["k"]) <= 14 * 5)


def test_folds_and_pairs_equal_brute_force(spark):
    own, asked = spans(1), spans(2)
    s = spark.createDataFrame(own, "id int, f int, s int, e int")
    q = spark.createDataFrame(asked + asked[:5], "q int, f int, a int, b int")
    best = {"best": ("min", F.struct((F.col("e") - F.col("s")).alias("w"), F.col("id").alias("id"))), "last": ("max", F.col("s"))}
    held = {(r["f"], r["a"]): (r["best"]["w"], r["best"]["id"], r["last"]) for r in intervals.fold_holding(q, s, ["f"], "a", "s", "e", best).collect()}
    want = {}
    for _, f, a, _ in asked:
        hit = [x for x in own if x[1] == f and x[2] <= a < x[3]]
        if hit:
            want[f, a] = (*min((e - b, i) for i, _, b, e in hit), max(x[2] for x in hit))
    assert held == want
    over = {(r["f"], r["a"], r["b"]): (r["best"]["w"], r["best"]["id"], r["last"]) for r in intervals.fold_overlapping(q, s, ["f"], "a", "b", "s", "e", best).collect()}
    want = {}
    for _, f, a, b in asked:
        hit = [x for x in own if x[1] == f and x[2] <= b and x[3] >= a]
        if hit:
            want[f, a, b] = (*min((e - b_, i) for i, _, b_, e in hit), max(x[2] for x in hit))
    assert over == want
    pairs = sorted((r["q"], r["id"]) for r in intervals.pairs_overlapping(q, s, ["f"], "a", "b", "s", "e").collect())
    assert pairs == sorted((k, i) for k, f, a, b in asked + asked[:5] for i, g, c, d in own if f == g and c <= b and d >= a)


def test_empty_sides(spark):
    s = spark.createDataFrame(spans(1, 5), "id int, f int, s int, e int")
    q = s.select(F.col("id").alias("q"), "f", F.col("s").alias("a"), F.col("e").alias("b"))
    for left, right in ((q.limit(0), s), (q, s.limit(0)), (q.limit(0), s.limit(0))):
        assert intervals.pairs_overlapping(left, right, ["f"], "a", "b", "s", "e").count() == 0
        assert intervals.fold_overlapping(left, right, ["f"], "a", "b", "s", "e", {"n": ("min", F.col("id"))}).count() == 0


def test_one_file_with_a_hundred_thousand_spans(spark):
    """All spans and points stand in one file, 10 ** 5 of each: 10 ** 10 pairs if they met one another."""
    n = 100_000
    k = F.col("id")
    s = spark.range(n).select(k, F.lit(1).alias("file_id"), (k * 10).alias("start_byte"), F.when(k % 100 == 0, k * 10 + 1000).otherwise(k * 10 + 8).alias("end_byte"))
    s = s.unionByName(spark.createDataFrame([(n, 1, 0, 10 * n)], s.schema))
    points = spark.range(n).select(k.alias("p"), F.lit(1).alias("file_id"), ((k * 7919) % n * 10 + k % 10).alias("offset"))
    out = ranges.innermost(points, s)
    at, own = F.col("offset"), F.floor(F.col("offset") / 10)
    hundred = own - own % 100
    want = F.when((own % 100 != 0) & (at % 10 < 8), own).otherwise(hundred)
    assert out.where(F.col("enclosing") != want).count() == 0 and out.where("enclosing IS NULL").count() == 0
    chunks = points.select(F.col("p").alias("id"), "file_id", at.alias("start_line"), (at + 1).alias("end_line"))
    symbols = s.select("id", "file_id", F.col("start_byte").alias("start_line"), (F.col("end_byte") - 1).alias("end_line"))
    assert ranges.most_specific(chunks, symbols).where("symbol_id IS NOT NULL").count() > n // 2


def test_chunks_belong_to_symbols_whose_text_holds_theirs(spark):
    text = "class A {\n  one() { x }\n  two() { y } three() { z }\n}\r\nq"
    at = lambda part: (text.index(part), text.index(part) + len(part))
    line = lambda k: text[:k].count("\n") + 1
    spans_ = {"A": (*at(text[: text.index("\r")]), None), "one": (*at("one() { x }"), "A"), "two": (*at("two() { y }"), "A"), "three": (*at("three() { z }"), "A"), "stray": (*at("two() { y } three() { z }"), None), "ghost": (400, 500, "A")}
    symbols = spark.createDataFrame([(n, "f", p, line(a), line(b), a, b) for n, (a, b, p) in spans_.items()], "id string, file_id string, parent_symbol_id string, start_line int, end_line int, start_byte int, end_byte int")
    files = spark.createDataFrame([("f", bytearray(text.encode()))], "file_id string, content binary")
    asked = [("c1", 2, 2, "one() { x }"), ("c2", 3, 3, "two() { y }"), ("c3", 3, 3, "} three"), ("c4", 1, 4, "class A {\n  one() { x }"), ("c5", 5, 5, "q"), ("c6", 2, 2, "none"), ("c7", 2, 3, "x }\n  two")]
    chunks = spark.createDataFrame([(i, "f", a, b, t) for i, a, b, t in asked], "id string, file_id string, start_line int, end_line int, content string")
    got = {r["id"]: r["symbol_id"] for r in ranges.owners(chunks, symbols.where("id != 'stray'"), files).collect()}
    assert got == {"c1": "one", "c2": "two", "c3": "A", "c4": "A", "c5": None, "c6": None, "c7": "A"}
    got = {r["id"]: r["symbol_id"] for r in ranges.owners(chunks, symbols, files).collect()}
    assert got["c2"] is None and got["c3"] is None and got["c1"] == "one"  # the stray one is no ancestor
    chain = spark.createDataFrame([(k, k - 1 if k else None) for k in range(40)] + [(100, 101), (101, 100)], "id int, parent_symbol_id int")
    line_of = {}
    for r in ranges.ancestors(chain).collect():
        line_of.setdefault(r["id"], set()).add(r["ancestor"])
    assert all(line_of[k] == set(range(k + 1)) for k in range(40)) and line_of[100] == {100, 101}
