import math
import random
import re

from graphquarry.operators import postings


def by_hand(docs, terms, k, among=None):
    lists = {i: re.findall(r"[^\W_]+", (t or "").lower()) for i, t in docs}
    n, mean = len(lists), sum(map(len, lists.values())) / len(lists)
    score = {}
    for t in dict.fromkeys(x.lower() for x in terms):
        df = sum(t in ts for ts in lists.values())
        weight = max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6)
        for i, ts in lists.items():
            tf = ts.count(t)
            if tf and (among is None or i in among):
                score[i] = score.get(i, 0) + weight * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ts) / mean))
    return [(i, round(s, 6)) for i, s in sorted(score.items(), key=lambda x: (-round(x[1], 6), x[0]))[:k]]


def test_ranking_equals_brute_force(spark, monkeypatch):
    r = random.Random(4)
    docs = [(i, " ".join(r.choice(["alpha", "Beta", "beta_gamma", "delta", "eps,ilon", "zeta"]) for _ in range(r.randint(1, 30)))) for i in range(150)] + [(500, None), (501, ""), (502, "alpha " * 4000)]
    questions = {1: ["alpha", "Zeta", "zeta"], 2: ["nothing"], 3: ["beta", "ilon", "alpha"], 4: []}
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, term string")
    asked = spark.createDataFrame(list(questions.items()), "query_id long, terms array<string>")
    index = postings.build(df)
    assert index.n == len(docs)
    among = spark.createDataFrame([(i,) for i in range(0, 600, 3)], "id long")
    for listed in (postings.LISTED, 1):
        monkeypatch.setattr(postings, "LISTED", listed)
        for of in (None, among):
            got = {}
            for x in sorted(postings.ranked(index, asked, 7, of).collect(), key=lambda x: x["position"]):
                got.setdefault(x["query_id"], []).append((x["id"], x["score"]))
            want = {q: by_hand(docs, ts, 7, None if of is None else set(range(0, 600, 3))) for q, ts in questions.items()}
            assert got == {q: w for q, w in want.items() if w}
    empty = postings.build(df.limit(0))
    assert empty.n == 0 and postings.ranked(empty, asked, 3).count() == 0


def test_postings_are_dealt_once(spark, monkeypatch):
    from pyspark.sql import DataFrameWriter

    from graphquarry.operators import postings

    plans, save = [], DataFrameWriter.saveAsTable

    def kept(self, *args, **named):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return save(self, *args, **named)

    monkeypatch.setattr(DataFrameWriter, "saveAsTable", kept)
    index = postings.build(spark.createDataFrame([(1, "a b a"), (2, None), (3, "b")], "doc_id int, text string"))
    assert sorted(tuple(r) for r in index.postings.where("tf > 0").select("id", "term", "tf", "size").collect()) == [(1, "a", 2, 3), (1, "b", 1, 3), (3, "b", 1, 1)]
    assert index.n == 3 and plans[0].count("Exchange") == 1
