import html
import itertools
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphquarry.llm import boosting, html_extraction, page_tree, queries_words, sample_pages

DATA = "/root/testdata/sf0.001"


def texts(page):
    nodes = page_tree.Nodes()
    page_tree.read_page(page, nodes)
    return [t for t in nodes.text if t]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", []),
        (" \n ", []),
        ("plain &amp; <b>bo</b>ld", ["plain & bold"]),
        ("<p>a<p>b<br>c</p>d", ["a", "b c", "d"]),
        ("<p><b>a<br><p>b</p>c", ["a", "b", "c"]),
        ("<div>a<script>x</p></script>b<style>c</style><!-- d > -->e<!--> f -->g</div>", ["abef -->g".replace("f", " f")]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", ["a", "b", "c", "d", "e"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ("<dl><dt>a<dd>b<dt>c</dl>", ["a", "b", "c"]),
        ("x < y &lt; z &#x41;&#66;&nbsp;&nbsp;q", ["x < y < z AB q"]),
        ("<a href='a>b' title=\"</p>\">k</a><img alt=it's>m", ["km"]),
        ("<title>t</title><textarea>u</textarea><svg><text>v</text></svg>w", ["w"]),
        ("<p>a</div></td>b</p", ["ab"]),
        ("<P CLASS=x>A</P><unknown-tag>B</unknown-tag>", ["A", "B"]),
        ("<script>never ends <p>x", []),
        ("a<!-- never ends <p>x", ["a"]),
        ("<h1>a</h2>b", ["a", "b"]),
    ],
)
def test_reader_takes_what_browsers_show(page, want):
    assert texts(page) == want


def test_subtrees_are_ranges_and_deep_trees_end(spark):
    nodes = page_tree.Nodes()
    page_tree.read_page("<div>" * 3000 + "deep<p>er" + "</div>" * 10 + "x", nodes)
    assert max(nodes.depth) <= page_tree.MOST_DEPTH and [t for t in nodes.text if t] == ["deep", "er", "x"]
    for k, up in enumerate(nodes.parent):
        assert up < k and (up < 0 or nodes.end[k] <= nodes.end[up])
    assert page_tree.describe(nodes).shape[0] == len(nodes.parent) and np.isfinite(page_tree.describe(nodes)).all()


def test_sums_of_subtrees_equal_brute_force():
    nodes = page_tree.Nodes()
    for page in sample_pages.sample(5, 3):
        page_tree.read_page(page, nodes)
    x = page_tree.describe(nodes)
    n = len(nodes.parent)
    chars = [0] * n
    for k in range(n - 1, -1, -1):
        chars[k] += len(nodes.text[k] or "")
        if nodes.parent[k] >= 0:
            chars[nodes.parent[k]] += chars[k]
    column = len(page_tree.KINDS) + 15 + 6 + 2 * len(page_tree.GROUPS)
    assert x[:, column].tolist() == chars
    for k in range(n):
        same = [j for j in range(n) if nodes.parent[j] == nodes.parent[k] and (nodes.parent[k] >= 0)]
        if nodes.parent[k] >= 0:
            before = [j for j in same if j < k]
            assert x[k, column + 27] == len(before) and x[k, column + 29] == len(same)
            assert x[k, column + 32] == (chars[before[-1]] if before else -1)


def test_decoding_is_the_likeliest_consistent_choice():
    rng = np.random.default_rng(5)
    for _ in range(60):
        n = int(rng.integers(2, 9))
        parent = [-1] + [int(rng.integers(0, k)) for k in range(1, n)]
        order = []  # page order
        def walk(k):
            order.append(k)
            for j in range(n):
                if parent[j] == k:
                    walk(j)
        walk(0)
        at = {k: i for i, k in enumerate(order)}
        nodes = page_tree.Nodes()
        nodes.parent = [at[parent[k]] if parent[k] >= 0 else -1 for k in order]
        nodes.end = [i + 1 for i in range(n)]
        for i in range(n - 1, 0, -1):
            nodes.end[nodes.parent[i]] = max(nodes.end[nodes.parent[i]], nodes.end[i])
        inner = set(nodes.parent)
        nodes.text = [None if i in inner else "t" for i in range(n)]
        nodes.pages = [0]
        log_p = np.log(rng.dirichlet([1, 1, 1], n))

        def consistent(s):
            return all(s[i] != 2 or i in inner for i in range(n)) and all(s[nodes.parent[i]] == 2 or s[nodes.parent[i]] == s[i] for i in range(1, n))

        best = max((s for s in itertools.product(range(3), repeat=n) if consistent(s)), key=lambda s: sum(log_p[i, s[i]] for i in range(n)))
        got = html_extraction.decode(nodes, log_p)
        leaves = [i for i in range(n) if i not in inner]
        assert [bool(got[i]) for i in leaves] == [best[i] == 0 for i in leaves]


def test_trees_learn_classes():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4)).astype(np.float32)
    x[:, 3] = x[:, 3] > 0.5
    y = np.where(x[:, 3] > 0, np.where(x[:, 0] > 0.6, 0, 1), np.where(x[:, 1] > 0.3, 2, 1))
    trees = boosting.fit_trees(x[:2000], y[:2000], np.ones(2000), 3, rounds=20)
    p = trees.log_probabilities(x[2000:])
    assert (p.argmax(axis=1) == y[2000:]).mean() > 0.97 and np.allclose(np.exp(p).sum(axis=1), 1)
    one = boosting.fit_trees(x[:1], y[:1], np.ones(1), 3, rounds=2)
    assert one.log_probabilities(x[:2]).argmax(axis=1).tolist() == [y[0]] * 2


def marked(page):
    nodes = page_tree.Nodes()
    page_tree.read_page(page, nodes)
    return page_tree.texts_of(nodes, np.array(nodes.label, bool))[0]


def test_held_out_pages_of_other_layouts():
    """Measured on pages that the trees haven't seen, with layouts of every kind."""
    pages = sample_pages.sample(300, 77)
    got, want = html_extraction.main_texts(pages, html_extraction.default_trees()), list(map(marked, pages))
    f1 = []
    for a, b in zip(got, want, strict=True):
        a, b = Counter(a.split()), Counter(b.split())
        f1.append(2 * (a & b).total() / max(1, a.total() + b.total()))
    assert np.mean([a == b for a, b in zip(got, want, strict=True)]) >= 0.88 and np.mean(f1) >= 0.97


P = "<p>The harbour was quiet when the first boats came in, and nobody spoke of the storm. Everyone had heard it, of course.</p>"
BODY = f"<h1>Quiet harbour</h1>{P}<p>Later, a <a href='/x'>report</a> said that nothing was lost. It was signed by the master.</p>"
WANT = "Quiet harbour The harbour was quiet when the first boats came in, and nobody spoke of the storm. Everyone had heard it, of course. Later, a report said that nothing was lost. It was signed by the master."
MENU = "<ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li><li><a href='/c'>About us</a></li></ul>"


@pytest.mark.parametrize(
    "page",
    [
        f"<html><body><nav>{MENU}</nav><article>{BODY}</article><footer>&copy; 2020 Harbour press</footer></body></html>",
        f"<html><body><div class='navbar'>{MENU}</div><div class='post-content'>{BODY}</div><div class='footer'>&copy; 2020 Harbour press</div>",
        f"<body><header><a href='/'>Harbour press</a><nav>{MENU}</nav></header><main><div class='entry'>{BODY}</div></main><aside class='sidebar'><h3>Popular</h3>{MENU}</aside><footer><p>All about harbours.</p></footer>",
        f"<body><div id='cookie-banner'><p>We use cookies. You can refuse them.</p><button>Accept</button></div><article>{BODY}</article><section class='comments'><h3>Comments</h3><div class='comment'><p>I was there. It was loud!</p></div></section>",
        f"<body><article>{BODY.replace('</h1>', '</h1><div class=' + chr(34) + 'ad' + chr(34) + '>Buy a boat today!</div>')}</article><form class='newsletter'><p>Get our letter.</p><input><button>Send</button></form>",
        f"<body><div class='article-body'>{BODY}</div><div class='related'><h3>Related</h3>{MENU}</div>",
    ],
)
def test_pages_by_hand(page):
    assert html_extraction.main_texts([page], html_extraction.default_trees()) == [WANT]


def test_op13_equals_the_article_of_the_given_pages(spark):
    rows = {r["page_id"]: r for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    out = queries_words.op13_html_extraction(spark, DATA)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = out.collect()
    assert sorted(r["page_id"] for r in got) == sorted(rows)
    for r in got:
        inner = re.search("<article>(.*)</article>", rows[r["page_id"]]["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub("<[^>]*>", "", re.sub("</?(p|h1|br)[^>]*>", " ", inner))).split())
        assert r["text"] == want and r["n_chars"] == len(want) and r["url"] == rows[r["page_id"]]["url"]


def test_odd_pages_and_columns(spark):
    long = "<body><article>" + P * 4000 + "</article></body>"
    rows = [(1, "u", None), (None, None, ""), (2, "v", "<p>"), (3, "w", long), (3, "w", long), (4, "x", "no markup at all, only a sentence of words that says something. And one more.")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"_html": F.lit(1), "text": F.lit("t")})
    out = html_extraction.extract(df, keep=("page_id", "url", "_html")).collect()
    by = {r["page_id"]: r for r in out}
    assert len(out) == 6 and by[1]["text"] == by[None]["text"] == by[2]["text"] == "" and by[1]["n_chars"] == 0
    assert by[3]["text"].count("harbour") == 4000 and by[4]["text"] == rows[5][2] and by[3]["_html"] == 1
    assert html_extraction.extract(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        html_extraction.extract(df, keep=("text",))
