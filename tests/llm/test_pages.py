import html
import math
import re
import time

import numpy as np
import pytest
from fixtures_llm import SF
from pyspark.sql import types as T

from geoloom.llm import pages
from geoloom.llm.queries import QUERIES


@pytest.fixture(scope="module")
def model():
    return pages.fit([])


def accuracy(model, labelled, masked=False):
    f = pages.Forest()
    for i, (source, truth) in enumerate(labelled):
        pages.parse(f, i, source, truth, masked)
    a = pages.arrays(f)
    marginal, _ = pages.messages(a, pages.features(a) @ model.unary, model.pair)
    blocks = a["tag"] == pages.TAGS.index("#text")
    return ((marginal > 0.5) == (a["label"] == 1))[blocks].mean()


def test_held_out_accuracy(model):
    fresh = pages.composed(150, seed=4711)
    assert accuracy(model, fresh) > 0.98
    assert accuracy(model, fresh, masked=True) > 0.8


def test_marginals_as_by_enumeration():
    f = pages.Forest()
    pages.parse(f, 0, "<body><nav><a href=x>one</a></nav><article><p>Two three.</p></article></body>")
    a = pages.arrays(f)
    n, r = len(f.page), np.random.default_rng(1)
    score, pair = r.normal(size=n), r.normal(size=(2, 2, 2))
    marginal, joint = pages.messages(a, score, pair)
    kind = (a["tag"] == pages.TAGS.index("#text")).astype(int)
    total, one, two = 0.0, np.zeros(n), np.zeros((n, 2, 2))
    for bits in range(1 << n):
        y = [bits >> i & 1 for i in range(n)]
        p = np.exp(sum(score[i] * y[i] for i in range(n)) + sum(pair[kind[i], y[f.parent[i]], y[i]] for i in range(n) if f.parent[i] >= 0))
        total += p
        for i in range(n):
            one[i] += p * y[i]
            if f.parent[i] >= 0:
                two[i, y[f.parent[i]], y[i]] += p
    assert np.allclose(marginal, one / total) and np.allclose(joint[1:], two[1:] / total)


CASES = {
    "<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>A &amp; B</h1><p>First  line<br>goes\non.<p>Second &lt;one&gt;.</article><footer>&copy; x</footer>": "A & B\n\nFirst line goes on.\n\nSecond <one>.",
    "<body><div class='cookie-banner'>We use cookies. Accept.</div><main><p>Only this text stays here, one hopes.</p><script>var t='</p>';</script><!-- no --></main></body>": "Only this text stays here, one hopes.",
    "<article><p>Text of the article that goes on.</p></article><section class='comments'><h3>Comments</h3><p>I liked it. It was great, thank you all.</p></section>": "Text of the article that goes on.",
    "<article><p>One &nbsp; two&#33;</p><aside class=sidebar><a href=x>Other story</a></aside><p>Three.</p></article>": "One two!\n\nThree.",
    "": "",
    "<": "<",
}


@pytest.mark.parametrize("source", [s for s in CASES if len(s) > 1])
def test_cases(model, source):
    assert pages.extracted([source], model) == [CASES[source]]


@pytest.mark.parametrize("value", ["x", "1", "0", "99999999999999999999999", ""])
def test_pages_do_not_label_themselves(model, value):
    source = "<nav class='menu' data-truth='{0}'><a href=x>Home</a></nav><article data-truth='{0}'><p>Words that belong to the text, quite a few.</p></article>"
    assert pages.extracted([source.format(value)], model) == ["Words that belong to the text, quite a few."]


SOUP = {
    "stray ends": "<b>a</i>" * (1 << 17), "unclosed options": "<option>" * (1 << 17), "heads": "<head></head>" * 80_000 + "<body>", "rules": "<b>" * (1 << 16) + "<hr>" * (1 << 17),
    "items": "<ul><li><ul>" + "<b>" * 100_000 + "<li></li>" * 60_000, "quotes": "<a href='" * 100_000,
}


@pytest.mark.parametrize("kind", SOUP)
def test_time_grows_with_length_alone(kind):
    """Twice the tags take about twice the time: a loop over all open tags would take four times."""
    source = SOUP[kind]

    def took(text):
        best = math.inf
        for _ in range(3):
            begin = time.perf_counter()
            pages.parse(pages.Forest(), 0, text)
            best = min(best, time.perf_counter() - begin)
        return best

    assert took(source) < 3.2 * took(source[: len(source) // 2]) + 0.2


def test_deep_elements_keep_their_features():
    f = pages.Forest()
    pages.parse(f, 0, "<div>" * 2000 + "<nav class='menu'><a href=x>Home</a></nav><article><p>Words.</p></article>")
    assert max(f.depth) <= pages.MOST_DEPTH + 2
    for name, group in (("nav", "nav"), ("article", None), ("p", None)):
        node = f.tag.index(pages.TAGS.index(name))
        assert f.group[node] == (1 << list(pages.GROUPS).index(group) if group else 0)
    words = f.text.index("Words.")
    assert f.tag[f.parent[words]] == pages.TAGS.index("p")


def test_odd_pages_do_not_crash(spark, model):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>"), (3, "u", "<div>" * 3000 + "deep" + "</div>" * 10), (4, "u", "</p></div><<>< a <b"), (5, "u", "<script>never ends"), (6, "u", "<article><p>" + "long words here. " * 30_000), (6, "u", "<!-- open"), (7, "u", "<article><p>x")]
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])
    df = spark.createDataFrame(rows, schema).selectExpr("*", "1 as k", "'x' as u", "0 as t", "'y' as text")
    out = pages.extract(df).collect()
    assert sorted(repr((r.page_id, r.url)) for r in out) == sorted(repr((k, u)) for k, u, _ in rows)
    assert all(r.n_chars == len(r.text) for r in out)
    assert {r.page_id: r.text for r in out}[1] == "" and len({r.page_id: r.n_chars for r in out if r.n_chars > 1000}) == 1
    assert pages.extract(df.limit(0)).count() == 0


def test_query_over_the_whole_table(spark):
    rows = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in QUERIES["op10_html_extraction"](spark, SF).collect():
        inside = re.search(r"<article>(.*?)</article>", rows[r.page_id], re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        assert r.text == "\n\n".join(b for b in blocks if b)
