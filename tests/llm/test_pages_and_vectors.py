"""HTML extraction on small pages and on all pages of a folder; nearest neighbours against brute force."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from joulemill.llm import ann, html

PAGE = """<html><head><title>T</title><style>p{x:1}</style></head><body><header>Site, name</header><nav><ul><li><a href=x>Home</a></ul></nav>
<div id="cookieNotice">We use cookies, sorry.</div><div class="content"><h1>Head &amp; line</h1><p>First,&nbsp;text   with <b>bo</b>ld; and more words.
<p>Second one.<br>After the break.<form><label>Search</label><input></form><table><tr><td>cell 1<td>cell 2</table></div><aside>Aside, text.</aside>
<section class="comments"><p>Great article, thank you so much, really.</p></section><script>if (a < b) document.write("<p>no</p>")</script><footer>&copy; us</footer></body></html>"""


def test_surroundings_are_left_out():
    assert html.main_text(PAGE) == "Head & line First, text with bold; and more words. Second one. After the break. cell 1 cell 2"


@pytest.mark.parametrize("page, want", [(None, ""), ("", ""), ("plain, text", "plain, text"), ("<nav>menu", ""), ("<p>a<p>a", "a a"), ("<p>x &lt;b&gt; &#233; &amp;amp;", "x <b> é &amp;"), ("<!-- c --><p>a<!-- d -->b</p>", "ab"), ("<article><p>only", "only")])
def test_small_pages(page, want):
    assert html.main_text(page) == want


def test_deep_and_long_pages():
    assert html.main_text("<div>" * 20_000 + "deep, text.") == "deep, text."
    assert len(html.main_text("<p>word, </p>" * 50_000)) == 6 * 50_000 - 1


ARTICLE = "<h1>The title</h1><p>The first paragraph, which is long enough; it says much.</p><p>The second one, with commas, and more of them.</p>"
PLAIN = "The title The first paragraph, which is long enough; it says much. The second one, with commas, and more of them."


@pytest.mark.parametrize("wrapper", ['<div class="content-sidebar-wrap"><main>{}</main><div class="sidebar"><p>About us, in short.</div></div>', '<div class="has-sidebar"><div>{}</div></div>', '<div id="content-widget">{}</div>', '<div class="post comments-open">{}<ol class="comment-list"><li><article class="comment-body"><p>Nice, thanks.</article></ol></div>', "<form id=aspnet>{}<input></form>", '<div class="related no-sidebar"><article>{}</article></div>'])
def test_names_and_forms_around_the_article(wrapper):
    page = '<body><div class="login">Sign in, please.</div>' + wrapper.format(ARTICLE) + '<form>Your mail, please <input></form><div class="footer">All rights, reserved.</div>'
    assert html.main_text(page) == PLAIN


def test_formulas_and_deep_headers():
    long = "<p>" + "A sentence of the article, with some words. " * 8 + "</p>"
    page = f"<main><p>Energy <math><mi>E</mi><mo>=</mo><mi>m</mi><annotation>E=m in words</annotation></math> holds, " + "as all of this says. " * 9 + f"</p>{long}</main>"
    assert html.main_text(page).startswith("Energy E=m holds, as all")
    deep = "<main>" + "<div>" * 60 + f"<header><h1>The headline</h1></header>{long}" + "</div>" * 60 + "</main>"
    assert html.main_text(deep).startswith("The headline A sentence")


def test_article_in_parts_and_its_header():
    parts = "".join(f'<div class="elementor-widget-container">{p}</div>' for p in re.findall("<(?:h1|p)>.*?</(?:h1|p)>", ARTICLE))
    assert html.main_text(f'<body><div class="page">{parts}</div><div class="comments"><p>Nice, thanks.</div>') == PLAIN
    head, rest = ARTICLE.split("<p>", 1)
    assert html.main_text(f'<body><div class="page"><div class="article-header">{head}</div><p>{rest}</div><div class="comments"><p>Nice, thanks.</div>') == PLAIN


LONG = "".join(f"<p>Paragraph {i} of the text, which is long enough; it says much, and goes on.</p>" for i in range(12))


def test_content_outside_the_container_is_kept():
    body = html.main_text(f"<div>{LONG}</div>")
    assert html.main_text(f"<body><div id=content><div class=intro><p>The lead, short.</p></div><div class=body>{LONG}</div></div>") == f"The lead, short. {body}"
    assert html.main_text(f"<body><h1>Title</h1><div class=body>{LONG}</div>") == f"Title {body}"
    end = "<h2>End</h2><ul><li>One</ul><div><p>The closing section, also text; it ends here.</p></div>"
    assert html.main_text(f"<body><div class=body>{LONG}</div>{end}") == f"{body} End One The closing section, also text; it ends here."


def test_all_pages(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    bare = lambda h: " ".join(re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)[^>]*>", " ", re.search(r"<article>(.*?)</article>", h, re.S)[1])).split())
    got = {r["page_id"]: r for r in html.extract(pages.withColumn("text", F.lit(1))).collect()}
    for r in pages.collect():
        assert got[r["page_id"]]["text"] == bare(r["html"]).replace("&amp;", "&") and got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])
    assert html.extract(pages.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, None, None), (1, None, None), (None, "u", "<p>a, b")], "page_id long, url string, html string")
    assert sorted(r["text"] for r in html.extract(odd).collect()) == ["", "", "a, b"]


def brute(ids, v, queries, k=20):
    out = {}
    for q in queries:
        s = (v * v[list(ids).index(q)]).sum(axis=1)
        rows = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), s[i]) for i in rows]
    return out


def recall(got, want):
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q, rows in want.items():
        mine = sorted(found[q])
        assert [m[0] for m in mine] == list(range(1, len(rows) + 1))
        assert all((-a[2], a[1]) <= (-b[2], b[1]) for a, b in zip(mine, mine[1:]))
        hits += len({m[1] for m in mine} & {r[0] for r in rows}) / max(1, len(rows))
    return hits / max(1, len(want))


def test_recall_on_many_cells(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL", 256)
    monkeypatch.setattr(ann, "BLOCK", 300)
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(12, 16))
    v = centres[draw.integers(0, 12, 3000)] + draw.normal(size=(3000, 16)) * 0.4
    v[:900] = v[0]  # a hot vector
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = ann.nearest(df, df.filter("vec_id % 20 = 0")).collect()
    want = brute(np.arange(3000), v, range(0, 3000, 20))
    assert recall(got, want) >= 0.9
    ties = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == 20)
    assert [t[1] for t in ties] == [i for i in range(21) if i != 20]


def test_recall_on_the_table(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = vectors.select("vec_id", "embedding").collect()
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    got = ann.nearest(vectors, vectors.filter("vec_id % 20 = 0")).collect()
    assert recall(got, brute(ids, v, [i for i in ids.tolist() if i % 20 == 0])) >= 0.9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, None, 1), (2, [0.0, 0.0], 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 1), (5, [None, 1.0], 1), (6, [2.0, 1.0], 1), (7, [], 1), (None, [1.0, 1.0], 1), (8, [1.0], 1), (20, [0.0, 3.0], 1), (20, [0.0, 3.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(df, df.filter("vec_id % 20 = 0")).collect())
    assert got == [(0, 1, 6, 2.0), (0, 2, 20, 0.0), (0, 3, 20, 0.0), (20, 1, 6, 3.0), (20, 2, 0, 0.0)]
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_one_longer_vector_shuts_out_none(spark):
    draw = np.random.default_rng(6)
    v = [x.tolist() for x in draw.normal(size=(200, 8))]
    v[77] = [*v[77], 0.5]
    df = spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.filter("vec_id % 20 = 0")).collect()
    ids = np.array([i for i in range(200) if i != 77])
    assert recall(got, brute(ids, np.array([v[i] for i in ids]), range(0, 200, 20))) >= 0.9
