"""Quality scores, page extraction and nearest neighbours."""

import itertools
import random
import re
import zlib

import numpy as np
from .helpers import DOCS, awkward, with_clashes

from tixspark.llm import factorization, forest, htmlcut, queries
from tixspark.llm.common import table

SF = "/root/testdata/sf0.01"


def test_quality_held_out(spark):
    rows = queries.QUERIES["op6_quality_fm"](spark, SF).join(table(spark, SF, "labels"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert sum(a > b for a in good for b in bad) / (len(good) * len(bad)) > 0.97


def test_interactions_in_linear_time():
    rng = np.random.default_rng(0)
    m = factorization.Machine(rng.normal(size=50), rng.normal(size=(50, 4)))
    idx, val = np.array([3, 7, 20, 41]), rng.normal(size=4)
    pairs = sum(m.v[idx[i]] @ m.v[idx[j]] * val[i] * val[j] for i, j in itertools.combinations(range(4), 2))
    assert np.isclose(m.margin(idx, val), m.w[idx] @ val + pairs)


def test_quality_awkward_rows(spark):
    docs = with_clashes(spark.createDataFrame(awkward(), DOCS))
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 1), (6, 1), (9, 0), (None, 1), (5, None), (8, 1), (8, 0)], "doc_id long, label int")
    from pyspark.sql import functions as F

    machine = factorization.fit(docs, labels)
    got = docs.select("doc_id", factorization.quality(F.col("text"), F.col("n_chars"), machine).alias("s")).collect()
    assert len(got) == len(awkward()) and all(0 <= r.s <= 1 for r in got)
    assert factorization.fit(docs, labels.limit(0)).share == 0.5 and factorization.fit(docs, labels.where("label = 1")).share == 1.0


def test_minimum_cut_is_minimal():
    rng = random.Random(8)
    for _ in range(150):
        n = rng.randint(1, 8)
        odds = [rng.uniform(-3, 3) for _ in range(n)]
        edges = {(i, j): rng.uniform(0, 2) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.4}

        def cost(keep):
            unary = sum(o if not k else 0 for o, k in zip(odds, keep, strict=True) if o > 0) + sum(-o if k else 0 for o, k in zip(odds, keep, strict=True) if o < 0)
            return unary + sum(w for (i, j), w in edges.items() if keep[i] != keep[j])

        best = min(cost(k) for k in itertools.product((False, True), repeat=n))
        assert abs(cost(htmlcut.min_cut(list(odds), dict(edges))) - best) < 1e-6


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>x</p>";</script></head><body class="home"><header class="site"><a href=/>Home</a> Site</header>
<div id="cookie-notice">We use cookies. <button>OK</button></div><div class="sidebar"><h3>Popular</h3><ul><li><a href=1>One thing to read</a></li></ul></div>
<main><article><header><h1>Title &amp; more</h1></header><p>First   para with a <a href=x>link</a> in it,&nbsp;and <b>words<p>Second one &lt;here&gt;, with text. It goes
on.<div class="ad">Buy now!</div><ul><li>item one<li>item two</ul><form><label>Mail</label></form></article>
<section class="comments"><h2>Comments</h2><div class="comment"><p>Great article, I really enjoyed reading this. Thanks!</p></div></section></main>
<footer>&copy; 2024</footer></body></html>"""


def test_pages(spark):
    want = "Title & more\nFirst para with a link in it, and words\nSecond one <here>, with text. It goes on.\nitem one\nitem two"
    pages = table(spark, SF, "pages")
    model = htmlcut.fit(pages)
    assert htmlcut.extract(PAGE, model) == want == htmlcut.extract(PAGE, htmlcut.PRIOR)
    rows = queries.QUERIES["op7_html_mincut"](spark, SF).collect()
    html = {r.page_id: r.html for r in pages.collect()}
    for r in rows:
        body = re.split(r"</?p>|</?h1>", html[r.page_id].split("<article>")[1].split("</article>")[0])
        import html as h

        lines = [" ".join(h.unescape(re.sub("<[^>]+>", "", x)).split()) for x in body]
        assert r.text == "\n".join(x for x in lines if x) and r.n_chars == len(r.text)
    odd = spark.createDataFrame(
        [(1, None, None), (2, "u", ""), (3, "u", "no tags, only a sentence that stands here."), (4, "u", "<p>open <b>tag"), (5, "u", "<" * 5000), (5, "u", "<nav>x</nav>"), (6, "u", "<script>")],
        "page_id long, url string, html string",
    )
    from pyspark.sql import functions as F

    got = [r.t for r in with_clashes(odd).select(htmlcut.main_text(F.col("html"), model).alias("t")).collect()]
    assert got[:2] == ["", ""] and got[5:] == ["", ""] and all(x is not None for x in got)
    assert htmlcut.fit(odd.limit(0)).tolist() == htmlcut.PRIOR.tolist()


def test_no_text_is_dropped():
    cases = {
        "<article><p>One sentence that is here to stay, as it is long.</p><select><option>a<option>b<p>A second one, which is content too, stands after it.</p></article>":
            "One sentence that is here to stay, as it is long.\nA second one, which is content too, stands after it.",
        "<article><p>Energy is <math><mi>E</mi>=<mi>m</mi></math> as we all know, and so it is.</p></article>": "Energy is E=m as we all know, and so it is.",
        "<article><p>There is <video src=x>no film</video> and <svg><text>a drawing</text></svg> and <object>a thing</object> in it, <canvas>as it were</canvas>.</p></article>":
            "There is no film and a drawing and a thing in it, as it were.",
        "<article><p>What follows is unclosed, but is still content.<noscript>Without scripts.<p>So is this one, which stands at the end.</article>":
            "What follows is unclosed, but is still content.Without scripts.\nSo is this one, which stands at the end.",
        "<article><p>A page that has a template, which nobody sees.</p><template><p>Not shown at all, however long it is.</p></template></article>": "A page that has a template, which nobody sees.",
    }
    for page, want in cases.items():
        assert htmlcut.extract(page, htmlcut.PRIOR) == want


def test_the_cut_beats_the_classifier_without_article_elements(spark):
    """Pages whose article elements are renamed and whose paragraphs end in links of their own."""
    pages = table(spark, SF, "pages")
    weights = htmlcut.fit(pages)

    def strewn(page):
        page = re.sub(r"<(/?)article", r"<\1div", page)
        return re.sub(r"<p>([^<]*) (\S+ \S+)</p>", r"<p>\1</p><div><a href=x>\2</a></div>", page)

    def inside(frame):
        while frame.parent:
            if frame.tag == "div" and frame.parent.tag == "body":
                return not frame.bad
            frame = frame.parent
        return False

    alone = cut = blocks = 0
    for r in pages.collect():
        found = htmlcut.blocks(strewn(r.html))
        truth = [inside(b.frame) for b in found]
        odds = (htmlcut.block_features(found) @ weights).tolist()
        alone += sum((o > 0) != t for o, t in zip(odds, truth, strict=True))
        cut += sum(k != t for k, t in zip(htmlcut.min_cut(odds, htmlcut.smoothness(found)), truth, strict=True))
        blocks += len(found)
    assert alone > 0.1 * blocks and cut < 0.25 * alone


def exact(rows, k=5):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for i, v in ok:
        if i % 50 == 0:
            near = sorted((-(v @ x) / (np.sqrt(v @ v) * np.sqrt(x @ x)), j) for j, x in ok if j != i and len(x) == len(v))
            out[i] = [(j, -c) for c, j in near[:k]]
    return out


def test_neighbours(spark, monkeypatch):
    got = queries.QUERIES["op5_prefix_forest"](spark, SF).collect()
    want = exact([(r.vec_id, r.embedding) for r in table(spark, SF, "embeddings").collect()])
    found = {(r.query_id, r.vec_id): r.score for r in got}
    true = {(q, j): c for q, near in want.items() for j, c in near}
    assert len(found.keys() & true.keys()) / len(true) >= 0.9
    assert all(abs(found[x] - true[x]) < 1e-12 for x in found.keys() & true.keys())
    assert {(r.query_id, r.rank) for r in got} == {(q, i + 1) for q in want for i in range(5)}
    monkeypatch.setattr(forest, "SHARD_ROWS", 120)  # several shards answer as well as one
    some = forest.valid_vectors(table(spark, SF, "embeddings"))
    more = {(r.query_id, r.vec_id) for r in forest.nearest(some, some.where("id % 50 = 0")).collect()}
    assert len(more & true.keys()) / len(true) >= 0.9


def test_neighbours_where_shards_are_not_read_whole(spark):
    some = table(spark, "/root/testdata/sf0.1", "embeddings")
    want = exact([(r.vec_id, r.embedding) for r in some.collect()])
    assert some.count() > 2 * forest.LEAST
    valid = forest.valid_vectors(some)
    found = {(r.query_id, r.vec_id) for r in forest.nearest(valid, valid.where("id % 50 = 0")).collect()}
    true = {(q, j) for q, near in want.items() for j, _ in near}
    assert len(found & true) / len(true) >= 0.9


def test_neighbours_awkward_rows(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.5, 0.5]), (1, [2.0, 0.0]), (2, [1.0, 0.1]), (3, [1.0, 0.1]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]),
            (8, [float("inf"), 1.0]), (9, [None, 1.0]), (None, [1.0, 1.0]), (10, [1.0, 2.0, 3.0]), (100, [1.0, 2.0, 3.0]), (11, [-1.0, 0.0]), (11, [-1.0, 0.0]), (150, [9.0])]
    table_ = with_clashes(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    vectors = forest.valid_vectors(table_)
    got = forest.nearest(vectors, vectors.where("id % 50 = 0"), read=30.0).orderBy("query_id", "rank").collect()
    want = exact([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in dict((r[0], r[1]) for r in rows).items()])
    assert {q: [r.vec_id for r in got if r.query_id == q] for q in {r.query_id for r in got}} == {q: [j for j, _ in n] for q, n in want.items() if n}
    empty = vectors.limit(0)
    assert forest.nearest(empty, empty).collect() == []


def test_neighbours_of_few_vectors(spark):
    rng = np.random.default_rng(3)
    sizes = {6: 3, 7: 12, 8: 30, 9: 200}  # vectors of each length
    rows = [(1000 * d + 5 * i, rng.standard_normal(d).tolist()) for d, n in sizes.items() for i in range(n)]
    vectors = forest.valid_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = forest.nearest(vectors, vectors.where("id % 50 = 0")).orderBy("query_id", "rank").collect()
    assert {q: [r.vec_id for r in got if r.query_id == q] for q, _ in rows if q % 50 == 0} == {q: [j for j, _ in n] for q, n in exact(rows).items()}


def test_shards_of_each_length(spark, monkeypatch):
    monkeypatch.setattr(forest, "SHARD_ROWS", 100)
    built, build = [], forest.build_shards
    monkeypatch.setattr(forest, "build_shards", lambda *a: built.append(build(*a)) or built[-1])
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(4 if i < 450 else 3).tolist()) for i in range(460)]
    vectors = forest.valid_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    forest.nearest(vectors, vectors.where("id % 50 = 0")).collect()
    assert {d: sum(r.dim == d for r in built[0].select("dim").collect()) for d in (3, 4)} == {3: 1, 4: 5}


def test_stop_counts_others_once():
    # Rows with the query's own strings stand for one candidate each, however many trees hold them.
    rng = np.random.default_rng(6)
    x = np.vstack([np.repeat(rng.standard_normal((1, 16)), 300, 0), rng.standard_normal((1700, 16))])
    codes = forest._codes(x / np.abs(x).max(1, keepdims=True))
    order = np.argsort(codes, axis=0, kind="stable")
    hits = forest.candidates(np.take_along_axis(codes, order, 0).T, order.T, codes[:1], np.array([0]), 5, forest.READ)
    assert hits.sum() >= forest.SHARE * len(x) and not hits[0, 0]
