import html
import re

import duckdb
import numpy as np
import pytest

from auralith.llm import html_lstm as H
from auralith.llm.html_pages import made_pages


@pytest.fixture(scope="module")
def model():
    return H.trained()


def test_blocks():
    page = "<p>a &amp; <b>b</b><br>c<p>d\n  e<div class='Side-Bar x'>f<li>g<li>h</div><script>var t='<p>no</p>';</script><!-- <p>no --><style>p{}</style>i<"
    found = H.blocks(page)
    assert [b.text for b in found] == ["a & b c", "d e", "f", "g", "h", "i<"]
    assert found[2].path.marks == "div side bar x" and found[4].path.marks == "li"
    assert [b.text for b in H.blocks("<script>open to the end <p>x")] == [] and H.blocks("") == []
    assert [b.linked for b in H.blocks("<p><a href='>'>abc</a> d</p>")] == [3]


def test_elements_that_are_left_open():
    """Only what HTML reads as raw text runs to the end of the page."""
    for name in ("svg", "object", "math", "template"):
        assert [b.text for b in H.blocks(f"<p>a<{name}><p>b</p><p>c")] == ["a", "b", "c"]
    assert [b.text for b in H.blocks("<p>a <math><mi>x</mi></math> b<svg><p>no</p></svg></p><p><xmp>kept</xmp></p><iframe>gone")] == ["a x b", "kept"]


def test_path_vectors():
    """Made step by step from the parent's, they count each path's words, up to two, and the last element's own."""
    found = H.blocks("<div class='a b'>x<div class='a'>y<div class='a'>z</div></div></div>")
    for b, path in zip(found, (["div a b"], ["div a b", "div a"], ["div a b", "div a", "div a"])):
        want = np.zeros(H.PATH + H.LEAF)
        for word in " ".join(path).split():
            want[H._places(word)[0]] += 1
        want = np.minimum(want, 2)
        for word in path[-1].split():
            want[H._places(word)[1]] = 1
        assert (b.path.vector() == want).all()


def test_very_long_pages(model):
    """A page of many blocks, left open to any depth, is scored in windows with the same results as at once."""
    page = H.blocks("<nav>" + "<li>home" * 40 + "</nav>" + "<div>x" * 3000 + "<p>Some words here, long enough to be read as a text.</p>" * 50)
    at_once = model.scores([page])[0]
    assert np.allclose(model._in_windows(page, 100), at_once, atol=1e-4) and np.allclose(model._in_windows(page, 4096), at_once, atol=1e-4)
    import resource

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    long = "<div>x" * 60_000
    texts = H.extract_texts([long, *["<article><p>Some words here, long enough to be read.</p></article>"] * 100], model)
    assert set(texts[1:]) == {"Some words here, long enough to be read."}
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 600_000


def test_held_out_pages(model):
    right = total = 0
    for page, main in made_pages(150, seed=77):
        found = H.blocks(page)
        if found:
            z = model.scores([found])[0]
            right += sum((s > 0) == (b.text in main) for s, b in zip(z, found))
            total += len(found)
    assert right / total > 0.99


def test_pages_table(spark, sf):
    from auralith.llm.queries import op10_html_text

    rows = {r["page_id"]: r for r in op10_html_text(spark, sf).collect()}
    pages = duckdb.sql(f"select page_id, url, html from '{sf}/pages.parquet'").fetchall()
    assert len(rows) == len(pages)
    for i, url, page in pages:
        main = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
        want = [" ".join(html.unescape(re.sub("<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", main)]
        assert rows[i]["text"] == "\n".join(filter(None, want)) and rows[i]["url"] == url and rows[i]["n_chars"] == len(rows[i]["text"])


def test_odd_pages(spark):
    data = [(1, "u", None, "x"), (2, None, "", "x"), (3, "u", "   ", "x"), (None, "u", "<article><p>Some words here, long enough to be read.</p></article>", "x"), (4, "u", "<div>" * 3000 + "deep", "x"), (5, "u", "<" * 2000, "x"), (6, "u", "<p>" + "word " * 60_000, "x")]
    df = spark.createDataFrame([*data, data[3]], "page_id long, url string, html string, text string")
    rows = H.extract(df).collect()
    assert len(rows) == 8 and all(r["text"] is not None and r["n_chars"] == len(r["text"]) for r in rows)
    assert sum(r["n_chars"] for r in rows if r["page_id"] in (1, 2, 3)) == 0
    assert [r["text"] for r in rows if r["page_id"] is None] == ["Some words here, long enough to be read."] * 2
    assert H.extract(df.limit(0)).count() == 0


def test_gradients():
    """The backward pass agrees with differences of the loss."""
    rng = np.random.default_rng(2)
    lstm = H.Lstm(rng)
    lstm.w, lstm.b = lstm.w.astype(np.float64), lstm.b.astype(np.float64)
    x, mask = rng.standard_normal((4, 2, H.INPUT)).astype(np.float32), np.ones((4, 2, 1), np.float32)
    mask[3, 1] = 0
    goal = rng.standard_normal((4, 2, H.HIDDEN))
    kept: list = []
    lstm.forward(x, mask, kept)
    dw, _ = lstm.backward(x, mask, kept, goal)
    for i, j in ((3, 5), (H.INPUT + 2, 20), (H.INPUT + 7, H.HIDDEN * 3 + 1)):
        old = lstm.w[i, j]
        losses = []
        for step in (1e-2, -1e-2):
            lstm.w[i, j] = old + step
            losses.append(float((lstm.forward(x, mask) * goal).sum()))
        lstm.w[i, j] = old
        assert dw[i, j] == pytest.approx((losses[0] - losses[1]) / 2e-2, rel=0.05, abs=2e-3)
