"""Main text of pages: blocks, the tree, and pages that the tree was not grown from."""

import html
import re

import numpy as np
import pytest

from emberline.llm import pages


def words(n, word="word"):
    return " ".join([word] * n)


def cut(page):
    return [b.text for b in pages.Cutter().cut(page)]


def main_text(spark, *rows):
    df = spark.createDataFrame([(i, "u", h, "kept", 7) for i, h in enumerate(rows)], "page_id long, url string, html string, text string, n int")
    got = pages.extract(df).orderBy("page_id").collect()
    assert all(r["n"] == 7 for r in got)
    return [r["text"] for r in got]


def test_blocks_of_odd_markup():
    assert cut("<p>a<p>b<b>c</b>d<br>e<br> <br/>f</p>g") == ["a", "bcd e", "f", "g"]
    assert cut("<ul><li>a<ul><li>b</ul><li>c</ul><table><tr><td>d<td>e<tr><td>f</table>") == ["a", "b", "c", "d", "e", "f"]
    assert cut('<p title="a > b" x=\'>\'>q<!-- <p>no</p> -->r<i>s</i></p><div') == ["qrs"]
    assert cut("1 < 2 &lt;b&gt; &amp;amp; &nbsp;&#x41; &bogus; AT&T") == ["1 < 2 <b> &amp; A &bogus; AT&T"]
    assert cut("<script>var t='</p>';<p>x</script>y<style>z") == ["y"]
    assert cut("<!-- open <p>x") == cut("<p") == cut("") == cut("<p> &nbsp; 　</p>") == []
    assert cut("</div></p>x</article>") == ["x"]


def test_links_end_with_their_element():
    got = [(b.words, b.linked) for b in pages.Cutter().cut("<div><a href=x>a b</div><p>c <a>d</a> e</p><a><div>f g</div></a><p>h</p>")]
    assert got == [(2, 2), (3, 1), (2, 2), (1, 0)]


def test_names_of_elements():
    assert pages.meaning("div", ' class="cookie-banner"', False) == (True, False)
    assert pages.meaning("div", " id=articleBody", False) == (False, True)
    assert pages.meaning("header", "", False) == (True, False) and pages.meaning("header", "", True) == (False, False)
    assert pages.meaning("div", ' style="display: none"', True)[0] and pages.meaning("p", " hidden", True)[0]
    assert pages.meaning("div", " class='shadow-roadside addressed'", False) == (False, False)


def test_the_tree_is_the_best_first_split():
    g = np.random.default_rng(2)
    x = g.integers(0, 6, (40, 3)).astype(float)
    y = ((x[:, 1] > 3) | (x[:, 2] == 0) & (x[:, 0] > 2)).astype(int)
    feature, threshold, *_ = pages.grow(x, y, 1)

    def gini(part):
        return 2 * part.sum() * (len(part) - part.sum()) / len(part)

    tried = [
        (gini(y[x[:, f] <= t]) + gini(y[x[:, f] > t]), f, t)
        for f in range(3)
        for t in np.arange(0.5, 5)
        if min((x[:, f] <= t).sum(), (x[:, f] > t).sum()) >= pages.LEAST_LEAF
    ]
    best = min(tried)
    assert gini(y[x[:, feature] <= threshold]) + gini(y[x[:, feature] > threshold]) == pytest.approx(best[0])
    assert (pages.judged(pages.grow(x, y), x) != y).sum() <= 4


def test_pages_beyond_the_labelled_table(spark):
    menu, advert = "<nav><a href=a>Home</a> <a href=b>News</a></nav>", f"<div class='sponsored-box'>{words(50, 'buy')}</div>"
    article = f"<h1>Title &amp; more</h1><p>{words(60)}</p><p>Of.</p>"
    comments = f"<section id=comments><h2>Comments</h2><div><p>{words(70, 'reader')}</p></div><form><label>Name</label><textarea>x</textarea></form></section>"
    whole = f"<header><p>{words(30, 'site')}</p></header>{menu}<article>{article}{advert}<p>{words(40, 'end')}</p></article>{comments}<footer><p>{words(40, 'legal')}</p>"
    want = f"Title & more\n{words(60)}\nOf.\n{words(40, 'end')}"
    div_only = f"<div><a href=a>Home</a> <a href=b>News</a></div><div><h1>{words(9, 'head')}</h1><p>{words(60)}<p>ok<p>{words(50)}</div><div>Copyright by us</div>"
    got = main_text(spark, whole, whole, div_only, None, "", f"<article><p>{words(200_000)}</p></article>", menu)
    assert got == [want, want, f"{words(9, 'head')}\n{words(60)}\nok\n{words(50)}", "", "", words(200_000), ""]


def test_given_pages(spark, testdata):
    """The given pages mark their article; the tree was grown without them."""
    rows = spark.read.parquet(f"{testdata}/pages.parquet").collect()
    got = {r["page_id"]: r for r in pages.op13_block_tree(spark, testdata).collect()}
    assert len(got) == len(rows)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", r["html"], re.DOTALL).group(1)
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", article))
        want = "\n".join(b for b in blocks if b)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_given_pages_without_names(testdata):
    """Without any tag but div and p, shapes alone keep most words of articles and few others."""
    import pyarrow.parquet as pq

    tree, kept, wrong, lost = pages.train(), 0, 0, 0
    for page in pq.read_table(f"{testdata}/pages.parquet")["html"].to_pylist():
        wanted = set(cut(re.search(r"<article>.*?</article>", page, re.DOTALL).group(0)))
        blocks = pages.Cutter().cut(re.sub(r"<(/?)(?:article|nav|footer)>", r"<\1div>", page).replace(' class="ad"', ""))
        for block, verdict in zip(blocks, pages.judged(tree, pages.shapes(blocks)), strict=True):
            right = block.text in wanted
            kept += block.words * (right and verdict)
            wrong += block.words * (not right and verdict)
            lost += block.words * (right and not verdict)
    assert kept / (kept + lost) > 0.85 and kept / (kept + wrong) > 0.95


def test_no_pages(spark):
    assert pages.extract(spark.createDataFrame([], "page_id long, html string")).collect() == []
