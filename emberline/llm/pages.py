"""Main text of web pages: flat text blocks, classified by a decision tree from their own and their neighbours' shape.

A page is cut into blocks at the tags that start or end a block, or at two line breaks in a row. Each block has a word
count and a link density (its share of words inside links), those of the blocks before and after it, and a standing
by its ancestors' tags, classes, ids and roles: 0 inside a menu, form, advert or the like, 1 inside an article, and
else between 0 and a half, the less the more of the page's words stand in articles. A decision tree decides. It is grown here, by Gini
impurity, from `LABELLED` and `NAMED`, small tables of sketched pages; tests hold the given pages out.

Defined results: a null or empty page has no text. Scripts, styles, titles, frames and comments are dropped, at the
end of the page where they are not closed; a tag cut off by the end of the page is dropped, a lone `<` is text. White
space is what Unicode calls so, no-break spaces included. A reference that is none stays as it is. A page without
article text has an empty text. Pages are read whole, at any length; equal rows get equal results. No pages give no
rows. All other columns are kept; columns of the names `text`, `blocks` and `n_blocks` are replaced.
"""

from __future__ import annotations

import html
import re
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.llm.common import per_batch, read

# Elements of HTML by what they mean for blocks.
RAW = "script style title textarea iframe noembed noframes xmp"
BLOCKS = (
    "address article aside blockquote body canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noscript object ol option p pre search section select summary svg "
    "table tbody td template tfoot th thead tr ul video audio button label"
).split()
VOID = frozenset("hr".split())
#: An element that ends an open one of these names, down to the nearest of the others.
ENDS = {
    "p": ({"p"}, set()),
    "li": ({"li", "p"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd", "p"}, {"dl"}),
    "dd": ({"dt", "dd", "p"}, {"dl"}),
    "tr": ({"tr", "td", "th", "p"}, {"table"}),
    "td": ({"td", "th", "p"}, {"tr", "table"}),
    "th": ({"td", "th", "p"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
# What stands outside an article, by tag and by words of class, id and role.
ASIDE_TAGS = frozenset(
    "nav aside form footer menu dialog search select option button label fieldset legend head noscript template svg canvas object audio video".split()
)
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner nav navbar navigation menu submenu "
    "breadcrumb breadcrumbs sidebar aside rail widget widgets footer masthead topbar toolbar cookie cookies consent gdpr privacy notice notices "
    "notification alert popup modal overlay dialog newsletter subscribe subscription signup signin login register search share sharing social "
    "related recommended recommendations trending popular comment comments commentlist reply replies respond disqus discussion pagination "
    "pager paging copyright legal disclaimer tagcloud skip contentinfo complementary paywall print toolbox hidden".split()
)
ARTICLE_TAGS = frozenset("article main".split())
ARTICLE_WORDS = frozenset("article articlebody post entry story content main hentry".split())

#: Blocks of sketched pages: label (1 article), path of tags and classes, words, words in links, repeats. One page a string.
LABELLED = (
    "0 nav>ul>li 1/1 x6; 0 div.ad 9; 1 article>h1 8; 1 article>p 60; 1 article>p 3; 1 article>p 1; 1 article>p 45/3; 0 footer 9",
    "0 nav>li 2/2 x4; 0 div.advert 40; 1 article>h1 12; 1 article>p 1; 1 article>p 2; 1 article>p 7; 0 footer>p 30",
    "0 header>a 3/3; 0 header>nav>a 1/1 x5; 1 main>h1 6; 1 main>p 80/4; 1 main>ul>li 9 x3; 1 main>h2 3; 1 main>p 50; 0 aside>h3 2; 0 aside>p 45; 0 footer>a 2/2 x3",
    "0 div.menu>a 1/1 x5; 0 div.cookie-notice>p 32/2; 0 div.cookie-notice>button 1; 1 div.post>h1 9; 1 div.post>p 70; 1 div.post>p 8; 1 div.post>blockquote 25; 0 div.share>a 1/1 x3; 0 div#comments>h3 2; 0 div#comments>p 40 x3; 0 div.footer 12",
    "0 div>a 1/1 x7; 0 div 10/1; 1 h1 8; 1 p 64; 1 p 38/2; 1 p 4; 1 p 52; 0 div 9/7; 0 div 8/3",
    "0 table>tr>td 2/2 x6; 1 td>h1 5; 1 td>p 90/5; 1 td>p 20; 1 td>p 75; 0 td 3/3 x4; 0 td 11/4",
    "0 ul>li 1/1 x8; 1 h2 7; 1 div 120/6; 1 div 44; 1 div 61/1; 0 ul>li 6/6 x5; 0 p 13/2",
    "0 nav>a 1/1 x4; 1 article>header>h1 9; 1 article>header>p 5; 1 article>p 66/2; 1 article>figure>figcaption 11; 1 article>p 48; 0 article>aside>p 28; 1 article>p 33; 0 article>footer>a 1/1 x4; 0 section.comments>article>p 50 x2; 0 section.comments>form>label 2 x2; 0 footer>p 14",
    "0 form>label 1 x2; 0 form>p 18; 1 article>h1 6; 1 article>p 5; 1 article>p 9; 0 div.newsletter>p 24; 1 article>p 12; 0 div.related>h3 2; 0 div.related>li 8/8 x4; 0 footer>p 20",
    "0 div#sidebar>h4 2; 0 div#sidebar>p 55 x2; 0 div#sidebar>li 4/4 x5; 1 div#content>h1 10; 1 div#content>p 85/3; 1 div#content>p 41; 1 div#content>pre 30; 1 div#content>p 6; 0 div.pagination>a 1/1 x6",
    "0 header>div 6; 0 header>p 16; 0 nav>a 2/2 x5; 1 main>article>h1 11; 1 main>article>p 3 x4; 1 main>article>p 70; 0 main>aside>div 35; 1 main>article>p 2; 0 footer>div 26",
    "0 p 2/2 x3; 0 p 9; 1 h1 9; 1 p 33; 1 p 47; 1 p 5; 1 p 58; 1 p 29/1; 0 p 6/6; 0 p 3/3 x4",
    "0 div 3/3 x4; 0 div 14/2; 0 div 5/5 x3; 0 div 4; 0 div 7/6",
    "0 ul>li 2/2 x10; 0 p 8; 0 ul>li 3/3 x10; 0 p 12/3",
    "0 nav>a 1/1 x5; 0 div.alert>p 22; 1 div.entry-content>p 40; 1 div.entry-content>ul>li 4/4 x2; 1 div.entry-content>ul>li 12/5; 1 div.entry-content>p 35; 0 div.widget>p 30; 0 div.copyright 7",
    "1 article>h1 7; 1 article>p 110/9; 1 article>table>td 1 x4; 1 article>h2 2; 1 article>ul>li 6/6 x2; 1 article>p 18/2; 1 article>p 64",
    "1 h1 6; 1 p 40; 1 p 72; 1 p 16; 1 p 51",
    "1 p 25; 1 p 90/2",
    "1 p 70",
    "0 div.masthead>h1 2; 0 div.topbar 5; 1 div.story>h1 10; 1 div.story>p 1; 1 div.story>p 55; 1 div.story>p 2; 0 div.story>div.ad 12; 0 div.story>div.ad 45; 1 div.story>p 44; 0 div.story>div.comments>p 70; 0 div.legal>p 60",
    "0 nav>li 1/1 x6; 0 div.ad 12; 1 article>h1 15; 1 article>p 200/2; 1 article>p 150; 0 footer 12; 0 footer 5",
    "0 div 20; 0 div>a 2/2 x6; 0 section>h2 3; 0 section>p 30; 1 article>h1 9; 1 article>p 12; 1 article>p 30; 0 section>p 18; 0 div 40; 0 div 6",
    "0 div 45; 1 main>h1 4; 1 main>p 22; 1 main>p 4; 0 div 60; 0 div 3",
    "1 article>h1 7; 1 article>p 50/8; 1 article>p 1/1; 1 article>p 2/1; 1 article>p 35/20; 0 article>div.related>li 8/8 x4; 0 article>nav>a 3/3 x3; 0 article>div.share>a 2/2 x3; 0 article>div.related>p 30/9",
    "0 nav>a 4/4 x3; 1 main>h1 5; 1 main>p 1/1; 1 main>p 90/30; 1 main>li 3/3 x3; 1 main>p 2/2; 0 main>div.comments>h2 1; 0 main>div.comments>p 30/6 x2; 0 main>div.comments>p 5/1; 0 main>form>p 12/3; 0 main>div.promo>p 60/12",
    "0 li 1/1 x6; 0 div 11; 1 h1 13; 1 p 90; 1 p 2; 1 p 30; 1 p 1; 1 p 7; 1 p 70; 1 p 3; 1 p 55; 1 p 1; 0 div 12",
    "0 li 2/2 x4; 0 div 8; 1 h1 9; 1 p 4; 1 p 12; 1 p 110; 1 p 6; 1 p 25; 1 p 1; 1 p 140; 0 div 8",
)
#: The same, of pages where only names tell what is no article.
NAMED = (
    "0 div 60; 0 div>p 30; 1 article>h1 8; 1 article>p 70; 1 article>p 40; 0 div 50; 0 div>h3 9; 0 div>p 80 x2; 0 p 45",
    "1 main>h1 7; 1 main>p 60; 1 main>p 120; 0 div>h3 8; 0 div>p 100 x2; 0 div 20; 0 section>h2 7; 0 section>p 65; 0 div 30",
    "0 section>h2 5; 0 section>p 90; 1 div.content>h1 7; 1 div.content>p 90; 1 div.content>p 140; 0 div>p 70; 0 div>p 25",
)

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "standing", "heading", "paragraph")
#: The tree stops at this depth, or where a leaf would have fewer blocks.
DEPTH, LEAST_LEAF = 10, 3

_RAW = "|".join(RAW.split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|--!>|\Z)"
    rf"|<(?P<raw>{_RAW})\b(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+(?:>.*?(?:</(?P=raw)\b[^>]*+(?:>|\Z)|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*+)(?P<rest>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.IGNORECASE | re.DOTALL,
)
ATTRIBUTE = re.compile(r"([a-z-]+)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"']++))", re.IGNORECASE)
WORD_OF_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
BLOCK_TAGS = frozenset(BLOCKS)
HEADINGS, PARAGRAPHS = frozenset("h1 h2 h3 h4 h5 h6".split()), frozenset("p blockquote pre".split())


@cache
def _names(value: str) -> frozenset[str]:
    return frozenset(w.lower() for w in WORD_OF_NAME.findall(value))


def meaning(name: str, rest: str, inside_article: bool) -> tuple[bool, bool]:
    """Whether an element stands aside, and whether it is an article, by its tag and attributes."""
    aside, article = name in ASIDE_TAGS, name in ARTICLE_TAGS
    words: set[str] = set()
    if rest:
        for attribute, *values in ATTRIBUTE.findall(rest):
            attribute, value = attribute.lower(), "".join(values)
            if attribute in ("class", "id", "role", "itemprop"):
                words |= _names(value)
            elif attribute == "style":
                aside |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE))
            elif attribute == "aria-hidden":
                aside |= value.lower() == "true"
        aside |= bool(re.search(r"(?:^|\s)hidden(?=[\s/]|$)", rest, re.IGNORECASE)) if "hidden" in rest.lower() else False
    own = bool(words & ARTICLE_WORDS)
    # The head of an article belongs to it; that of the page does not.
    head = (name == "header" or bool(words & {"header", "head"})) and not inside_article and not own and not article
    return aside or head or bool(words & ASIDE_WORDS), article or own


class Block:
    __slots__ = ("text", "words", "linked", "aside", "article", "name")

    def __init__(self, text: str, words: int, linked: int, aside: bool, article: bool, name: str):
        self.text, self.words, self.linked, self.aside, self.article, self.name = text, words, linked, aside, article, name


class Cutter:
    """Cuts one page into blocks."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.open: list[tuple[str, bool, bool]] = []
        self.counts: dict[str, int] = {}
        self.parts: list[tuple[str, bool]] = []
        self.link_at: int | None = None
        self.breaks = 0

    def flush(self) -> None:
        if not self.parts:
            return
        text = " ".join("".join(part for part, _ in self.parts).split())
        if text:
            linked = sum(len(part.split()) for part, link in self.parts if link)
            name, aside, article = self.open[-1] if self.open else ("", False, False)
            words = text.count(" ") + 1
            self.blocks.append(Block(text, words, min(linked, words), aside, article, name))
        self.parts = []

    def text(self, raw: str) -> None:
        if raw:
            if self.breaks and not raw.isspace():
                self.breaks = 0
            self.parts.append((html.unescape(raw), self.link_at is not None))

    def pop(self, size: int) -> None:
        for name, _, _ in self.open[size:]:
            self.counts[name] -= 1
        del self.open[size:]
        if self.link_at is not None and self.link_at > size:
            self.link_at = None

    def start(self, name: str, rest: str) -> None:
        if name == "br":
            self.breaks += 1
            self.parts.append((" ", False))
            if self.breaks > 1:
                self.flush()
            return
        if name == "a":
            self.link_at = len(self.open)
            return
        if name not in BLOCK_TAGS and "-" not in name:
            return
        self.flush()
        self.breaks = 0
        ended, until = ENDS.get(name, ({"p"} if name in BLOCK_TAGS else set(), set()))
        if any(self.counts.get(e) for e in ended):
            size = len(self.open)
            for at in range(size - 1, -1, -1):
                held = self.open[at][0]
                if held in ended:
                    size = at
                elif not until or held in until:
                    break
            self.pop(size)
        if name in VOID:
            return
        _, aside, article = self.open[-1] if self.open else ("", False, False)
        own_aside, own_article = meaning(name, rest, article)
        self.open.append((name, aside or own_aside, article or own_article))
        self.counts[name] = self.counts.get(name, 0) + 1

    def end(self, name: str) -> None:
        if name == "a":
            self.link_at = None
            return
        if name not in BLOCK_TAGS and "-" not in name:
            return
        self.flush()
        self.breaks = 0
        if self.counts.get(name):
            at = len(self.open) - 1
            while self.open[at][0] != name:
                at -= 1
            self.pop(at)

    def cut(self, page: str) -> list[Block]:
        at = 0
        for token in TOKEN.finditer(page):
            self.text(page[at : token.start()])
            at = token.end()
            name = token["name"]
            if name:
                (self.end if token["end"] else lambda n: self.start(n, token["rest"]))(name.lower())  # noqa: B023
        self.text(page[at:])
        self.flush()
        return self.blocks


def shapes(blocks: list[Block]) -> np.ndarray:
    """A row of `FEATURES` for each block of one page."""
    words = np.array([b.words for b in blocks], dtype=float)
    links = np.array([b.linked for b in blocks], dtype=float) / words
    aside, article = (np.array([getattr(b, n) for b in blocks], dtype=bool) for n in ("aside", "article"))
    before = lambda x: np.concatenate([[0.0], x[:-1]])
    after = lambda x: np.concatenate([x[1:], [0.0]])
    share = words[article & ~aside].sum() / words.sum()
    standing = np.where(aside, 0.0, np.where(article, 1.0, (1 - share) / 2))
    heading, paragraph = (np.array([b.name in kind for b in blocks], dtype=float) for kind in (HEADINGS, PARAGRAPHS))
    return np.stack([words, links, before(words), before(links), after(words), after(links), standing, heading, paragraph], axis=1)


def grow(x: np.ndarray, y: np.ndarray, depth: int = DEPTH) -> tuple | int:
    """A tree: a class, or (feature, threshold, tree up to it, tree above it). Ties take the first feature."""
    ones = int(y.sum())
    if depth == 0 or ones in (0, len(y)) or len(y) < 2 * LEAST_LEAF:
        return int(2 * ones >= len(y))
    best = None
    for feature in range(x.shape[1]):
        order = np.argsort(x[:, feature], kind="stable")
        value, ahead = x[order, feature], np.cumsum(y[order])
        n = np.arange(1, len(y))
        cut = np.flatnonzero((value[1:] > value[:-1]) & (n >= LEAST_LEAF) & (len(y) - n >= LEAST_LEAF))
        if not len(cut):
            continue
        left, right, a = n[cut], len(y) - n[cut], ahead[cut]
        impurity = 2 * a * (left - a) / left + 2 * (ones - a) * (right - ones + a) / right
        at = int(impurity.argmin())
        if best is None or impurity[at] < best[0] - 1e-12:
            best = (impurity[at], feature, float(value[cut[at]] + value[cut[at] + 1]) / 2)
    if best is None:
        return int(2 * ones >= len(y))
    _, feature, threshold = best
    low = x[:, feature] <= threshold
    below, above = grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)
    return below if below == above and isinstance(below, int) else (feature, threshold, below, above)


def judged(tree: tuple | int, x: np.ndarray) -> np.ndarray:
    """The class of each row."""
    out = np.zeros(len(x), dtype=np.int64)
    todo = [(tree, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if isinstance(node, int):
            out[rows] = node
            continue
        feature, threshold, low, high = node
        is_low = x[rows, feature] <= threshold
        todo += [(low, rows[is_low]), (high, rows[~is_low])]
    return out


def sketched(page: str) -> tuple[str, list[int]]:
    """HTML of a row of the labelled table, and its blocks' labels."""
    out, labels = [], []
    for entry in page.split(";"):
        label, path, size, *repeat = entry.split()
        words, _, linked = size.partition("/")
        plain, linked = int(words) - int(linked or 0), int(linked or 0)
        tags = [re.fullmatch(r"(\w+)(?:\.([\w-]+)|#([\w-]+))?", step).groups() for step in path.removesuffix(">a").split(">")]
        starts = "".join(f"<{t}{f' class={c}' if c else ''}{f' id={i}' if i else ''}>" for t, c, i in tags)
        ends = "".join(f"</{t}>" for t, _, _ in reversed(tags))
        inside = " ".join(["word"] * plain) + (f" <a href=x>{' '.join(['word'] * linked)}</a>" if linked else "")
        for _ in range(int(repeat[0][1:]) if repeat else 1):
            out.append(f"{starts}{inside}{ends}")
            labels.append(int(label))
    return "".join(out), labels


def unnamed(page: str) -> str:
    """The same row of the labelled table with nothing but `div` around its blocks: shapes alone must tell."""
    return re.sub(r"(?<=[ >])(?:nav|header|footer|aside|form|article|main|section|label|button|div)\b", "div", re.sub(r"[.#][\w-]+(?=[> ])", "", page))


def train(labelled: tuple[str, ...] = LABELLED, named: tuple[str, ...] = NAMED) -> tuple | int:
    """The tree grown from a table of sketched pages, each as it is and, but for `named`, without names."""
    rows, labels = [], []
    for page in (*labelled, *named, *map(unnamed, labelled)):
        text, wanted = sketched(page)
        rows.append(shapes(Cutter().cut(text)))
        labels += wanted
    return grow(np.concatenate(rows), np.array(labels))


ADDED = (
    T.StructField("text", T.StringType()),
    T.StructField("n_blocks", T.LongType()),
    T.StructField("blocks", T.ArrayType(T.StringType())),
)


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """All columns of `pages`, the main text, the blocks it was joined from, and the number of blocks of the page."""
    tree = train()

    def make():  # noqa: ANN202
        def compute(values: list[str | None]) -> list[list]:
            cut = [Cutter().cut(v) if v else [] for v in values]
            flat = [shapes(blocks) for blocks in cut if blocks]
            verdicts = iter(judged(tree, np.concatenate(flat)).tolist() if flat else [])
            kept = [[b.text for b in blocks if next(verdicts)] for blocks in cut]
            return [["\n".join(k) for k in kept], [len(b) for b in cut], kept]

        return compute

    return per_batch(pages, [column], list(ADDED), make)


def op13_block_tree(spark: SparkSession, directory: str) -> DataFrame:
    found = extract(read(spark, directory, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
