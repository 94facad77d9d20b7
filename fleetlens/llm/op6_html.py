"""Main text of web pages: flat text blocks, described by their own and their neighbours' word counts and link
densities and by the containers they lie in, are kept or dropped by a decision tree learned from a small table."""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fleetlens.llm.common import table

# Element names by role.
SILENT = frozenset("script style noscript template head title svg iframe object select button textarea canvas audio video".split())
# Silent elements whose content is skipped up to their closing tag, whatever it holds, and those that may stand in a head.
RAW = frozenset("script style noscript template title iframe textarea".split())
IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template".split())
BREAKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset("article main".split())
LISTED = frozenset("li dd dt td th".split())
TEXT_IN_DRAWINGS = frozenset("foreignobject annotation-xml".split())
ASIDE = frozenset("nav footer aside form menu dialog".split())
# Asides that hold no article of the page: other ones prove to be wrappers when it begins in them.
FIRM = ASIDE - {"form"}
# Words in class, id or role that mark a container as something other than the article, unless "has" or the
# like stands before them.
_NOT_HAVING = r"(?:^|[\s_-])(?<!\bhas[_-])(?<!\bwith[_-])(?<!\bwithout[_-])(?<!\bno[_-])"
ASIDE_WORDS = re.compile(
    _NOT_HAVING + r"(?:ad|ads|advert\w*|sponsor\w*|promo\w*|banner|breadcrumbs?|comments?|disqus|cookies?|consent|notice|alert|"
    r"footer|header|masthead|menu|nav|navbar|navigation|newsletter|pager|pagination|popup|modal|related|recommended|share|sharing|"
    r"sidebar|social|subscribe|signup|login|widget|copyright|contentinfo|complementary|search)(?:$|[\s_-])", re.I)
# Of these, words that as often name a part of an article; and words of containers that wrap a whole page.
WEAK_WORDS = re.compile(_NOT_HAVING + r"(?:banner|alert|header|menu|share|sharing|social|login|widget|search)(?=$|[\s_-])", re.I)
WRAPPER_WORDS = re.compile(r"(?:^|[\s_-])(?:wrap\w*|page|content|container|layout|row|site|body)(?:$|[\s_-])", re.I)

# A quote opens a value only behind "="; "<" is allowed in quoted values alone, so a bare one never takes text or a closing tag along.
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/<>]*+)"
    r"(?P<attrs>(?:=\s*\"(?:[^\"]*\"|[^\">]*\Z)|=\s*'(?:[^']*'|[^'>]*\Z)|[^<>])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
QUOTED, UNQUOTED_END = re.compile(r"\"[^\"]*\"|'[^']*'"), re.compile(r"=\s*[^\s\"']\S*\Z")
MARKS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


#: Words of a block of an article from which on the page's article has been found.
TOLD = 10


@dataclass
class Block:
    text: str
    words: int
    linked: int
    main: bool
    heading: bool
    listed: bool
    node: int
    aside: float = 0.0  # 1 in an aside, 0.5 if only a weak word says so

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


@dataclass
class _Aside:
    """A container that may be something other than the article."""

    parent: int
    name: str
    mark: str
    weight: float
    wrapper: bool
    bad: float  # the most that it and the containers around it weigh
    settled: bool = False
    words: int = 0
    titled: bool = False


class _Page:
    """What is open at a place of the page. Every element is opened and closed once, and each question about the open
    ones is a count or the top of a stack, so a page is read in time proportional to its length."""

    def __init__(self, has_main: bool):
        self.has_main = has_main
        self.blocks: list[Block] = []
        self.parts: list[tuple[str, bool]] = []
        self.names: list[str] = []
        self.nodes: list[int] = []  # per open element the innermost container of asides
        self.breaks: list[int] = []  # places of open elements that end a paragraph's reach
        self.drawings: list[int] = []
        self.asides: list[_Aside] = []
        self.count: Counter[str] = Counter()
        self.hidden = 0  # open silent elements
        self.wraps: set[str] = set()  # marks that turned out to be those of wrappers
        self.main_told = False  # whether a main element has given text
        self.told = False  # whether an article has

    def any(self, names: frozenset[str]) -> bool:
        return any(self.count[n] for n in names)

    def push(self, name: str, attrs: str) -> None:
        above = self.nodes[-1] if self.nodes else -1
        weight, mark = _aside(name, attrs, self.any(MAIN))
        node = above
        if weight:
            around = self.asides[above].bad if above >= 0 else 0.0
            wrapper = mark in self.wraps and name not in FIRM
            self.asides.append(_Aside(above, name, mark, weight, wrapper, around if wrapper else max(around, weight)))
            node = len(self.asides) - 1
        if name in BREAKS or name in SILENT:
            self.breaks.append(len(self.names))
        if name in ("svg", "math"):
            self.drawings.append(len(self.names))
        self.names.append(name)
        self.nodes.append(node)
        self.count[name] += 1
        self.hidden += name in SILENT

    def cut(self, at: int) -> None:
        """Closes the open elements from this place on."""
        for name in self.names[at:]:
            self.count[name] -= 1
            self.hidden -= name in SILENT
        del self.names[at:], self.nodes[at:]
        for places in (self.breaks, self.drawings):
            while places and places[-1] >= at:
                places.pop()

    def end_block(self) -> None:
        text = " ".join("".join(t for t, _ in self.parts).split())
        if text:
            linked = sum(len(t.split()) for t, in_link in self.parts if in_link)
            node = self.nodes[-1] if self.nodes else -1
            block = Block(text, len(text.split()), linked, self.any(MAIN), self.any(HEADINGS), self.any(LISTED), node)
            self.blocks.append(block)
            aside = node >= 0 and self.asides[node].bad
            self.main_told |= bool(self.count["main"]) and not aside
            self.told |= block.main and not aside and block.words >= TOLD and block.density < 0.5
            if node >= 0:
                self.asides[node].words += block.words - linked
                self.asides[node].titled |= bool(self.count["h1"])
        self.parts = []

    def add(self, source: str) -> None:
        if source and not source.isspace():
            self.end_head()
        if source and not self.hidden:
            self.parts.append((html.unescape(source), bool(self.count["a"])))

    def close(self, name: str) -> None:
        if self.count[name]:
            at = len(self.names) - 1
            while self.names[at] != name:
                at -= 1
            self.cut(at)

    def end_head(self, within: bool = False) -> None:
        """Ends a head that was left open, for what belongs to the body: text in no element of the head, other elements."""
        if self.names and self.names[-1] == "head" or within and self.count["head"]:
            self.close("head")

    def end_paragraph(self) -> None:
        """A new paragraph ends an open one together with the inline elements in it."""
        if self.breaks and self.names[self.breaks[-1]] == "p":
            self.cut(self.breaks[-1])

    def unwrap(self, name: str) -> None:
        """An article or main begins: what its open containers are called does not make it an aside.

        Comments and teasers, too, are articles in containers with such names, but come after the page's article or beside
        its main element; there the names count.
        """
        if name != "main" and (self.told or (self.has_main and not self.count["main"])):
            return
        path, node = [], self.nodes[-1] if self.nodes else -1
        while node >= 0 and not self.asides[node].settled:
            path.append(node)
            node = self.asides[node].parent
        for i in reversed(path):
            aside = self.asides[i]
            around = self.asides[aside.parent].bad if aside.parent >= 0 else 0.0
            aside.settled = True
            if aside.name not in FIRM:
                aside.wrapper = True
                self.wraps.add(aside.mark)
            aside.bad = around if aside.wrapper else max(around, aside.weight)

    def end_drawing(self) -> None:
        """Ends drawings and formulas that were left open before a block of text."""
        if self.drawings and not self.any(TEXT_IN_DRAWINGS):
            self.cut(self.drawings[0])

    def judge(self) -> None:
        """Says of every block whether it lies in an aside.

        On a page without article and main, a container that holds more than half of the plain text is a wrapper if its
        name says so, if it holds the page's title, or if it is a form around the page.
        """
        total = sum(b.words - b.linked for b in self.blocks)
        alone = not any(b.main for b in self.blocks)
        for a in reversed(self.asides):  # containers come after those around them
            if a.parent >= 0:
                self.asides[a.parent].words += a.words
                self.asides[a.parent].titled |= a.titled
        for a in self.asides:
            if alone and a.name not in FIRM and 2 * a.words > total and (a.titled or a.name == "form" or WRAPPER_WORDS.search(a.mark)):
                a.wrapper = True
            around = self.asides[a.parent].bad if a.parent >= 0 else 0.0
            a.bad = around if a.wrapper else max(around, a.weight)
        for b in self.blocks:
            b.aside = self.asides[b.node].bad if b.node >= 0 else 0.0


def _aside(name: str, attrs: str, inside_main: bool) -> tuple[float, str]:
    """How much an element is an aside (1, or 0.5 for weak words alone), and what says so: its name, or class, id and role.

    Paragraphs and headings are asides only by strong words.
    """
    if name in ASIDE or (name == "header" and not inside_main):
        return 1.0, name
    if name in ("html", "body", "article", "main") or not attrs:
        return 0.0, ""
    marks = [v for a, b, c in MARKS.findall(attrs) if ASIDE_WORDS.search(v := a or b or c)]
    if not marks:
        return 0.0, ""
    strong = any(ASIDE_WORDS.search(WEAK_WORDS.sub(" ", v)) for v in marks)
    if not strong and (name == "p" or name in HEADINGS):
        return 0.0, ""
    return 1.0 if strong else 0.5, " ".join(marks)


def _self_closed(attrs: str) -> bool:
    """A slash that ends an unquoted value closes nothing."""
    return attrs.endswith("/") and not UNQUOTED_END.search(QUOTED.sub('""', attrs))


def _raw_end(source: str, name: str, at: int) -> int:
    """Where the content of a raw element that starts at ``at`` and its closing tag end, or -1 if nothing closes it."""
    depth = 1
    for m in re.compile(rf"<(/?){name}(?=[\s/>]|\Z)", re.I).finditer(source, at):
        if m[1]:
            depth -= 1
        elif name == "template":  # the only one that nests
            depth += 1
        if not depth:
            return source.find(">", m.end()) + 1 or len(source)
    return -1


def blocks(source: str) -> list[Block]:
    """The text blocks of a page in order. Unclosed and cut-off markup is read as far as it goes."""
    page = _scan(source, "<main" in source.lower())
    page = page if page.main_told or not page.has_main else _scan(source, False)
    page.judge()
    return page.blocks


def _scan(source: str, has_main: bool) -> _Page:
    page, at, unclosed = _Page(has_main), 0, set()
    while m := TOKEN.search(source, at):
        name = (m["name"] or "").lower()
        page.add(source[at : m.start()])
        at = m.end()
        if not name:
            continue
        if m["close"]:
            if name in BREAKS and not page.hidden:
                page.end_block()
            page.close(name)
            continue
        if name not in IN_HEAD and name != "head":
            page.end_head(True)
        if name in RAW:
            if _self_closed(m["attrs"]):
                continue
            end = -1 if name in unclosed else _raw_end(source, name, at)
            if end >= 0 or name in ("script", "style"):
                at = end if end >= 0 else len(source)
                continue
            unclosed.add(name)
        elif (name in SILENT or name == "math") and _self_closed(m["attrs"]):
            continue
        if name in BREAKS and name not in VOID:
            page.end_drawing()
        if name in BREAKS and not page.hidden:
            page.end_block()
        elif name == "br":
            page.parts.append((" ", False))
        if name not in VOID:
            if name in ("p", "li", *HEADINGS) and page.names and page.names[-1] == name:
                page.cut(len(page.names) - 1)
            elif name == "p":
                page.end_paragraph()
            if name in MAIN and not page.hidden:
                page.unwrap(name)
            page.push(name, m["attrs"])
    page.add(source[at:])
    page.end_block()
    return page


FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "main", "aside", "heading", "listed")


def features(found: list[Block]) -> np.ndarray:
    """One row per block; ``main`` is 1 in an article, 0 beside one, 0.5 on a page without one."""
    words, density = [b.words for b in found], [b.density for b in found]
    has_main = any(b.main for b in found)
    main = [float(b.main) if has_main else 0.5 for b in found]
    return np.array([words, density, [0, *words[:-1]], [0, *density[:-1]], [*words[1:], 0], [*density[1:], 0], main,
                     [b.aside for b in found], [b.heading for b in found], [b.listed for b in found]], float).T.reshape(len(found), len(FEATURES))


#: The labelled table, as small pages: n stands for a text of n words, [n] for a link of n words, n [m] for n words of
#: which m are in a link; blocks marked + are main text.
PAGES = (
    # an article between menus, adverts, notices and a footer
    """<nav><li>[1]</li><li>[2]</li></nav><div class=ad>9</div><article><h1>+7</h1><p>+85</p><p>+3</p><p>+30</p><h2>+2</h2><p>+1</p><p>+140</p></article>
       <aside>12</aside><footer>5</footer>""",
    """<header><a>[2]</a></header><div class=cookie-notice>10</div><article><h1>+10</h1><p>+12</p><form>8</form><p>+4</p><div id=comments><p>15</p><p>60</p></div>
       <p>+25</p></article><footer>4</footer>""",
    """<ul class=menu><li>[1]</li><li>[1]</li></ul><main><h1>+6</h1><p>+55</p><div class=newsletter>20</div><p>+6</p><div class=related><p>[5]</p><p>40</p></div></main>
       <div class=sidebar><h3>2</h3><p>35</p><p>3</p></div>""",
    # in an article: linked headings and paragraphs, lists of text, lists of text with links
    "<article><h1>+[6]</h1><p>+40</p><h2>+[3]</h2><p>+60</p><p>+[4]</p><p>+20</p><p>+[9]</p><p>+33</p></article>",
    "<article><p>+30</p><ul><li>+5</li><li>+12</li><li>+1</li></ul><p>+2</p><ol><li>+25</li><li>+4</li></ol></article>",
    "<article><p>+30</p><ul><li>+[3]</li></ul><p>+44</p><ul><li>+9 [3]</li><li>+6 [2]</li></ul><p>+20 [8]</p><p>+7 [3]</p></article>",
    "<article><p>+16</p><p>+[3]</p><p>+16</p><h2>+[5]</h2><p>+8</p><p>+[2]</p><p>+3</p><p>+[12]</p></article>", "<article><h2>+[4]</h2><p>+[7]</p><p>+[30]</p></article>",
    "<article><p>+100</p><p>+[1]</p><p>+1</p><h3>+[2]</h3><h2>+[8]</h2><p>+200</p></article>",
    # lists of links at its end or in it
    "<article><p>+16</p><ul><li>[3]</li><li>[4]</li></ul><p>+100</p><ul><li>[1]</li><li>[20]</li></ul><p>+3</p></article>",
    "<article><p>+100</p><ul><li>[1]</li><li>[2]</li><li>[9]</li></ul><p>+40</p><ul><li>[6]</li><li>[6]</li></ul><h2>+3</h2></article>",
    "<article><h1>+5</h1><p>+50</p><p>+21</p><ul><li>[4]</li><li>[5]</li><li>[3]</li></ul></article><p>8</p>",
    "<article><p>+70</p><ul><li>[8]</li><li>[7]</li></ul><p>+18</p><p>+2</p></article><div>30</div><p>50</p>",
    # weak words: parts of an article with much text, or bars of buttons
    """<article><p>+60</p><div class=share>1</div><div class=share>[2]</div><div class="share price"><p>+24</p><p>+40</p></div><div class=search>3</div><div class=header><p>+16</p></div>
       <div class=social>[1]</div><div class=widget>4</div><div class=menu>2 [2]</div><p>+9</p></article>""",
    "<div class=header>2</div><div class=login>6</div><article><p>+22</p><div class=alert><p>+30</p></div></article><div class=banner>14</div><div class=search>40</div>",
    # beside an article, without a telling container
    "<p>6</p><p>30</p><article><h1>+4</h1><p>+80</p><p>+5</p></article><p>50 [5]</p><h3>8</h3><p>2</p><p>90</p>",
    "<div>[3]</div><article><p>+4</p></article><div>60</div><p>1</p>", "<p>3</p><article><p>+1</p><h2>+1</h2></article><p>20</p>",
    # pages without an article
    "<li>[1]</li><li>[3]</li><h1>+6</h1><p>+70</p><p>+40</p><h2>+4</h2><p>+120</p><p>+5</p><p>+25</p><p>+16 [3]</p><p>+60</p><li>[1]</li><li>[1]</li>",
    "<li>[1]</li><li>[2]</li><p>3</p><li>[3]</li><h1>+9</h1><p>+45</p><p>+8</p><p>+50</p><p>+2</p><p>+30</p><p>+19</p>",
    "<p>[2]</p><div>+30</div><div>+13</div><div>+60</div><p>+14</p><li>[12]</li><li>[6]</li><p>6</p><li>[2]</li>",
    "<h2>4</h2><li>[2]</li><li>[2]</li><div>+55</div><div>+35</div><p>25 [18]</p><p>20 [16]</p><p>5 [4]</p>",
    "<div class=ad>30</div><p>+60</p><div class=ad>5</div><p>+30</p><div class=comments>120</div><div class=banner>35</div><div class=search>14</div>",
)


def page_of(pattern: str) -> tuple[str, list[bool]]:
    """A page of the table as HTML, and the label of each of its blocks."""
    wanted: list[bool] = []

    def block(m: re.Match) -> str:
        wanted.append(m["main"] == "+")
        plain, linked = (int(m[n] or 0) for n in ("plain", "linked"))
        return f">{'w ' * (plain - linked if m['linked'] and m['plain'] else plain)}{'<a>' + 'w ' * linked + '</a>' if linked else ''}<"

    return re.sub(r">(?P<main>\+?)(?P<plain>\d+)? ?(?:\[(?P<linked>\d+)\])?<", lambda m: block(m) if m["plain"] or m["linked"] else m[0], pattern), wanted


def labelled() -> np.ndarray:
    """Features and label of every block of the table's pages."""
    rows = []
    for pattern in PAGES:
        source, wanted = page_of(pattern)
        found = blocks(source)
        if len(found) != len(wanted):
            raise ValueError(f"{len(found)} blocks for {len(wanted)} labels: {pattern}")
        rows.append(np.column_stack([features(found), wanted]))
    return np.vstack(rows)


class Tree:
    """A classification tree: splits by least Gini impurity until leaves are pure or ``depth`` is reached."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 8):
        self.value, self.split = float(y.mean()), None
        if depth == 0 or y.min() == y.max():
            return
        best = None
        for f in range(x.shape[1]):
            steps = np.unique(x[:, f])
            for cut in (steps[1:] + steps[:-1]) / 2:
                left = x[:, f] <= cut
                impurity = sum(len(p) * p.mean() * (1 - p.mean()) for p in (y[left], y[~left]))
                if best is None or impurity < best[0] - 1e-12:
                    best = (impurity, f, cut)
        if best is None:
            return
        _, f, cut = best
        left = x[:, f] <= cut
        self.split = (f, cut, Tree(x[left], y[left], depth - 1), Tree(x[~left], y[~left], depth - 1))

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.split is None:
            return np.full(len(x), self.value)
        f, cut, low, high = self.split
        out, left = np.empty(len(x)), x[:, f] <= cut
        out[left], out[~left] = low.predict(x[left]), high.predict(x[~left])
        return out


@functools.lru_cache(maxsize=1)
def trained() -> Tree:
    """A tree of the table's blocks and, for each main text, its twins in an aside and, from an article, beside it."""
    rows = labelled()
    main = rows[rows[:, -1] == 1]
    aside, beside = main.copy(), main[main[:, 6] == 1].copy()
    aside[:, 7], beside[:, 6] = 1, 0
    aside[:, -1], beside[:, -1] = 0, 0
    rows = np.vstack([rows, aside, beside])
    return Tree(rows[:, :-1], rows[:, -1])


def main_text(source: str | None, tree: Tree) -> str:
    """The kept blocks; if the tree keeps none of a page without an article, all that are mostly no links, outside asides."""
    found = blocks(source or "")
    if not found:
        return ""
    keep = tree.predict(features(found)) >= 0.5
    if not keep.any() and not any(b.main for b in found):
        keep = [not b.aside and b.density < 0.5 for b in found]
    return "\n".join(b.text for b, k in zip(found, keep) if k)


def extract_text(pages: DataFrame, column: str = "html", out: str = "text", tree: Tree | None = None) -> DataFrame:
    """Adds ``out``, the main text of ``column``, to every row; a column of that name is replaced.

    Null and empty pages, and pages without main text, give the empty text. Rows that repeat give equal results.
    """
    tree = tree or trained()
    pages = pages.drop(out) if out != column else pages
    schema = T.StructType([*pages.schema.fields, T.StructField(out, T.StringType())] if out != column else pages.schema.fields)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            pdf[out] = [main_text(h, tree) for h in pdf[column]]
            yield pdf

    return pages.mapInPandas(run, schema)


def op6_html(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_text(pages).selectExpr("page_id", "url", "text", "cast(length(text) as long) as n_chars")
