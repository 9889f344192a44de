"""Operator 4: the main text of HTML pages, as the maximum-scoring run of their tokens.

A page is a sequence of words and tags. Words score above zero and tags below, each by its kind, with weights counted
on labelled pages; one scan finds the contiguous run of the largest sum, and the blocks that it touches are the text.
Elements that are never part of an article (scripts, menus, forms, and containers whose whole class or id says so) are
cut out of the sequence and leave only their tags' scores; all else is left to the scan.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.shared import table

#: Fixed sets of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style textarea title xmp".split())
NEVER = frozenset("head script style noscript template svg canvas iframe object nav footer aside form button select textarea dialog menu title".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Containers that class, id or role can name as something beside the text; no heading, paragraph or inline element is.
BOX = frozenset("div section ul ol dl table".split())
#: A class or an id tells only if all its words do ("share-buttons", not "share-price"): one of these and words of PART.
ASIDE = frozenset("ad ads advert adverts advertisement promo sponsor sponsored cookie cookies consent gdpr newsletter subscribe signup share sharing social comment comments disqus sidebar navbar breadcrumb breadcrumbs pagination pager".split())
#: Those that tell only outside of an article, where they can also be names of its own blocks.
ELSEWHERE = frozenset("banner notice notices alert popup modal overlay login reply replies responses related recommend recommended recommendations side rail menu nav navigation footer header masthead topbar copyright widget toolbar tags search".split())
PART = frozenset("area bar block bottom box button buttons container form global group icons inner left links list main outer page panel post posts right section site slot thread top unit wrap wrapper".split())
ROLES = frozenset("navigation search banner menu menubar toolbar dialog alertdialog".split())
_TAG = re.compile(r"<!--|<[!?]|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile(r"[>\"']")
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_NAMED = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SPACE = re.compile(r"\s+")


def beside(name: str, attributes: str, article: bool) -> bool:
    """Whether a container's class, id or role names it as something beside the text."""
    if name not in BOX:
        return False
    for kind, *value in _NAMED.findall(attributes):
        for called in "".join(value).lower().split():
            words = {*re.split("[_-]+", called)} - {""}
            if kind.lower() == "role":
                if called in ROLES:
                    return True
            elif words <= ASIDE | ELSEWHERE | PART and words & (ASIDE if article else ASIDE | ELSEWHERE):
                return True
    return False


def read(page: str) -> list[tuple[str, str, int]]:
    """The tokens of a page; kinds of words end in "+" where an eighth or more of their block's words are in links."""
    found, words, links = [*tokens(page)], Counter(), Counter()
    for kind, text, block in found:
        if kind[0] == "w" and (n := len(text.split())):
            words[block] += n
            links[block] += n * (kind == "w:a")
    return [(f"{kind}+" if kind[0] == "w" and links[block] * 8 >= words[block] > 0 else kind, text, block) for kind, text, block in found]


class Stack:
    """Open elements, with counts of names, so that what a tag asks for takes the same time at any depth."""

    def __init__(self) -> None:
        self.open: list[tuple[str, bool]] = []
        self.count, self.blocks, self.hidden = Counter(), [], 0

    def push(self, name: str, cut: bool) -> None:
        self.open.append((name, cut))
        self.count[name] += 1
        self.hidden += cut
        if name not in INLINE:
            self.blocks.append(name)

    def close(self, name: str) -> None:
        """Ends the innermost element of that name, if any, and all that it holds."""
        while self.count[name]:
            n, cut = self.open.pop()
            self.count[n] -= 1
            self.hidden -= cut
            if n not in INLINE:
                self.blocks.pop()
            if n == name:
                return


def tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(begin, end, closing, name, attributes) of every tag in order; comments and declarations have no name, elements of
    raw text end behind it. A quoted value ends at the next quote of its kind; where none follows in the page the quote
    stands for itself."""
    at, open_ended = 0, set()
    while m := _TAG.search(page, at):
        begin, at = m.start(), m.end()
        if m[0] == "<!--":
            at = end + 3 if (end := page.find("-->", at)) >= 0 else len(page)
            yield begin, at, False, "", ""
            continue
        if not m[2]:
            at = end + 1 if (end := page.find(">", at)) >= 0 else len(page)
            yield begin, at, False, "", ""
            continue
        while True:
            stop = _STOP.search(page, at)
            at = stop.end() if stop else len(page)
            if not stop or stop[0] == ">":
                break
            if stop[0] not in open_ended:
                if (end := page.find(stop[0], at)) >= 0:
                    at = end + 1
                else:
                    open_ended.add(stop[0])
        name, attributes = m[2].lower(), page[m.end() : at]
        if name in RAW and not m[1]:
            at = close.end() if (close := _CLOSE[name].search(page, at)) else len(page)
        yield begin, at, bool(m[1]), name, attributes


def tokens(page: str) -> Iterator[tuple[str, str, int]]:
    """(kind, text, block) in page order: tags as "t:name", stretches of text as "w:" and the innermost block's name
    ("w:a" inside links). block numbers the blocks of text; text inside cut-out elements is left out. Time grows with
    the page's length, whatever its nesting."""
    stack, block, at = Stack(), 0, 0
    for begin, end, closing, name, attributes in tags(page):
        if begin > at and not stack.hidden:
            yield ("w:a" if stack.count["a"] else f"w:{stack.blocks[-1] if stack.blocks else ''}"), html.unescape(page[at:begin]), block
        at = end
        if not name:
            continue
        if name not in INLINE:
            block += 1
        elif name == "br" and not stack.hidden:
            yield "w:", " ", block
        if closing:
            stack.close(name)
            if not stack.hidden:
                yield f"t:{name}", "", block
            continue
        if name in CLOSES_P:
            stack.close("p")
        article = bool(stack.count["article"] or stack.count["main"])
        cut = name in NEVER or name == "header" and not article or beside(name, attributes, article)
        if not stack.hidden or cut:
            yield ("t:cut" if cut else f"t:{name}"), "", block
        if name not in VOID and name not in RAW and not attributes.endswith("/>"):
            stack.push(name, cut)
    if at < len(page) and not stack.hidden:
        yield ("w:a" if stack.count["a"] else f"w:{stack.blocks[-1] if stack.blocks else ''}"), html.unescape(page[at:]), block


def fit(labelled: Iterable[tuple[str, str]], smooth: float = 1.0, scales: tuple[float, ...] = (0.5, 1, 1.5, 2, 3, 4, 6)) -> dict[str, float]:
    """Weights of token kinds from (page, main text) pairs: words score the log odds of their kind being main text, at
    least 0.1; tags score minus the log of one plus their odds of standing elsewhere, at least 0.02 below zero, times
    the scale that gives the most of the pairs' words back with the fewest others."""
    labelled = [*labelled]
    inside, outside = Counter(), Counter()
    for page, text in labelled:
        known = {_SPACE.sub(" ", b).strip() for b in text.split("\n\n")}
        found = read(page)
        body: dict[int, str] = {}
        for kind, words, block in found:
            if kind[0] == "w":
                body[block] = body.get(block, "") + words
        good = {b for b, t in body.items() if _SPACE.sub(" ", t).strip() in known}
        span = (min(good), max(good)) if good else (0, -1)
        for kind, words, block in found:
            n = len(words.split()) if kind[0] == "w" else 1
            (inside if block in good or kind[0] == "t" and span[0] <= block <= span[1] else outside)[kind] += n
    odds = {k: (inside[k] + smooth) / (outside[k] + smooth) for k in {*inside, *outside}}
    weights = [{k: max(0.1, math.log(o)) if k[0] == "w" else -scale * max(0.02, math.log1p(1 / o)) for k, o in odds.items()} for scale in scales]
    return max(weights, key=lambda w: agreement((main_text(page, w), text) for page, text in labelled))


def agreement(pairs: Iterable[tuple[str, str]]) -> float:
    """The F score of the words of found texts against those of true ones."""
    both = found = true = 0
    for a, b in pairs:
        x, y = Counter(a.split()), Counter(b.split())
        both, found, true = both + (x & y).total(), found + x.total(), true + y.total()
    return 2 * both / max(found + true, 1)


#: Layouts of the labelled pages: where the article stands, and how its blocks are written.
BOXES = ["article", "main", "section", 'div id="content"', 'div class="c7"']
STYLES = ["p", "div", "sections", "lists", "quotes", "cells"]


def labelled_pages(pages: int = 120, seed: int = 1, boxes: list[str] = BOXES, styles: list[str] = STYLES) -> list[tuple[str, str]]:
    """Small labelled pages, drawn by seed: articles of the given boxes and styles with headings, inline marks and a few
    links, some blocks of a word or two, among menus, lines of links, teasers with a sentence, bylines, facts in tables and closing lines."""
    rng, out = random.Random(seed), []
    for k in range(pages):
        box, style = boxes[k % len(boxes)], styles[k // len(boxes) % len(styles)]
        line = lambda a, b: " ".join(f"w{rng.randrange(10**9):x}" for _ in range(rng.randint(a, b)))
        blocks: list[str] = []

        def block(tag: str, a: int, b: int, blocks: list[str] = blocks, line=line) -> str:
            blocks.append((line(a, b) if rng.random() < 0.8 else line(1, 2)) + ".")
            words = blocks[-1].split()
            if len(words) > 8 and rng.random() < 0.4:
                at, mark = rng.randrange(len(words)), rng.choice(["b", "em", "code", "a href=/x"])
                words[at] = f"<{mark}>{words[at]}</{mark.split()[0]}>"
            return f"<{tag}>{' '.join(words)}</{tag}>"

        body = block("h1", 3, 9)
        for _ in range(rng.randint(2, 7)):
            if style == "sections":
                body += block("h2", 2, 6) + block("p", 10, 60) + block("p", 10, 60)
            elif style == "lists":
                body += block("p", 8, 40) + "<ul>" + "".join(block("li", 4, 25) for _ in range(rng.randint(2, 5))) + "</ul>"
            elif style == "quotes":
                body += block("p", 8, 50) + block("blockquote", 8, 40) + block("pre", 4, 20)
            elif style == "cells":
                body += block("p", 8, 50) + "<table>" + "".join("<tr>" + block("th", 1, 3) + block("td", 2, 12) + "</tr>" for _ in range(rng.randint(1, 4))) + "</table>"
            else:
                body += block(style, 10, 70)
        link = lambda: f'<a href="/{rng.randrange(99)}">{line(1, 3)}</a>'
        menu = "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(3, 12))) + "</ul>"
        teasers = lambda: "".join(f"<div><h3>{link()}</h3>{f'<p>{line(4, 12)}</p>' if rng.random() < 0.3 else line(4, 12)}{link()}</div>" for _ in range(rng.randint(0, 3)))
        crumbs = f"<div>{' &gt; '.join(link() for _ in range(rng.randint(2, 4)))}</div>"
        facts = "<table>" + "".join(f"<tr><td>{link()}</td><td>{line(1, 2)}</td></tr>" for _ in range(rng.randint(0, 3))) + "</table>"
        page = f"<html><body><div>{menu}</div>{crumbs}{teasers()}<{box}>{body}</{box.split()[0]}><div><span>{line(1, 4)}</span> {link()}</div>{facts}{teasers()}<div>{menu}</div><div>{line(2, 8)} {link()}</div></body></html>"
        out.append((page, "\n\n".join(blocks)))
    return out


def main_text(page: str, weights: dict[str, float]) -> str:
    """The blocks of the best run of tokens, joined by an empty line; white space in a block is one space."""
    found = read(page)
    best = total = 0.0
    start, span = 0, (0, 0)
    for i, (kind, words, _) in enumerate(found):
        total += weights.get(kind, 0.5) * len(words.split()) if kind[0] == "w" else weights.get(kind, -0.3)
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, span = total, (start, i + 1)
    blocks: dict[int, list[str]] = {}
    wanted = {b for kind, words, b in found[slice(*span)] if kind[0] == "w" and words.strip()}
    for kind, words, block in found:
        if kind[0] == "w" and block in wanted:
            blocks.setdefault(block, []).append(words)
    texts = (_SPACE.sub(" ", "".join(x)).strip() for x in blocks.values())
    return "\n\n".join(t for t in texts if t)


def extract(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points of text) of every row of pages (page_id, url, html; other columns
    are not read). Null or empty html, and pages without words, give the empty text. Every page is read whole, and each
    row by itself, so repeated rows repeat. weights: from fit(); by default those of labelled_pages()."""
    known = weights or fit(labelled_pages())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h, known) if h else "" for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    picked = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return picked.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def main_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op4_main_text": main_texts}
SQL: dict[str, str] = {}
