"""Main-text extraction as a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score by the elements around
them, tags by their name, with weights fitted on labelled pages as log odds of
lying inside the article; one linear scan finds the best contiguous region, and
blocks inside it whose own score is negative (an advert between paragraphs) go.
The innermost elements with evidence decide, and a block that goes costs the
region around it little, so the article goes on behind it.
"""

from __future__ import annotations

import html as _html
import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
CLASSES = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: Elements that both articles and their surroundings are made of; they are no evidence about their words.
GENERIC = INLINE | {"html", "body", "div", "section", "p", "ul", "ol", "li", "dl", "dt", "dd", "table", "tbody", "thead", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figure", "figcaption"}
CLOSED_BY = {"p": {"p", "div", "ul", "ol", "article", "section", "h1", "h2", "h3", "h4", "h5", "h6", "table", "blockquote", "pre", "form", "footer", "header", "nav", "aside", "main"}, "li": {"li"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}

#: A class or id of several words with one of these tells the state of a page or of its layout, not what an element holds.
STATE = {"has", "no", "not", "non", "with", "without", "is", "hide", "hidden", "show", "enabled", "disabled", "enable", "disable", "on", "off", "open", "closed", "left", "right", "active", "layout", "page", "template", "theme"}
#: Elements and words whose blocks have bodies and contents of their own, which are no article unless an element says so.
FIRM = {"nav", "aside", "footer", "comments", "comment", "replies", "discussion", "respond"}
#: What a text stands in within its container.
TEXT_LEVEL = INLINE | {"p", "ul", "ol", "li", "dl", "dt", "dd", "table", "tbody", "thead", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figure", "figcaption"}


#: Elements that mean one thing for a page and another inside its article (a heading's header, a list of its tags).
SECTIONS = {"header", "footer", "aside", "nav", "form"}


class Open:
    """An open element: its features, what lies around it, and what its weights made of it."""

    __slots__ = ("box", "inside", "link", "name", "own", "parent", "told")

    def __init__(self, name: str, own: tuple[str, ...], parent: Open | None):
        self.name, self.own, self.parent = name, own, parent
        self.link = name == "a" or (parent is not None and parent.link)
        #: within an element that is the page's article or main part by its name
        self.inside = name in ("article", "main") or (parent is not None and parent.inside)
        #: the innermost element around that is more than a text's own
        self.box = self if parent is None or name not in TEXT_LEVEL else parent.box
        #: evidence of the innermost elements that have any, the outermost element of a negative block, whether it is firm
        self.told: tuple[float, Open | None, bool] | None = (0.0, None, False) if parent is None else None

    def all(self) -> set[str]:
        """The features of all elements around its content."""
        return {*self.own, *(self.parent.all() if self.parent else ())}


Piece = tuple[int, str, Open, int]


def features(name: str, attributes: str, inside: bool) -> tuple[str, ...]:
    """The element's name and the words of its class, id and role; those of the page's own elements say nothing.

    A section's name also tells whether it stands inside the article.
    """
    found = {f"{name} inside" if inside and name in SECTIONS else name}
    for x in CLASSES.findall(attributes) if name not in ("html", "body") else ():
        for token in x.lower().split():
            words = re.findall(r"[a-z]+", token)
            if len(words) == 1 or STATE.isdisjoint(words):
                found.update(words)
    return tuple(sorted(found))


class Tags:
    """The tags of a page in order, found in one pass: no character is looked at more than a few times.

    A ``>`` in a quoted attribute ends no tag. Where quotes never close, the
    first ``>`` ends the tag, there and from there on.
    """

    def __init__(self, page: str):
        self.page, self.quotes = page, True
        self.last = {q: page.rfind(q) for q in "\"'"}

    def end(self, at: int) -> int:
        """Place of the ``>`` of the tag that began before ``at``, -1 if it has none."""
        page, k = self.page, at
        while self.quotes:
            close = page.find(">", k)
            if close < 0:
                break
            mark = min((x for x in (page.find(q, k, close) for q in "\"'") if x >= 0), default=-1)
            if mark < 0:
                return close
            if self.last[page[mark]] <= mark:
                k = mark + 1  # it never closes
                continue
            k = page.find(page[mark], mark + 1) + 1
        self.quotes = False
        return page.find(">", at)

    def __iter__(self) -> Iterator[tuple[int, int, str, str]]:
        """``start, stop, name, attributes``; a closing name begins with a slash, comments and declarations have none."""
        page, at = self.page, 0
        while (start := page.find("<", at)) >= 0:
            if page.startswith("<!--", start):
                stop = page.find("-->", start + 4)
                at = len(page) if stop < 0 else stop + 3
                yield start, at, "", ""
                continue
            slash = page.startswith("/", start + 1)
            named = NAME.match(page, start + 1 + slash)
            if not named and not page.startswith(("!", "?"), start + 1):
                at = start + 1
                continue
            stop = self.end(named.end()) if named else page.find(">", start)
            if stop < 0:
                if page.find(">", start) < 0:
                    return
                at = start + 1
                continue
            at = stop + 1
            name = named.group().lower() if named else ""
            yield start, at, "/" * slash + name, page[named.end() : stop] if named else ""
            if name in RAW and not slash:
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = close.end() if close else len(page)
                yield at, at, "", ""


def pieces(page: str) -> Iterator[Piece]:
    """``(kind, value, innermost open element, block)`` in page order; kind 0 is text, 1 a tag."""
    stack: list[Open] = []
    opened: Counter = Counter()
    around = root = Open("", (), None)
    at = block = 0
    raw = False

    def close(depth: int) -> None:
        for e in stack[depth:]:
            opened[e.name] -= 1
        del stack[depth:]

    for start, stop, tag, attributes in Tags(page):
        if start > at and not raw:
            yield 0, page[at:start], around, block
        at, raw = stop, False
        name = tag.removeprefix("/")
        if not name:
            continue
        if name not in INLINE:
            block += 1
        if tag.startswith("/"):
            if opened[name]:
                depth = len(stack) - 1
                while stack[depth].name != name:
                    depth -= 1
                close(depth)
                around = stack[-1] if stack else root
            yield 1, name, around, block
            continue
        while stack and name in CLOSED_BY.get(stack[-1].name, ()):
            close(len(stack) - 1)
        around = stack[-1] if stack else root
        yield 1, name, around, block
        if name in RAW:
            raw = True
        elif name not in VOID and not attributes.rstrip().endswith("/"):
            around = Open(name, features(name, attributes, around.inside), around)
            opened[name] += 1
            stack.append(around)
    if at < len(page) and not raw:
        yield 0, page[at:], around, block


def labelled_pages(n: int = 400, seed: int = 11) -> Iterator[list[tuple[Piece, bool]]]:
    """Made-up pages in several layouts whose article is known by how they are made."""
    rng = random.Random(seed)
    words = lambda a, b: " ".join(rng.choice(("lorem", "dolor", "amet", "elit", "tempor", "magna", "quis", "aute")) for _ in range(rng.randint(a, b)))
    links = lambda: "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(rng.randint(3, 12)))
    side = ("sidebar", "related", "widget", "recommended", "tags", "social", "share", "rail", "trending", "popular", "recirculation", "breadcrumbs", "pagination")
    note = ("cookie", "notice", "banner", "consent", "newsletter", "popup", "subscribe", "alert", "promo", "gdpr", "modal", "overlay", "paywall", "signup")
    talk = ("comments", "comment", "replies", "discussion", "respond", "disqus thread", "responses", "reactions", "feedback")
    for _ in range(n):
        box = rng.choice((("article", ""), ("main", ""), ("div", "content"), ("div", "article body"), ("div", "post entry"), ("section", "story")))
        head = [f"<header class='header masthead'>{words(1, 6)}</header>", f"<nav class='menu navbar'><ul>{links()}</ul></nav>", f"<div class='{rng.choice(note)}'>{words(3, 25)}</div>", f"<div class='ad advert sponsored'>{words(3, 25)}</div>", f"<div id='menu' class='breadcrumb'>{links()}</div>"]
        tail = [f"<aside class='{rng.choice(side)}'><h3>{words(1, 3)}</h3><ul>{links()}</ul><p>{words(5, 30)}</p></aside>", f"<div class='{rng.choice(talk)}'><h3>{words(1, 2)}</h3><div class='comment'><p>{words(5, 60)}</p></div></div>", f"<form class='form search login'><label>{words(1, 3)}</label><button>{words(1, 2)}</button></form>", f"<footer class='footer copyright'><p>{words(5, 30)}</p></footer>", f"<footer><p>{words(5, 30)}</p></footer>", f"<section id='{rng.choice(talk)}'><p>{words(5, 60)}</p></section>", f"<div class='{rng.choice(side)}'><ul>{links()}</ul></div>"]
        named = box[0] in ("article", "main")  # such an element has headers and footers of its own
        top = rng.random() if named else 1.0
        title = f"<h1>{words(3, 10)}</h1>"
        title = f"<header>{title}<p>{words(4, 20)}</p></header>" if top < 0.3 else f"<header class='entry header'>{title}</header>" if top < 0.4 else title
        body = title + "".join(rng.choice((f"<p>{words(15, 90)}</p>", f"<p>{words(20, 80)}<b>{words(1, 3)}</b> {words(5, 20)}<a>{words(1, 3)}</a></p>", f"<h2>{words(2, 6)}</h2><p>{words(20, 60)}</p>", f"<ul><li>{words(5, 20)}</li><li>{words(5, 20)}</li></ul>", f"<blockquote>{words(8, 40)}</blockquote>", f"<table><tr><td>{words(1, 4)}</td></tr></table>", f"<pre>{words(8, 30)}</pre>")) for _ in range(rng.randint(3, 12)))
        before = rng.choice(("", "", f"<nav><ul>{links()}</ul></nav>", f"<form>{words(1, 4)}</form>")) if named else ""
        after = rng.choice(("", f"<footer><p>{words(3, 20)}</p></footer>", f"<aside><h3>{words(1, 3)}</h3><p>{words(5, 30)}</p></aside>", f"<nav><ul>{links()}</ul></nav>", f"<form><label>{words(1, 3)}</label></form>")) if named else ""
        rng.shuffle(head)
        rng.shuffle(tail)
        top = "".join(x for x in head if rng.random() < 0.7)
        low = "".join(x for x in tail if rng.random() < 0.7)
        page = f"<html><head><title>{words(2, 6)}</title></head><body>{top}<{box[0]} class='{box[1]}'>{before}\x01{body}\x02{after}</{box[0]}>{low}</body></html>"
        inside, out = False, []
        for p in pieces(page):
            if p[0] == 0:
                inside = inside or "\x01" in p[1]
            out.append((p, inside))
            if p[0] == 0 and "\x02" in p[1]:
                inside = False
        yield out


class Weights:
    """Log odds of being article: of a word by the elements around it, of a tag by its name."""

    def __init__(self, pages: Iterable[list[tuple[Piece, bool]]]):
        seen: dict[bool, Counter] = {True: Counter(), False: Counter()}
        total: Counter = Counter()
        tags: dict[bool, Counter] = {True: Counter(), False: Counter()}
        for page in pages:
            for (kind, value, around, _), inside in page:
                if kind:
                    tags[inside][value] += 1
                    continue
                n = len(value.split())
                total[inside] += n
                for f in around.all():
                    seen[inside][f] += n
        odds = lambda a, b, na, nb: math.log((a + 1) / (na + 2)) - math.log((b + 1) / (nb + 2))
        self.near = {f: max(-2.0, min(3.0, odds(seen[True][f], seen[False][f], total[True], total[False]))) for f in {*seen[True], *seen[False]} - GENERIC}
        self.word = 0.5
        self.tag = {t: min(-0.05, 0.1 * max(-4.0, min(0.0, odds(tags[True][t], tags[False][t], sum(tags[True].values()), sum(tags[False].values()))))) for t in {*tags[True], *tags[False]}}

    def told(self, around: Open) -> tuple[float, Open | None, bool]:
        """Evidence of the innermost elements that have any, with the outermost element of a negative block."""
        chain, el = [], around
        while el.told is None:
            chain.append(el)
            el = el.parent
        for e in reversed(chain):
            up, block, firm = e.parent.told
            own = [self.near.get(f, 0.0) for f in e.own]
            worst, best = min(own), max(own)
            if e.name == "main" and best > 0.5:
                worst = 0.0  # a page has one, whatever its layout
            if worst < -1.0:
                e.told = (min(worst, up), block or e, firm or not FIRM.isdisjoint(e.own))
            elif block is None:
                e.told = (max(up, best), None, False)
            elif best > 0.5 and (not firm or e.name in ("article", "main")):
                e.told = (best, None, False)
            else:
                e.told = e.parent.told
        return around.told

    def of_word(self, around: Open) -> float:
        best, block, _ = self.told(around)
        if block is not None:
            return best
        link = (0.2 if best > 0.5 else 1.0) if around.link else 0.0
        return self.word + max(0.0, best) * 0.5 - link

    def of_tag(self, name: str) -> float:
        return self.tag.get(name, -0.05)


#: The most that a block which is removed within the article's container takes from the region around it, in the scan.
REMOVABLE = 0.5

_fitted: Weights | None = None


def fitted() -> Weights:
    """The weights, fitted once a process on the made-up labelled pages."""
    global _fitted  # noqa: PLW0603
    if _fitted is None:
        _fitted = Weights(labelled_pages())
    return _fitted


def best_region(scores: list[float]) -> tuple[int, int]:
    """Ends of the contiguous run of greatest sum, the first of equals; empty if no sum is above zero. One linear scan."""
    best, total, start, region = 0.0, 0.0, 0, (0, 0)
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, region = total, (start, i + 1)
    return region


def main_text(page: str, weights: Weights) -> str:
    """The best region's blocks, white space turned into one space, joined by two line feeds."""
    runs: list[tuple[float, str | None, int]] = []
    #: What each run costs in the scan, where a block that goes anyway has a bounded price.
    scan: list[float] = []
    box, paid, own = None, None, 0.0  # of the last article text; the block being paid for
    for kind, value, around, block in pieces(page):
        worth, bad, _ = weights.told(around)
        if kind:
            score, text = weights.of_tag(value), " " if value == "br" else None
        else:
            score, text = (weights.of_word(around) * len(value.split()) if value.strip() else 0.0), value
        runs.append((score, text, block))
        if bad is None and (kind or score >= 0):
            scan.append(score)
            box = around.box if not kind and score > 0 else box
            continue
        key = bad or block
        inside = bad.parent if bad else around
        if key is not paid:
            paid, own = key, 0.0
        if score < 0 and (weights.told(inside)[0] > 0.5 or box is inside.box):
            score = max(score, -REMOVABLE - own)
            own += score
        scan.append(score)
    blocks: dict[int, list] = {}
    for score, text, block in runs[slice(*best_region(scan))]:
        if text is not None:
            got = blocks.setdefault(block, [0.0, []])
            got[0] += score if text.strip() else 0.0
            got[1].append(text)
    kept = (" ".join(_html.unescape("".join(t)).split()) for s, t in blocks.values() if s > 0)
    return "\n\n".join(x for x in kept if x)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """``id_col, *keep, text, n_chars`` of every page.

    Null and empty pages give the empty text, as do pages without a region
    that scores above zero. Repeated rows and null ids are kept as rows; other
    columns are ignored, whatever their names. No page is cut, whatever its
    length; an empty table gives an empty result.
    """
    kept = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    light = pages.select(F.col(id_col).alias("id"), *kept, F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    types = {f.name: f.dataType.simpleString() for f in light.schema}
    schema = ", ".join(f"{c} {types[c]}" for c in light.columns if c != "html") + ", text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = fitted()
        for batch in batches:
            texts = [main_text(x.as_py(), weights) for x in batch.column("html")]
            rest = [batch.column(c) for c in batch.schema.names if c != "html"]
            names = [c for c in batch.schema.names if c != "html"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [*names, "text", "n_chars"])

    out = light.mapInArrow(run, schema)
    return out.select(F.col("id").alias(id_col), *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "text", "n_chars")
