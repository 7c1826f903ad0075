"""HTML extraction by two-pass block rules."""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from rasterlab.llm import kernels as K

# Fixed values. Common function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which with you "
    "als am auch auf aus bei das dem den der des die ein eine einer es für ich im ist mit nicht noch sich sie sind und von war wie zu zum zur "
    "au aux avec ce dans de du elle en est et il je la le les leur mais ne nous ou par pas plus pour que qui sa se son sur un une vous "
    "al como con del el ella esta este ha las lo los más muy no o para pero por sin su sus también y ya".split()
)
# Fixed values. Elements that end a block of text; that hold no text for readers; that have no end tag.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style noscript template textarea title iframe object svg math canvas audio video".split())
#: Of these, what hides the rest of the page where its end is missing; the others are passed over then.
TO_THE_END = frozenset("script style noscript textarea title iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Fixed values. Elements, roles and name parts of class and id that mark what isn't the article.
OUTSIDE = frozenset("nav aside footer menu button select dialog head".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies copyright disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pagination paywall popup promo promoted promotion related share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar widget".split()
)
COMMENTS = frozenset("comment comments disqus".split())
#: Characters from which a block is judged by its stop words, and from which it is a good anchor for others.
SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH, MAX_LINKS = 0.10, 0.20, 0.5

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_QUOTE_OR_END = re.compile("[\"'>]")
_ATTRIBUTE = re.compile(r"(?<![a-zA-Z-])([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")  # of sideBar: side, Bar; the whole is looked up too
_WORD = re.compile(r"[^\W\d_]+")
_WIDE = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff]")  # scripts that say a word in a sign or two, mostly without spaces


def _marked(tag: str, attributes: str, in_article: bool) -> str:
    """How an element says that it holds what isn't the article: ``hard`` by its kind or as it isn't shown, ``name`` by a
    whole name or role, ``part`` by a part of a name (or as a form), ``comment part`` by a part about comments; else empty."""
    if tag in OUTSIDE or (tag == "header" and not in_article):
        return "hard"
    how = "part" if tag == "form" else ""
    if "=" not in attributes and "hidden" not in attributes:
        return how
    page = tag in ("html", "body")
    if not page and re.search(r"(?:^|\s)hidden(?:\s|$)", re.sub(r"=\s*(\"[^\"]*\"|'[^']*')", "", attributes)):
        return "hard"
    for name, *values in _ATTRIBUTE.findall(attributes):
        value, name = next((v for v in values if v), ""), name.lower()
        if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
            parts = NAMES.intersection(x.lower() for x in [*_NAME_PART.findall(value), *re.findall("[A-Za-z]+", value)])
            if not COMMENTS.isdisjoint(parts):
                how = "comment part" if how != "name" else how
            elif parts:
                how = how or "part"
            if parts and not NAMES.isdisjoint(value.lower().split()):
                how = "name"
        elif name == "role" and value.lower() in ROLES:
            how = "name"
        elif not page and (name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            return "hard"
    return how


class _Tokens:
    """The tokens of a page in one forward pass: ``(kind, name, attributes)`` with kind text, data, open or close.

    The end of a tag is the first ``>`` outside quotes, or, where no such end follows, the first ``>`` at all. Openings
    of quotes from which no end is reached are remembered, so that no stretch is searched twice in vain. Where no
    ``>`` follows, the rest is text. ``at`` may be moved ahead by the caller.
    """

    def __init__(self, html: str):
        self.html, self.at, self.last = html, 0, html.rfind(">")
        self.vain: set[int] = set()

    def _tag_end(self, at: int) -> int:
        opened, place = [], at
        while m := _QUOTE_OR_END.search(self.html, place):
            if m[0] == ">":
                return m.start()
            close = -1 if m.start() in self.vain else self.html.find(m[0], m.end())
            opened.append(m.start())
            if close < 0:
                break
            place = close + 1
        self.vain.update(opened)
        return self.html.find(">", at)

    def __iter__(self):
        html = self.html
        while self.at < len(html):
            sign = html.find("<", self.at) if self.at <= self.last else -1
            while 0 <= sign < self.last and not (html[sign + 1] in "!?" or _NAME.match(html, sign + 1) or html[sign + 1] == "/" and _NAME.match(html, sign + 2)):
                sign = html.find("<", sign + 1)
            if not 0 <= sign < self.last:
                # an open comment hides the rest even without an end
                sign = html.find("<!--", self.at)
                yield "text", html[self.at : sign if sign >= 0 else len(html)], ""
                self.at = len(html)
                return
            if sign > self.at:
                yield "text", html[self.at : sign], ""
            for mark, end in (("<!--", "-->"), ("<![CDATA[", "]]>")):
                if html.startswith(mark, sign):
                    stop = html.find(end, sign + len(mark))
                    self.at = stop + len(end) if stop >= 0 else len(html)
                    if mark != "<!--":
                        yield "data", html[sign + len(mark) : stop if stop >= 0 else len(html)], ""
                    break
            else:
                if html[sign + 1] in "!?":
                    self.at = html.find(">", sign) + 1
                    continue
                closing = html[sign + 1] == "/"
                name = _NAME.match(html, sign + 1 + closing)
                stop = self._tag_end(name.end())
                self.at = stop + 1
                yield "close" if closing else "open", name[0].lower(), html[name.end() : stop]


NONE, HARD = -1, -2


class _Open:
    """The open elements, with the places of each tag among them, so that no look-up walks over all."""

    def __init__(self):
        self.stack: list[tuple[str, int, int]] = []  # tag, mark, article: numbers from 0, NONE, or HARD
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, tag: str, mark: int, article: int) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, mark, article))

    def pop_to(self, place: int) -> None:
        """Close everything from ``place`` on."""
        while len(self.stack) > place:
            tag = self.stack.pop()[0]
            self.places[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()

    def last(self, *tags: str) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    @property
    def top(self) -> tuple[str, int, int]:
        return self.stack[-1] if self.stack else ("", NONE, NONE)


def blocks(html: str) -> list[tuple[str, int, bool, bool]]:
    """The blocks in page order: text, characters of it in links, whether marked as outside, whether in an article.

    A mark by kind always takes effect, one by name or role only where ``_effective`` says so."""
    out: list[tuple[str, int, int, int]] = []
    marks: list[tuple[str, int]] = []  # how, the mark that holds it
    articles: list[int] = []  # the mark that holds each outermost article
    heading = None  # that of the first main heading
    endless: set[str] = set()
    open_, tokens = _Open(), _Tokens(html)
    pieces: list[str] = []
    linked = breaks = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        if text:
            out.append((text, linked, *open_.top[1:]))
        pieces.clear()
        linked = 0

    for kind, tag, attributes in tokens:
        if kind == "data":
            pieces.append(tag)
            continue
        if kind == "text":
            text = unescape(tag) if "&" in tag else tag
            pieces.append(text)
            if not text.isspace():
                breaks = 0
                linked += len(" ".join(text.split())) if open_.places.get("a") else 0
            continue
        if tag == "br":
            breaks += 1
            if breaks > 1:
                flush()
            else:
                pieces.append(" ")
            continue
        if tag in BLOCKS:
            flush()
            breaks = 0
        if kind == "close":
            place = open_.last(tag)
            if place >= 0:
                above = open_.stack[place - 1][1] if place else NONE
                if any(x[1] != above for x in open_.stack[place:]):
                    flush()
                open_.pop_to(place)
            continue
        if tag in RAW:
            if not attributes.endswith("/") or tag in ("script", "style", "title", "textarea"):
                close = None if tag in endless else re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, tokens.at)
                stop = html.find(">", close.end()) if close else -1
                if stop >= 0:
                    tokens.at = stop + 1
                elif tag in TO_THE_END:
                    tokens.at = len(html)
                else:
                    endless.add(tag)
            continue
        if tag in VOID:
            continue
        if tag in BLOCKS and open_.top[0] == "p":
            open_.pop_to(len(open_.stack) - 1)
        if tag in ("li", "a", "option", "dt", "dd", "tr", "td", "th"):  # these end an open one of their kind
            place = open_.last(tag)
            if place > open_.last("ul", "ol", "dl", "table", "select", "menu"):
                open_.pop_to(place)
        elif tag == "p" and open_.blocks and open_.stack[open_.blocks[-1]][0] == "p":
            open_.pop_to(open_.blocks[-1])
        _, mark, article = open_.top
        how = "" if mark == HARD else _marked(tag, attributes, article != NONE)
        if how:
            flush()
            mark = HARD if how == "hard" else len(marks)
            if mark != HARD:
                marks.append((how, open_.top[1]))
        if article == NONE and (tag in ("article", "main") or 'role="main"' in attributes):
            article = len(articles)
            articles.append(mark)
        if tag == "h1" and heading is None and mark != HARD:
            heading = mark
        if not attributes.endswith("/"):
            open_.push(tag, mark, article)
    flush()
    effective = _effective(out, marks, articles, heading)
    return [(text, linked, mark == HARD or mark != NONE and effective[mark], article != NONE) for text, linked, mark, article in out]


def _effective(found: list[tuple[str, int, int, int]], marks: list[tuple[str, int]], articles: list[int], heading: int | None) -> list[bool]:
    """Which marks by name, role or form hold what isn't the article: the page's prose decides, as wrappers have such names too.

    The page's anchor is the article with the most prose, or, without articles, the first main heading. A mark has no
    effect if it holds more than half of the prose and the anchor; or, in a page without articles, more than half and
    only a part of its name speaks against it (not one about comments), or all prose. A mark within one that has effect
    has it too.
    """
    if not marks:
        return []
    held, in_articles, total = [0] * len(marks), [0] * len(articles), 0
    density = [_prose(x[0]) if x[2] != HARD else 0.0 for x in found]
    known = _spoken([(text, linked, mark == HARD, False) for text, linked, mark, _ in found], density)
    for (text, linked, mark, article), d in zip(found, density, strict=True):
        n = _length(text)
        if mark == HARD or n < SHORT or known and d < STOP_LOW or linked > MAX_LINKS * len(text):
            continue
        total += n
        if mark != NONE:
            held[mark] += n
        if article != NONE:
            in_articles[article] += n
    usable = [i for i, mark in enumerate(articles) if mark != HARD]
    anchor = articles[max(usable, key=lambda i: in_articles[i])] if usable else heading
    holds = [False] * len(marks)
    while anchor is not None and anchor >= 0:
        holds[anchor], anchor = True, marks[anchor][1]
    for i in reversed(range(len(marks))):  # a mark has a higher number than what holds it
        if marks[i][1] >= 0:
            held[marks[i][1]] += held[i]
    out: list[bool] = []
    for i, (how, above) in enumerate(marks):
        most = 2 * held[i] > total and (holds[i] or not usable and (how == "part" or held[i] == total))
        out.append(above >= 0 and out[above] or not most)
    return out


def _prose(text: str) -> float:
    """The share of stop words among the words."""
    words = [w.lower() for w in _WORD.findall(text)]
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def _length(text: str) -> int:
    """The characters, those of scripts that write a word in a sign or two counted threefold."""
    return len(text) + 2 * len(_WIDE.findall(text))


def _spoken(found: list[tuple[str, int, bool, bool]], density: list[float]) -> bool:
    """Whether the page is in a language of the stop words: a quarter of what could be prose, by length, has some."""
    could = [(_length(text), d >= STOP_LOW) for (text, linked, outside, _), d in zip(found, density, strict=True) if not outside and _length(text) >= SHORT and linked <= MAX_LINKS * len(text)]
    return 4 * sum(n for n, has in could if has) >= sum(n for n, _ in could)


def first_pass(found: list[tuple[str, int, bool, bool]]) -> tuple[list[bool | None], bool]:
    """What marks, link density, length and stop words decide of each block, else None; whether articles hold the text.

    Articles hold the page's text if their prose (blocks of SHORT characters with stop words and few links) is at
    least as long as what stands elsewhere. Then blocks elsewhere are bad, and inside, text with few links is only ever
    good or ambiguous, so that tables and lists stay. If not, an article is a teaser: its short blocks are bad, and
    its long ones are judged as those elsewhere, where long blocks without stop words are bad. In a page of a language
    that the stop words aren't of, long blocks with few links are prose by their length alone.
    """
    density = [_prose(x[0]) for x in found]
    if not _spoken(found, density):
        density = [STOP_HIGH] * len(found)
    prose = [0, 0]
    for (text, linked, outside, article), d in zip(found, density, strict=True):
        if not outside and _length(text) >= SHORT and d >= STOP_LOW and linked <= MAX_LINKS * len(text):
            prose[article] += _length(text)
    holds = prose[1] >= prose[0] and any(x[3] and not x[2] for x in found)
    labels: list[bool | None] = []
    for (text, linked, outside, article), d in zip(found, density, strict=True):
        n, trusted = _length(text), article and holds
        if outside or linked > MAX_LINKS * len(text) or holds and not article or article and not holds and n < SHORT:
            labels.append(False)
        elif "\N{COPYRIGHT SIGN}" in text and n <= LONG and not trusted:
            labels.append(False)
        elif n < SHORT:
            labels.append(False if linked and not trusted else None)
        elif d >= STOP_HIGH and n > LONG or d >= STOP_LOW and trusted:
            labels.append(True)
        elif d < STOP_LOW and not trusted:
            labels.append(False)
        else:
            labels.append(None)
    return labels, holds


def classify(found: list[tuple[str, int, bool, bool]]) -> list[bool]:
    """Which blocks are good. ``first_pass`` decides most; in the second pass the ambiguous ones inherit.

    An ambiguous block takes the label of its nearest decided neighbours among the blocks that aren't marked (inside
    the articles, if these hold the text, and without teasers, if not), good if the two differ at equal distance;
    without any, it is good.
    """
    labels, holds = first_pass(found)
    places = [i for i, x in enumerate(found) if not x[2] and (x[3] if holds else not x[3] or _length(x[0]) >= SHORT)]
    near: dict[int, list[tuple[int, bool]]] = {}
    for order in (list(enumerate(places)), list(enumerate(places))[::-1]):
        last = None
        for rank, i in order:
            if labels[i] is not None:
                last = (rank, labels[i])
            elif last:
                near.setdefault(i, []).append((abs(rank - last[0]), last[1]))
    out = []
    for i, label in enumerate(labels):
        if label is None:
            seen = near.get(i, [])
            label = not seen or any(good for rank, good in seen if rank == min(seen)[0])
        out.append(label)
    return out


def main_text(html: str) -> str:
    found = blocks(html)
    return "\n".join(x[0] for x, good in zip(found, classify(found), strict=True) if good)


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text`` (string) and ``n_chars`` (long, its code points): the main text of each page.

    The page is cut into blocks at block elements and double line breaks; references are decoded, white space inside
    a block becomes one space, and the good blocks are joined by newlines. Scripts, styles, forms, menus, page headers
    and footers, sidebars, adverts, notices and comments are marked by element, role or name, unless an element marked by
    its name alone holds most of the page's prose; the other blocks are classified by ``classify``. Broken markup is
    read as far as it goes: open elements end with their parent, an open script or comment with the page, an open
    picture or player at once, and a ``<`` behind the last ``>`` is text. A page takes time in proportion to its
    length, whatever its markup. Null and empty pages give an empty text. Columns ``text`` and ``n_chars`` are
    replaced, all others pass through; repeated rows stay.
    """
    base = pages.select(F.struct("*").alias("row"), F.col(html_col).cast("string").alias("html"))
    schema = T.StructType([base.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in K.parts(batches, "html"):
            text = [main_text(x or "") for x in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], names=["row", "text", "n_chars"])

    done = base.mapInArrow(run, schema)
    return done.select(*(F.col("row")[c].alias(c) for c in pages.columns if c not in ("text", "n_chars")), "text", "n_chars")
