"""Main text of web pages: blocks classified by rules, then ambiguous ones by their neighbours."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakeloom.llm._scale import lean

# Elements that end a block of text.
BLOCK_TAGS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody "
    "td tfoot th thead title tr ul".split()
)
# Elements whose text is never shown as prose.
HIDDEN_TAGS = set("head script style noscript template iframe object embed svg math canvas audio video select textarea button datalist".split())
# Elements around a page's main text.
CHROME_TAGS = set("nav footer aside form menu dialog".split())
# Words in class, id or role that name what surrounds a main text.
CHROME_WORDS = set(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr "
    "notice notices notification alert popup modal overlay newsletter subscribe subscription signup login sidebar sidebars aside complementary "
    "widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager masthead topbar toolbar footer contentinfo copyright "
    "disclaimer comment comments commentlist disqus respond replies discussion share sharing social related recommended recommendations "
    "popular trending search skip hidden".split()
)
# Of these, words that name adverts, and words that name what stays surroundings even if it holds article elements.
AD_WORDS = set("ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion promoted".split())
APART_WORDS = AD_WORDS | set("comment comments commentlist disqus respond replies discussion related recommended recommendations popular trending".split())
# Words that name adverts and readers' comments whatever stands beside them.
FINAL_WORDS = AD_WORDS | set("comment comments commentlist disqus".split())
# Words that make a name say how a page is laid out, as in has-sidebar or menu-open.
STATE_WORDS = set("has with without no not free layout open opened enabled disabled toggled".split())
# Words that say nothing but where or what kind of box an element is: a name of these and of what surrounds a main text is certain,
# any other word beside makes it doubtful, as in search-results or social-history.
BOX_WORDS = set(
    "area articles bar block body bottom box button buttons center col column container content element footer form global group header holder icon icons inner "
    "item items left links list main module news outer page panel post posts primary right row secondary section side site small sticky stories story sub text title top wrap wrapper".split()
)
# Words in class, id, role or itemprop that name a main text.
ARTICLE_WORDS = set("article articlebody story post entry maincontent main".split())
# Elements without content or end tag.
VOID_TAGS = set("area base br col embed frame hr img input link meta param source track wbr".split())
# Frequent function words of several languages.
STOP_WORDS = set(
    "the of and to in a is that it for on was with as be by at this from are or an not have but they which you were her all she there would "
    "le la les de des du un une et est en que qui dans pour par sur au aux il elle ce pas ne se plus avec son sa "
    "der die das und ist zu den von mit sich nicht ein eine dem auf für im auch als es an werden aus er hat dass sie nach bei "
    "el los las y del que en por con una para su al lo como más pero sus no se o".split()
)

# no tag reaches over another's "<", so a page without ">" is read once and not from every "<" to its end
_TOKEN = re.compile(r"<(?P<special>!--|!\[CDATA\[)|<[!?][^<>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/<>]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>")
_ATTR = re.compile(r"\b(class|id|role|itemprop|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "math", "object", "select", "canvas")}
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_BIG_REFERENCE = re.compile(r"&#(?:([0-9]{8,})|[xX]([0-9a-fA-F]{7,}));?")
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
# scripts that are written without spaces, or that build long words: there a character counts as a word
_DENSE = "\u0e00-\u0eff\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af"
_WORD = re.compile(rf"[{_DENSE}]|[^\W{_DENSE}]+")
_DENSE_CHAR = re.compile(f"[{_DENSE}]")
_SPACE = re.compile(r"\s+")


# How much an element is surroundings: not, by a form, by a name, by its kind or a name of APART_WORDS, never shown.
# An article element within the second or third is a main text all the same, a main element also within the fourth.
SHOWN, FORM, NAMED, APART, HIDDEN = range(5)


@dataclass(frozen=True)
class BlockRules:
    """Thresholds of the first pass: characters, share of stop words, share of characters within links.

    Elements and names are one feature: within a main text a middling share of stop words is enough, and
    what has too few is ambiguous, not bad. A doubtful name counts unless its element holds a long block with
    many stop words. Where a page has few of the known stop words, its ``learned`` most frequent words are its own.
    """

    short: int = 70
    long: int = 200
    stop_low: float = 0.15
    stop_high: float = 0.3
    links: float = 0.33
    links_article: float = 0.7
    learned: int = 40


@dataclass
class _Block:
    text: str
    link_chars: int
    chrome: int
    main: int  # which main text element it is in; 0: none
    heading: bool
    doubtful: int = 0  # which element of a doubtful name it is in; 0: none
    label: str = ""
    density: float = 0.0

    @property
    def size(self) -> int:
        """Characters, those of dense scripts counted three times."""
        return len(self.text) + 2 * len(_DENSE_CHAR.findall(self.text))

    @property
    def linked(self) -> float:
        return self.link_chars / max(1, len(_SPACE.sub("", self.text)))

    @property
    def words(self) -> list[str]:
        return [w.lower() for w in _WORD.findall(self.text)]


def _decoded(text: str) -> str:
    """``text`` with its character references decoded; numbers beyond Unicode, however long, are U+FFFD."""

    def small(m: re.Match) -> str:
        digits = (m[1] or m[2]).lstrip("0")
        if len(digits) > (7 if m[1] else 6):
            return "\ufffd"
        return f"&#{'' if m[1] else 'x'}{digits or '0'};"

    return html.unescape(_BIG_REFERENCE.sub(small, text) if "&#" in text else text)


def _closes_itself(attrs: str) -> bool:
    """Whether a tag's attributes end in a slash that is not the end of a value without quotes."""
    if not attrs.endswith("/"):
        return False
    last = max(attrs.rfind(c) for c in " \t\n\r\f\"'>") + 1
    return "=" not in attrs[last:] and not attrs[:last].rstrip().endswith("=")


def _names(attrs: str) -> tuple[set[str], set[str], set[str]]:
    """Words of class, id, role and itemprop: of certain names, of doubtful ones, and of names of a layout's state."""
    certain: set[str] = set()
    doubtful: set[str] = set()
    states: set[str] = set()
    for name, *value in _ATTR.findall(attrs):
        if name.lower() in ("class", "id", "role", "itemprop"):
            for token in "".join(value).split():
                parts = {x.lower() for x in _PARTS.findall(token)}
                kind = states if parts & STATE_WORDS else doubtful if parts & CHROME_WORDS and parts - CHROME_WORDS - BOX_WORDS else certain
                kind.update(parts, [token.lower()])
    return certain, doubtful, states


def _attributes(tag: str, attrs: str) -> tuple[int, bool, str, bool]:
    """How much an element's attributes name surroundings, whether they name a main text, main or article if they say
    that it is one, and whether a name of surroundings is doubtful."""
    if not attrs or tag in ("html", "body"):
        return SHOWN, False, "", False
    kind = ""
    for name, *value in _ATTR.findall(attrs):
        value = "".join(value)
        name = name.lower()
        if name == "hidden" and not value or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return HIDDEN, False, "", False
        if name == "role" and value.lower() in ("main", "article"):
            kind = value.lower()
        elif name == "itemprop" and value.lower() == "articlebody":
            kind = kind or "article"
    words, doubtful, states = _names(attrs)
    article = bool((words | doubtful | states) & ARTICLE_WORDS)
    words |= doubtful & FINAL_WORDS
    if tag in ("article", "main"):
        words &= {"comment", "comments", "commentlist", "ad", "ads", "sponsored"}
        doubtful = set()
    level = APART if words & APART_WORDS else NAMED if words & CHROME_WORDS else SHOWN
    return level, article, kind, bool(doubtful & CHROME_WORDS) and level == SHOWN


def _inline(attrs: str, tag: str) -> bool:
    """Whether an inline element is hidden or an advert."""
    if not attrs:
        return False
    named = _attributes(tag, attrs)[0]
    if named in (SHOWN, HIDDEN):
        return named == HIDDEN
    certain, doubtful, _ = _names(attrs)
    return bool((certain | doubtful) & AD_WORDS)


class _Page:
    """Reads a page once; ``found`` are its blocks of visible text in order. Unclosed and stray tags are tolerated."""

    def __init__(self, page: str):
        self.page, self.found = page, []
        self.stack: list[tuple[str, int, int, int]] = []  # open block elements: name, how much surroundings, main text, doubtful name
        self.opened: Counter[str] = Counter()
        self.parts: list[str] = []
        self.links = 0
        self.in_link = self.heading = False
        self.skipped, self.skip_depth, self.skip_below = "", 0, 0  # an inline element of surroundings
        self.mains = self.doubts = 0
        self._read()
        self._close()

    def _text(self, piece: str) -> None:
        if self.skipped:
            return
        piece = _decoded(piece)
        self.parts.append(piece)
        if self.in_link:
            self.links += len(_SPACE.sub("", piece))

    def _close(self) -> None:
        joined = _SPACE.sub(" ", "".join(self.parts)).strip()
        _, chrome, main, doubtful = self.stack[-1] if self.stack else ("", SHOWN, 0, 0)
        if joined and chrome < HIDDEN:
            self.found.append(_Block(joined, self.links, chrome, main, self.heading, doubtful))
        self.parts, self.links = [], 0

    def _pop(self) -> str:
        tag = self.stack.pop()[0]
        self.opened[tag] -= 1
        if len(self.stack) < self.skip_below:
            self.skipped = ""  # inline elements end with the block that holds them
        return tag

    def _read(self) -> None:
        page, at, n = self.page, 0, len(self.page)
        endless: set[str] = set()  # elements of raw text that no end tag follows any more
        last_cdata = page.rfind("]]>")
        while at < n:
            m = _TOKEN.search(page, at)
            if not m:
                self._text(page[at:])
                return
            if m.start() > at:
                self._text(page[at : m.start()])
            at = m.end()
            if m["special"] == "!--":
                stop = page.find("-->", at)
                at = stop + 3 if stop >= 0 else n
            elif m["special"] and at <= last_cdata:
                stop = page.find("]]>", at)
                self._text(page[at:stop])
                at = stop + 3
            if m["tag"] is None:
                continue
            tag, attrs = m["tag"].lower(), m["attrs"]
            closed = tag in VOID_TAGS or _closes_itself(attrs)
            if m["end"]:
                self._end(tag)
            elif tag in _RAW_END and not closed:
                stop = None if tag in endless else _RAW_END[tag].search(page, at)
                if not stop:
                    endless.add(tag)
                at = stop.end() if stop else n if tag in ("script", "style") else at
                self.parts.append(" " if tag == "title" else "")
            else:
                self._start(tag, attrs, closed)

    def _start(self, tag: str, attrs: str, closed: bool) -> None:
        if tag == "br":
            self.parts.append(" ")
        if tag not in BLOCK_TAGS and tag not in HIDDEN_TAGS and "-" not in tag:
            if tag == self.skipped and not closed:
                self.skip_depth += 1
            if tag == "a":
                self.in_link = True
            elif not closed and not self.skipped and _inline(attrs, tag):  # a span may still name an advert
                self.skipped, self.skip_depth, self.skip_below = tag, 1, len(self.stack)
            return
        self._close()
        if closed:
            return
        if tag == "p" or tag in _HEADINGS:
            while self.stack and self.stack[-1][0] in ("p", *_HEADINGS):
                self._pop()
        elif "-" not in tag and self.stack and self.stack[-1][0] == "p":
            self._pop()
        _, chrome, main, doubtful = self.stack[-1] if self.stack else ("", SHOWN, 0, 0)
        named, named_main, kind, doubted = _attributes(tag, attrs)
        kind = tag if tag in ("article", "main") else kind
        if kind and chrome <= (APART if kind == "main" else NAMED):
            chrome = SHOWN
        own = HIDDEN if tag in HIDDEN_TAGS else FORM if tag == "form" else APART if tag in CHROME_TAGS or tag == "header" and not main else SHOWN
        if named == HIDDEN or named and not (named == NAMED and named_main and not main):
            own = max(own, named)
        if (kind or named_main) and not main:
            self.mains += 1
            main, doubtful = self.mains, 0
        if doubted and not doubtful and not named_main:
            self.doubts += 1
            doubtful = self.doubts
        self.stack.append((tag, max(chrome, own), main, doubtful))
        self.opened[tag] += 1
        self.heading = tag in _HEADINGS
        self.in_link = False

    def _end(self, tag: str) -> None:
        if tag == "a":
            self.in_link = False
        elif tag == self.skipped:
            self.skip_depth -= 1
            if not self.skip_depth:
                self.skipped = ""
            return
        if tag not in BLOCK_TAGS and tag not in HIDDEN_TAGS and "-" not in tag:
            return
        self._close()
        self.heading = False
        if self.opened[tag]:
            while self._pop() != tag:
                pass


def blocks(page: str) -> list[_Block]:
    """The page's blocks of visible text in order, in time in proportion to its length."""
    return _Page(page).found


def _stop_words(found: list[_Block], rules: BlockRules) -> set[str]:
    """The known stop words or, if the page's longer blocks hold few of them, the most frequent words of those blocks."""
    prose = [w for b in found if not b.chrome and b.size >= rules.short and b.linked <= rules.links for w in b.words]
    if sum(w in STOP_WORDS for w in prose) >= rules.stop_low * len(prose):
        return STOP_WORDS
    ranked = sorted(Counter(prose).items(), key=lambda x: (-x[1], x[0]))
    return STOP_WORDS | {w for w, n in ranked[: rules.learned] if n > 1}


def _first_pass(b: _Block, rules: BlockRules) -> str:
    if b.chrome or b.linked > (rules.links_article if b.main else rules.links):
        return "bad"
    if b.size < rules.short:
        return "bad" if b.link_chars and not b.main else "short"
    if b.density >= rules.stop_high:
        return "good" if b.size > rules.long or b.main else "near"
    if b.density >= rules.stop_low:
        return "good" if b.main else "near"
    return "near" if b.main else "bad"


def _decide(found: list[_Block], rules: BlockRules) -> None:
    """First pass over all blocks. An element of a doubtful name is surroundings unless a long block in it has many stop words."""
    stop = _stop_words(found, rules)
    outvoted: set[int] = set()
    for b in found:
        words = b.words
        b.density = sum(w in stop for w in words) / max(1, len(words))
        b.label = _first_pass(b, rules)
        if b.doubtful and b.label == "good" and b.size > rules.long and b.density >= rules.stop_high:
            outvoted.add(b.doubtful)
    for b in found:
        if b.doubtful and b.doubtful not in outvoted:
            b.label = "bad"


def main_text(page: str | None, rules: BlockRules = BlockRules()) -> str:
    """The main text of one page, its blocks in order, one space between; empty if there is none.

    A form is surroundings unless nothing is left without it: then it is around the whole page.
    """
    found = blocks(page or "")
    text = _joined(found, rules)
    if not text and any(b.chrome == FORM for b in found):
        for b in found:
            b.chrome = SHOWN if b.chrome == FORM else b.chrome
        text = _joined(found, rules)
    return text


def _nearest(found: list[_Block]) -> list[tuple[int, str]]:
    """For each block the distance and label of the last decided block before it that may speak for it.

    For a block of a main text that is one of the same main text, decided by its words and links; for
    another block any decided one. Distance 0 stands for none.
    """
    last: dict[int, int] = {}
    out = []
    for k, b in enumerate(found):
        scope = b.main if b.main and not b.chrome else 0
        i = last.get(scope)
        out.append((0, "") if i is None else (k - i, found[i].label))
        if b.label in ("good", "bad"):
            last[0] = k
            if scope:
                last[scope] = k
    return out


def _joined(found: list[_Block], rules: BlockRules) -> str:
    _decide(found, rules)
    before, after = _nearest(found), _nearest(found[::-1])[::-1]
    good_seen = any(b.label == "good" for b in found)
    final = []
    for b, (far, one), (near, two) in zip(found, before, after, strict=True):
        if b.label in ("good", "bad"):
            label = b.label
        elif b.main and not far and not near:
            label = "good"  # nothing in the main text is decided: it is what its element says
        elif b.main:
            label = one if far and (not near or far <= near) else two
            label = "good" if b.label == "near" and "good" in (one, two) else label
        else:
            one, two = one or "bad", two or "bad"
            if one == two:
                # a page of middling blocks only: they are its text
                label = "good" if b.label == "near" and one == "bad" and not good_seen else one
            elif b.label == "near" or b.heading and two == "good":
                label = "good"
            else:  # the nearer neighbour decides, the one before if equally near
                label = one if far and (not near or far <= near) else two
        final.append(label)
    return " ".join(b.text for b, label in zip(found, final, strict=True) if label == "good")


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: BlockRules = BlockRules()) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points).

    First pass: a block mostly of links, or within navigation, page header, footer, sidebar, form, advert,
    notice or reader comments, is bad; its length and share of stop words make any other good, near, short
    or bad, where less is asked of a block within an article element. Elements are known by their kind and
    by class, id and role; a name with words beyond those of layout (search-results) is outvoted by long
    prose in its element, except for adverts and comments. Stop words are those of English, French, German and
    Spanish, or the page's own most frequent words where it has few of these; scripts without spaces
    count by character. Second pass: near and short blocks
    take the label of the nearest decided blocks around them, within an article of the nearest in it; an
    article in which none is decided is text. The good blocks are the text. Reading and both passes take
    time in proportion to the page's length, whatever its markup.

    Null html is empty, and text then is the empty string; ids and urls may be null or repeated; an
    empty table gives no rows. Each page is worked on alone, in batches.
    """
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, rules) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kinds = [base.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return base.mapInArrow(lean(run), f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
