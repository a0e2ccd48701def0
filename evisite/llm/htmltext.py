"""Operator 11: main text of web pages by two-pass block rules.

A linear scan cuts a page into blocks (runs of text between block-level tags) with their length, their share of link text,
their share of stop words, and the container that they stand in. Pass one decides the clear blocks:

* *bad*: text in menus, headers, footers, sidebars, notices, adverts, forms and reader comments (by tag, role or class word),
  blocks that are mostly links, outside an article also copyright lines and long blocks without stop words; where a page
  marks its article, all text outside of it;
* *good*: blocks of ``SHORT`` characters or more inside an article, elsewhere long blocks that are rich in stop words.

What remains is ambiguous: short blocks, and outside an article those of middling length or stop-word density. Pass two gives
each the label of its nearest decided neighbours in the same container; text that stands aside by its tag, role or class is nobody's
neighbour, and an article's own borders count as good ones. Where the sides differ, prose of middling density and headings before
good text are good, the nearer side decides for others, and the article where both are equally near.

Cases: null and empty pages, and pages without text, give an empty text. Tags, comments, scripts and attribute values that
never end run to the end of the page. Repeated rows get equal results. Empty tables give empty results. Extra columns are
ignored. Whole pages are read, in time that grows with their length.
"""

from __future__ import annotations

import functools
import html
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evisite.llm.common import byte_slices

SHORT, LONG = 70, 140  # characters
FEW, MANY = 0.08, 0.20  # stop words to words
LINKED = 0.5  # characters of links to characters

# Element names of the HTML standard, and common class words.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
SCOPES = frozenset("html table td th caption button object template applet marquee".split())
UNREAD = frozenset("head noscript template svg math canvas object iframe audio video noembed noframes datalist".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SIDE_TAGS = frozenset("nav footer aside form menu dialog button select search".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
SIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner comment comments respond reply replies disqus discussion reactions feedback cookie cookies consent gdpr notice notification privacy paywall alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar sidebar aside widget related recommended share sharing social newsletter subscribe signup signin login search footer copyright skip outbrain taboola".split()
)
SIDE_STEMS = ("comments", "commentlist", "commentform", "sidebar", "advert", "adslot", "adsense", "adbox", "adunit", "cookie", "breadcrumb", "newsletter", "sponsor", "navbar")
HEAD_WORDS = frozenset("header masthead topbar".split())
NEGATIONS = frozenset("has no not with without is show hide".split())
MAIN_WORDS = frozenset("article content post entry story main body text".split())
STOP_WORDS = frozenset(
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which will with you "
    "aber als am auf aus bei das dem den der des die ein eine einen einer er es für hat ich im ist mit nicht sich sie sind und von war wie wird zu zum zur "
    "al como con cuando de del el en era es la las le lo los más no o para pero por que se sin su sus un una y "
    "au aux avec ce dans des du elle est et il je les leur mais ne nous ou par pas plus pour qui sa ses son sur une vous".split()
)

TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
ATTRIBUTE = re.compile(r"([^\s=>\"'/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")
COMMENT_END = re.compile(r"--!?>")  # from the mark's own hyphens on, so that <!--> and <!---> end
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
CLASS_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
WORD = re.compile(r"[^\W\d_]+")


@functools.lru_cache(maxsize=4096)
def roles(name: str, attributes: str) -> tuple[bool, bool, int]:
    """Of a start tag: stands aside, is a page header, and how surely it holds the article (2 by tag or role, 1 by a class word)."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if attributes else {}
    role = found.get("role", "").strip().lower()
    main = 2 if name in ("article", "main") or role in ("main", "article") or found.get("itemprop", "").lower() == "articlebody" else 0
    aside = name in SIDE_TAGS or role in SIDE_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(HIDDEN.search(found.get("style", "")))
    header = name == "header"
    if name not in ("html", "body"):
        for one in (found.get("class", "") + " " + found.get("id", "")).split():
            words = [w.lower() for w in CLASS_WORD.findall(one)]
            if words and words[0] not in NEGATIONS:
                ends = {words[0], words[-1]}
                aside = aside or bool(ends & SIDE_WORDS) or any(w.startswith(SIDE_STEMS) for w in ends)
                header = header or bool(ends & HEAD_WORDS)
                main = main or int(words[-1] in MAIN_WORDS)
    return aside, header, main


@dataclass
class Block:
    text: str
    links: int  # characters of links
    heading: bool
    home: int  # number of the container, 0: the page
    level: int  # how surely the container is an article
    aside: bool
    label: str = ""


@dataclass
class _Open:
    name: str
    aside: bool
    unread: bool
    link: bool
    heading: bool
    home: int
    level: int
    p_at: int  # place of the paragraph that a block-level tag would end, or -1
    li_at: int


@dataclass
class _Scan:
    blocks: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    links: int = 0
    state: _Open | None = None
    breaks: int = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            s = self.state
            self.blocks.append(Block(text, min(len(text), self.links), s.heading, s.home, s.level, False))
        self.parts, self.links, self.state, self.breaks = [], 0, None, 0

    def text(self, raw: str, top: _Open) -> None:
        if top.unread or not raw:
            return
        text = html.unescape(raw) if "&" in raw else raw
        blank = not text.strip()
        if top.aside:
            if not blank and not (self.blocks and self.blocks[-1].aside):
                self.blocks.append(Block("", 0, False, -1, top.level, True))  # nobody's neighbour
            return
        self.parts.append(text)
        if not blank:
            self.breaks = 0
            self.state = self.state or top
            if top.link:
                self.links += len(" ".join(text.split()))


def scan(page: str) -> list[Block]:
    """The blocks of a page in order; a run of text that stands aside is one empty block with ``aside``."""
    out, stack, count = _Scan(), [_Open("", False, False, False, False, 0, 0, -1, -1)], {}
    homes, at, end = 0, 0, len(page)

    def cut(place: int) -> None:
        for gone in stack[place:]:
            count[gone.name] -= 1
        del stack[place:]

    while at < end:
        low = page.find("<", at)
        if low < 0:
            out.text(page[at:], stack[-1])
            break
        mark = page[low + 1 : low + 2]
        if not (mark.isascii() and mark.isalpha()) and mark not in ("/", "!", "?"):
            out.text(page[at : low + 1], stack[-1])
            at = low + 1
            continue
        out.text(page[at:low], stack[-1])
        if page.startswith("<!--", low):
            close = COMMENT_END.search(page, low + 2)
            at = close.end() if close else end
            continue
        found = TAG.match(page, low)
        if not found:
            if mark.isalpha() or page[low + 2 : low + 3].isalpha() and mark == "/":
                break  # a tag without an end
            close = page.find(">", low)
            at = end if close < 0 else close + 1
            continue
        at, name = found.end(), found[2].lower()
        if found[1]:
            if name in BLOCKS:
                out.flush()
            if count.get(name):
                place = len(stack) - 1
                while stack[place].name != name:
                    place -= 1
                cut(place)
            continue
        if name == "br":
            out.breaks += 1
            if out.breaks > 1:
                out.flush()
            else:
                out.parts.append(" ")
            continue
        if name in BLOCKS:
            out.flush()
            if name in CLOSES_P and stack[-1].p_at >= 0:
                cut(stack[-1].p_at)
            if name == "li" and stack[-1].li_at >= 0:
                cut(stack[-1].li_at)
        if name in VOID:
            continue
        if name in RAW:
            ended = RAW_END[name].search(page, at)
            stop = ended.start() if ended else end
            at = stop
            if not ended:
                break
            close = page.find(">", stop)
            at = end if close < 0 else close + 1
            continue
        top = stack[-1]
        aside, header, main = roles(name, found[3].strip())
        home, level = top.home, top.level
        if main > level or main == 2:
            homes += 1
            home, level = homes, max(level, main)
        place, scope = len(stack), name in SCOPES
        stack.append(
            _Open(
                name,
                top.aside or aside or header and level < 1,
                top.unread or name in UNREAD,
                top.link or name == "a",
                name in ("h1", "h2", "h3", "h4", "h5", "h6") or top.heading and name not in BLOCKS,
                home,
                level,
                place if name == "p" else -1 if scope else top.p_at,
                place if name == "li" else -1 if scope or name in ("ul", "ol", "menu") else top.li_at,
            )
        )
        count[name] = count.get(name, 0) + 1
    out.flush()
    return out.blocks


def density(text: str) -> float:
    """Stop words to words."""
    words = WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def label(blocks: list[Block]) -> list[Block]:
    """Both passes; on return each block's label is good or bad."""
    surest = max((b.level for b in blocks if not b.aside), default=0)
    kinds = []
    for b in blocks:
        n, kind = len(b.text), "short"
        if b.aside or b.level < surest == 2 or b.links > LINKED * n:
            kind = "bad"
        elif b.level:
            kind = "good" if n >= SHORT else "short"
        elif "\N{COPYRIGHT SIGN}" in b.text and n < LONG or n < SHORT and b.links:
            kind = "bad"
        elif n >= SHORT:
            share = density(b.text)
            kind = "bad" if share < FEW else "good" if share >= MANY and n > LONG else "near"
        kinds.append(kind)
    settled: dict[int, list[int]] = {}  # decided blocks of each container
    for k, b in enumerate(blocks):
        b.label = kinds[k]
        if kinds[k] in ("good", "bad"):
            settled.setdefault(b.home, []).append(k)
    last: dict[int, int] = {}
    nearest_before = []
    for k, b in enumerate(blocks):
        nearest_before.append(last.get(b.home, -1))
        if kinds[k] in ("good", "bad"):
            last[b.home] = k
    nearest_after, follows = [-1] * len(blocks), {}
    for k in range(len(blocks) - 1, -1, -1):
        nearest_after[k] = follows.get(blocks[k].home, -1)
        if kinds[k] in ("good", "bad"):
            follows[blocks[k].home] = k
    first: dict[int, int] = {}
    final: dict[int, int] = {}
    for k, b in enumerate(blocks):
        first.setdefault(b.home, k)
        final[b.home] = k
    for k, b in enumerate(blocks):
        if kinds[k] in ("good", "bad"):
            continue
        sides = []  # (distance, label)
        for to, border in ((nearest_before[k], first[b.home] - 1), (nearest_after[k], final[b.home] + 1)):
            if to >= 0:
                sides.append((abs(to - k), kinds[to]))
            elif b.level:
                sides.append((abs(border - k), "good"))
        if not sides:
            b.label = "good"  # nothing on the page is decided
        elif len({s for _, s in sides}) == 1:
            b.label = sides[0][1]
        elif kinds[k] == "near" or b.heading and sides[1][1] == "good":
            b.label = "good"
        elif sides[0][0] != sides[1][0]:
            b.label = min(sides)[1]
        else:
            b.label = "good" if b.level else "bad"
    return blocks


def main_text(page: str | None) -> str:
    """The good blocks of a page, one a line."""
    return "\n".join(b.text for b in label(scan(page or "")) if b.label == "good" and b.text)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    wanted = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def read(batches):
        for batch in batches:
            for some in byte_slices(batch, 2):
                texts = [main_text(p) for p in some.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(wanted.dtypes)
    return wanted.mapInArrow(read, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
