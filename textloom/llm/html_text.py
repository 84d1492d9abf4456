"""HTML extraction: two-pass block rules.

A page is cut into blocks at block-level tags, in linear time.

Pass one labels blocks by link density, length and density of stop words.
Anywhere, blocks of a list of links are bad: those made of links for the greater part
that have another such beside them, unless they are sentences with words of their own.
The container says how much the rest takes.  In an article fairly long blocks with stop
words are good and all others stay open: wording alone drops nothing there.  On a page
without an article long or dense blocks are good, fairly long ones without stop words and
short ones with links bad, other short ones open.  Outside the articles of a page that
has some, only long blocks dense in stop words are good.  Blocks in boxes that are by
their element something else (navigation, footers, sidebars, forms, hidden ones) are bad,
as are those that only class, id or role mark as such (adverts, comments, notices): these
the text overturns where nothing else on the page is good.  A class marks a box if all
its parts are such words or words of layout: ``ad-banner`` does, ``related-work`` doesn't.

Pass two: an open block takes the label of the nearest decided blocks: those in the
same element if there are any, else those of its own article (or outside).  Outside
articles the nearer one decides, good where equally near ones differ.  In an article
a block goes only if those on all sides are bad, others of it are good, and it is
neither a sentence nor the main headline.  Without a decided neighbour it is good in an
article and bad outside.

Character references are decoded, white space in a block becomes one space, blocks
are trimmed and joined in page order by one space.  Null counts as empty and gives
an empty text; broken markup never fails and takes linear time; an element that is
never closed hides the rest of the page only if its content is raw text (script, style
and the like); whole pages are read; an empty table gives an empty result; repeated
rows give repeated results; further columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import common

#: A tag ends at the first ``>`` outside a quoted value; only a value that follows ``=`` is quoted, and one without
#: its closing quote is not.  Possessive throughout: no character is tried twice.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>=/]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""")
WORD = re.compile(r"[^\W\d_]+")

#: Elements of raw text: without an end they go on to the end of the page.
RAW = {"script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp"}
#: Elements whose content is not text of the page, where they are closed.
HIDDEN = {"noscript", "template", "svg", "math", "object", "select", "video", "audio", "canvas"}
#: Containers that are never the article's text.
BAD = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "fieldset"}
MAIN = {"article", "main"}
#: Elements that can hold blocks and so are kept on the stack.
HOLD = BAD | MAIN | {"header", "section", "div", "ul", "ol", "dl", "table", "thead", "tbody", "tfoot", "tr", "figure", "blockquote", "details", "center", "body", "html", "head"}
BLOCK = HOLD | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "caption", "figcaption", "pre", "address", "hr", "summary", "legend", "label", "option"}
SELF = {"hr"}
#: Words of class, id and role that mark a box that is not the article's text.
HINTS = set(
    "ad ads advert adverts advertisement advertising adsense adslot adbox sponsor sponsored sponsors promo promos promotion banner nav navbar navigation menu menus submenu "
    "sidebar aside breadcrumb breadcrumbs footer comment comments commentlist respond reply replies disqus cookie cookies consent gdpr notice notices alert "
    "newsletter subscribe subscription signup login share sharing social related recommended widget widgets popup modal overlay pagination pager toolbar "
    "contentinfo complementary search searchform masthead disclaimer".split()
)
HEADER_HINTS = {"header", "topbar"}
#: Words of layout, which say nothing of what a box holds.
LAYOUT = set(
    "site page main global top bottom left right upper lower inner outer wrap wrapper container content box area block section panel column col row list item items group bar slot unit "
    "header post article entry blog user reader thread form link links button buttons icon icons js no primary secondary sticky fixed mobile desktop small large full wide id text title module region".split()
)
#: How a sentence ends, quotes and brackets aside.
SENTENCE = re.compile(r"""[.!?\u2026\u3002]["'\u2019\u201d\xbb)\]]*$""")
#: Common words of English, German, French and Spanish.
STOP_WORDS = set(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our even most me after also "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei "
    "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec son ou mais comme elle nous leur aux ses sa cette ont été fait même être "
    "el los las y del se por con para una su al lo como más pero sus este ya entre cuando muy sin sobre ser también me hasta hay donde han quien desde todo nos durante".split()
)
LONG, SHORT = 200, 70
STOP_HIGH, STOP_LOW, LINKS_HIGH = 0.30, 0.15, 0.4
#: Words outside links that make a linked block a sentence.
OWN_WORDS = 2


#: What box a block stands in: none, one by class words alone, one by its element.
FREE, MARKED, BOXED = 0, 1, 2
ROOT = ("", FREE, 0, 0)


@dataclass
class Block:
    text: str
    link_chars: int
    link_words: int
    article: int  # number of the article container it stands in, 0 outside
    box: int
    parent: int  # number of the innermost container
    headline: bool
    label: str = ""  # good, bad, or empty while undecided


def marks(value: str, hints: set[str]) -> bool:
    """Whether one of the names in a class, id or role consists of hints and words of layout, with one hint at least."""
    for name in value.split():
        words = set(re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower())) - {""}
        if words & hints and not words - hints - LAYOUT:
            return True
    return False


def hinted(attributes: str, inside: bool) -> int:
    """The box that class, id, role or visibility make of an element."""
    found = FREE
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"(?i)display\s*+:\s*+none|visibility\s*+:\s*+hidden", value):
            return BOXED
        if name in ("class", "id", "role") and marks(value, HINTS if inside else HINTS | HEADER_HINTS):
            found = MARKED
    return found


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, int, int, int]] = []  # (tag, box, article number, own number)
    held: Counter[str] = Counter()  # tags on the stack
    pieces: list[str] = []
    links = [0, 0, 0]  # link characters and words in this block, open links
    own, headline = FREE, False  # of this block's own tag
    articles = numbers = 0
    unclosed: set[str] = set()  # elements that are closed nowhere further on

    def end_block() -> None:
        nonlocal own, headline
        text = " ".join(html.unescape("".join(pieces)).split())
        if text:
            _, box, article, parent = stack[-1] if stack else ROOT
            out.append(Block(text, links[0], links[1], article, max(box, own), parent, headline))
        pieces.clear()
        links[:2], own, headline = (0, 0), FREE, False

    def add(raw: str) -> None:
        if raw:
            pieces.append(raw)
            if links[2]:
                words = html.unescape(raw).split()
                links[0] += sum(map(len, words))
                links[1] += len(words)

    at = 0
    while True:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        m = TAG.match(page, lt)
        if not m:
            add(page[at : lt + 1])
            at = lt + 1
            continue
        add(page[at:lt])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in BLOCK:
                end_block()
                if held[tag]:
                    while True:
                        gone = stack.pop()[0]
                        held[gone] -= 1
                        if gone == tag:
                            break
                    links[2] = 0
            elif tag == "a":
                links[2] = 0
            continue
        if tag in RAW or tag in HIDDEN:
            close = None if tag in unclosed else closing(tag).search(page, at)
            if close:
                at = close.end()
            else:
                unclosed.add(tag)
                if tag in RAW and not m[3].rstrip().endswith("/"):
                    at = len(page)
            continue
        if tag == "br":
            pieces.append(" ")
        elif tag == "a":
            links[2] = 1
        elif tag in BLOCK:
            end_block()
            _, box, article, _ = stack[-1] if stack else ROOT
            if tag in BAD or tag == "header" and not article or tag == "option":
                mine = BOXED
            else:
                mine = FREE if tag in MAIN or tag in ("html", "body") else hinted(m[3], bool(article))
            if tag in HOLD:
                if tag in MAIN and not article:
                    articles += 1
                    article = articles
                numbers += 1
                stack.append((tag, max(box, mine), article, numbers))
                held[tag] += 1
            elif tag not in SELF:
                own, headline = mine, tag == "h1"
    end_block()
    return out


@lru_cache(maxsize=64)
def closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\s*+>", re.I)


def link_lists(found: list[Block]) -> list[bool]:
    """Which blocks are entries of a list of links."""
    linked = [b.link_chars > LINKS_HIGH * len(b.text.replace(" ", "")) for b in found]
    out = []
    for i, b in enumerate(found):
        beside = any(0 <= k < len(found) and linked[k] and found[k].article == b.article for k in (i - 1, i + 1))
        sentence = SENTENCE.search(b.text[-8:]) and len(b.text.split()) - b.link_words >= OWN_WORDS
        out.append(linked[i] and beside and not sentence)
    return out


def classify(found: list[Block]) -> list[Block]:
    """Pass one; open blocks are then labelled by pass two."""
    listed = link_lists(found)
    for bar in (MARKED, BOXED):  # boxes by class words alone count only if something else is good
        has_article = any(b.article and b.box < bar for b in found)
        for b, entry in zip(found, listed, strict=True):
            b.label = "bad" if entry or b.box >= bar else judged(b, has_article)
        if any(b.label == "good" for b in found) or not any(b.box == MARKED for b in found):
            break
        if any(b.article and not b.label for b in found):  # short, but an article's
            break
    inherit(found, bar)
    return found


def judged(b: Block, has_article: bool) -> str:
    """The label of a block that is neither boxed nor in a list of links, by its text and the container."""
    size, words = len(b.text), WORD.findall(b.text.lower())
    stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if b.article:
        return "good" if size >= SHORT and stops >= STOP_LOW else ""
    if b.link_chars > LINKS_HIGH * len(b.text.replace(" ", "")) or "\xa9" in b.text:
        return "bad"
    if has_article:
        return "good" if size > LONG and stops >= STOP_HIGH else "bad"
    if size < SHORT:
        return "bad" if b.link_chars else ""
    return "good" if stops >= STOP_HIGH or size > LONG and stops >= STOP_LOW else "bad" if stops < STOP_LOW else ""


def inherit(found: list[Block], bar: int) -> None:
    """Pass two: labels of open blocks from the nearest decided ones; boxes don't count."""
    rest = [b for b in found if b.box < bar]

    def nearest(order, key) -> dict[int, tuple[int, str]]:
        near, last = {}, {}
        for i in order:
            b = rest[i]
            if b.label:
                last[key(b)] = (i, b.label)
            elif key(b) in last:
                near[i] = last[key(b)]
        return near

    both = range(len(rest)), range(len(rest) - 1, -1, -1)
    sides = [[nearest(order, key) for order in both] for key in (lambda b: b.parent, lambda b: b.article)]
    partly = {b.article for b in rest if b.label == "good"}
    for i in [i for i, b in enumerate(rest) if not b.label]:
        b = rest[i]
        near = next((o for o in ([(abs(i - x[0]), x[1]) for x in (side.get(i) for side in pair) if x] for pair in sides) if o), [])
        if b.article:
            goes = near and all(label == "bad" for _, label in near) and b.article in partly and not b.headline and not SENTENCE.search(b.text[-8:])
            b.label = "bad" if goes else "good"
        else:
            b.label = "good" if near and (min(near)[0], "good") in near else "bad"


def main_text(page: str) -> str:
    return " ".join(b.text for b in classify(blocks(page)) if b.label == "good")


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """(id, url, text, n_chars) of every page."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [main_text(t) for t in common.texts(batch.column(1))]
        return common.rows({"id": pa.int64(), "url": pa.string(), "text": pa.string(), "n_chars": pa.int64()}, id=batch.column(0), url=batch.column(2), text=got, n_chars=[len(t) for t in got])

    cut = pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).cast("string").alias("text"), F.col(url_col).cast("string").alias("url"))
    return common.map_batches(cut, run, "id long, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
