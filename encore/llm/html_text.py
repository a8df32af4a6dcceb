"""Main text of web pages by two passes of block rules.

The project keeps no web pages, so the operator is general: one row per page.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encore.llm.words import slices, texts
from encore.session import ship_package

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """a an and are as at be but by for from had has have he her his i in is it not of on or she that the their they this to was we were which who will with you
    als am auch auf aus bei bin bis das dass dem den der des die ein eine einem einen einer er es für haben hat ich ihr im ist mit nach nicht noch nur oder sich sie sind über um und uns von vor war wie wir zu zum zur
    au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qui que sa se ses son sont sur un une vous
    al como con cuando del desde donde el ella entre era esta este fue ha hay las lo los más muy no o para pero por porque se si sin sobre su sus también tiene y ya""".split()
)
# Elements whose content is no text of the page, elements that only mark up text, and elements that hold blocks.
HIDDEN = frozenset("script style noscript template textarea select button iframe svg math canvas object audio video head".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
HOLDERS = frozenset("div section article main nav header footer aside form ul ol dl table tbody thead tfoot tr td figure details dialog menu fieldset center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# What a holder's element, and words of its class, id or role, say about its text.
SIDE_ELEMENTS = frozenset("nav aside form menu dialog fieldset footer".split())
SIDE_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar topnav sidenav navigation menu submenu breadcrumb
    breadcrumbs crumbs pagination pager sidebar sidebars rail aside comment comments reply replies respond disqus cookie cookies consent gdpr privacy
    notice notices notification alert disclaimer newsletter subscribe subscription signup login share sharing social related recommended recommendations popup modal
    overlay widget widgets toolbar form complementary footer copyright contentinfo""".split()
)
# Words that name parts of a frame as well as topics of a text.
TOPIC_WORDS = frozenset("search legal feedback discussion".split())
HEAD_WORDS = frozenset("header masthead banner topbar".split())
MAIN_WORDS = frozenset("article articlebody post entry story main".split())
WITH_WORDS = frozenset("with has no without".split())

DOUBTFUL, SIDE, OPEN, MAIN = -2, -1, 0, 1
SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH, LINK_HIGH = 0.15, 0.30, 0.2
#: Below this share of stop words over all undecided text, the language is taken as unknown and stop words decide nothing.
STOP_KNOWN = 0.05

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_MAY_HIDE = re.compile(r"hidden|none", re.I)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_COMMENT = re.compile(r"/\*.*?\*/", re.S)
_HIDING_STYLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|(?:content-)?visibility\s*:\s*hidden)(?![\w-])", re.I)


@dataclass
class Block:
    text: str
    linked: int
    label: int
    heading: bool


def unseen(attributes: str) -> bool:
    """Whether an element is hidden by the attribute ``hidden``, ``aria-hidden``, a class ``hidden`` or its style.

    The word in any other attribute or value (``overflow: hidden``, a title) hides nothing.
    """
    if not _MAY_HIDE.search(attributes):
        return False
    for match in _ATTRIBUTE.finditer(attributes):
        name, value = match[1].lower(), entities.unescape(next(filter(None, match.groups()[1:]), ""))
        if (
            name == "hidden"
            or name == "aria-hidden" and value.strip().lower() == "true"
            or name == "class" and "hidden" in value.lower().split()
            or name == "style" and _HIDING_STYLE.search(_COMMENT.sub("", value))
        ):
            return True
    return False


def holder_label(name: str, attributes: str, outer: int) -> int:
    """What an opened element says about its text; without a hint that of the element around it.

    Each name in class, id or role is looked at by its words, so ``post-comments`` is
    beside the text and ``has-sidebar`` says nothing. A header belongs to the text
    only inside it or where it says so. Words that are topics as well (``search-tips``)
    make a holder doubtful, but an ``article``.
    """
    if name in SIDE_ELEMENTS:
        return SIDE
    main = name in ("article", "main")
    if attributes.strip():
        if unseen(attributes):
            return SIDE
        for match in _NAMED.finditer(attributes):
            for token in next(filter(None, match.groups()), "").split():
                words = {w.lower() for w in _PART.findall(token)}
                if words & WITH_WORDS:
                    continue
                if words & SIDE_WORDS and not (words & HEAD_WORDS and outer == MAIN) and name != "main":
                    return SIDE
                if words & HEAD_WORDS and outer != MAIN and not main and not words & (MAIN_WORDS | {"content"}):
                    return SIDE
                if words & TOPIC_WORDS and not main:
                    return SIDE if outer == SIDE else DOUBTFUL
                main = main or bool(words & MAIN_WORDS)
    if main:
        return outer if outer < OPEN and name not in ("article", "main") else MAIN
    return SIDE if name == "header" and outer != MAIN else outer


def blocks_of(page: str) -> list[Block]:
    """Text blocks of a page in order, each with its linked characters and what its holders say."""
    out: list[Block] = []
    stack: list[tuple[str, int]] = []
    parts: list[str] = []
    linked = at = links = 0
    heading, own = False, None

    def label() -> int:
        outer = stack[-1][1] if stack else OPEN
        return outer if own is None else own

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, min(linked, len(text)), label(), heading))
        parts.clear()
        linked = 0

    def read(text: str) -> None:
        nonlocal linked
        if text:
            text = entities.unescape(text)
            parts.append(text)
            linked += len(text) if links else 0

    while match := _TAG.search(page, at):
        read(page[at : match.start()])
        at = match.end()
        if not match[2]:
            continue
        name, ends = match[2].lower(), match[1] == "/"
        if name in HIDDEN and not ends and not match[3].endswith("/"):
            closing = re.compile(rf"</{name}\b[^>]*>|<body\b" if name == "head" else rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = len(page) if closing is None else closing.start() if closing[0][1] != "/" else closing.end()
            if name not in ("button", "select"):
                continue
        if name == "a":
            links = 0 if ends else 1
        elif name == "br":
            parts.append(" ")
        elif name not in INLINE:
            close()
            own, heading, links = None, False, 0
            if name not in HOLDERS:
                if not ends:
                    heading = name in HEADINGS
                    outer = stack[-1][1] if stack else OPEN
                    hint = holder_label(name, match[3], outer) if match[3] and name not in ("html", "body") else outer
                    own = hint if hint != outer else None
            elif ends:
                depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
                if depth is not None:
                    del stack[depth:]
            elif not match[3].endswith("/"):
                stack.append((name, holder_label(name, match[3], stack[-1][1] if stack else OPEN)))
    read(page[at:])
    close()
    return out


def decided(blocks: list[Block]) -> list[int]:
    """First pass: MAIN, SIDE, or OPEN for blocks that are too short to tell."""
    undecided = [b for b in blocks if b.label == OPEN]
    words = [w.lower() for b in undecided for w in _WORD.findall(b.text)]
    known = sum(w in STOP_WORDS for w in words) >= STOP_KNOWN * len(words)
    labels = []
    for b in blocks:
        if b.label == SIDE:
            labels.append(SIDE)
            continue
        if b.linked > LINK_HIGH * len(b.text) and (b.label in (OPEN, DOUBTFUL) or b.linked > 0.9 * len(b.text) and len(b.text) < SHORT):
            labels.append(OPEN if b.label == MAIN else SIDE)
            continue
        if b.label == MAIN:
            labels.append(MAIN)
            continue
        own = [w.lower() for w in _WORD.findall(b.text)]
        density = sum(w in STOP_WORDS for w in own) / max(1, len(own))
        if b.label == DOUBTFUL:
            labels.append(MAIN if len(b.text) >= LONG and density >= STOP_HIGH else SIDE)
            continue
        if len(b.text) < SHORT or b.heading:
            labels.append(SIDE if b.linked else OPEN)
        elif not known:
            labels.append(MAIN if len(b.text) >= LONG else OPEN)
        elif density >= STOP_HIGH:
            labels.append(MAIN if len(b.text) >= LONG else OPEN)
        else:
            labels.append(OPEN if density >= STOP_LOW else SIDE)
    return labels


def inherited(blocks: list[Block], labels: list[int]) -> list[bool]:
    """Second pass: an undecided block takes the label of its nearest decided neighbour.

    Where both are as near, a heading takes that of the next one, and another
    block is kept if either neighbour is.
    """
    n = len(labels)
    before, after = [None] * n, [None] * n
    for order, side in ((range(n), before), (range(n - 1, -1, -1), after)):
        last = None
        for i in order:
            if labels[i] != OPEN:
                last = i
            side[i] = last
    keep = []
    for i, label in enumerate(labels):
        if label != OPEN:
            keep.append(label == MAIN)
            continue
        left, right = before[i], after[i]
        if left is None or right is None:
            near = right if left is None else left
            keep.append(near is not None and labels[near] == MAIN)
        elif blocks[i].heading or i - left > right - i:
            keep.append(labels[right] == MAIN)
        elif i - left < right - i:
            keep.append(labels[left] == MAIN)
        else:
            keep.append(MAIN in (labels[left], labels[right]))
    return keep


def main_text(page: str) -> str:
    blocks = blocks_of(page)
    return "\n\n".join(b.text for b, kept in zip(blocks, inherited(blocks, decided(blocks))) if kept)


def extract_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The main text of every page.

    The whole page is cut into blocks at block-level tags. First pass: holders
    such as ``nav`` or ``class="ad"`` and ``article`` decide their blocks; other
    blocks are decided by their length, density of stop words and density of
    links; in a holder named after a topic (``search-tips``) only long prose stays. Second pass: short blocks inherit the label of their nearest decided
    neighbours. Character references are decoded, white space inside a block
    becomes one space, and blocks are joined by two line feeds. Nothing is cut.

    A null or empty page has an empty text; so has one without main text. Ids and
    urls may be null or repeat, each row gives one row. An empty table gives no
    rows; other columns are ignored. Pages are read one by one, without a shuffle.

    Columns: page_id, url, text, n_chars (code points).
    """
    ship_package(pages.sparkSession)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            found = [main_text(p) for p in texts(part.column(2))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.string())], ["id", "url", "text"])

    rows = pages.select(F.col(page_id).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(extract, f"id {kind}, url string, text string")
    return out.select(F.col("id").alias(page_id), F.col("url").alias(url), "text", F.length("text").cast("long").alias("n_chars"))
