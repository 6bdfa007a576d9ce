"""Operator 2, HTML extraction: two-pass block rules.

A page is cut into blocks at block-level tags. Regions whose element or role is never main text are left
out. Others are only doubtful: forms, asides, and what has a class or id that names a region other than the
main text. Their blocks stay if the region holds an article, or if its kind of region holds far more decided
text than the rest of the page; regions of adverts, notices and readers' comments never outweigh their name.
The first pass decides blocks by stop-word density, length and link
density; the second gives the ambiguous ones, as a rule short, the label of their nearest decided
neighbours. If a page marks articles, those with a fair share of its decided text are its main text;
there the mark speaks for ambiguous blocks, elsewhere the lack of it against all but long text. Without
an article of such a share, the text outside of them is judged as on a page without marks.
A heading that opens readers' comments ends the main text of its article or page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from deskloom.llm.common import col, pages

#: Blocks of at least so many characters can be decided by their stop words.
LONG = 70
#: Share of stop words from which a long block is main text.
STOP_DENSITY = 0.25
#: Share of characters inside links from which a block is no main text.
LINK_DENSITY = 0.5

#: With fewer stop words than this, a block is no main text from a lower link density.
FEW_STOP = 0.1
FEW_STOP_LINKS = 0.2
#: Share of the largest part's decided text from which an article, or the text outside of any, is main text.
SHARE = 0.25
#: A kind of doubtful region is main text from so many times the decided text outside of such regions.
OUTWEIGH = 4
#: Outside of such parts, decided blocks are main text from so many characters.
LONG_OUTSIDE = 2 * LONG

# Frequent function words of the languages served.
STOP_WORDS = frozenset(
    "a an and are as at be been but by for from has have he her his i in is it its not of on or she that the their they this "
    "to was we were which will with you "
    "aber als am auch auf aus bei das dem den der des die ein eine einer es für im ist mit nach nicht sich sie sind und von war wie zu "
    "au aux avec ce dans de du elle en est et il la le les mais ne nous ont ou par pas plus pour que qui se son sont sur un une "
    "al como con del el ella esta este las lo los más no o para pero por se sin su una y".split()
)
# Element names.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_NEVER = frozenset(
    "button dialog footer head iframe menu nav noscript object option script select style svg template textarea title".split()
)
# Elements that a region left out cannot go on past, if it is never closed.
_ENDS = frozenset("article blockquote body footer h1 h2 h3 h4 h5 h6 header main p section table".split())
_ARTICLE = frozenset(("article", "main"))
_NEVER_ROLE = frozenset("alert alertdialog banner contentinfo dialog menu menubar navigation search".split())
#: Doubtful regions by element and by role.
_DOUBTFUL = {"aside": "aside", "form": "form"}
_DOUBTFUL_ROLE = {"complementary": "aside", "form": "form"}
# Words of a class or id that name a region other than the main text.
_NEVER_NAME = frozenset(
    "ad ads advert advertisement adverts advertorial banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright "
    "disclaimer discussion disqus footer footnav gdpr hidden login masthead menu modal nav navbar navigation newsletter notice notification "
    "outbrain overlay pager pagination popup promo promoted promotion reactions recommended recommendations related replies reply respond "
    "share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola toolbar topbar widget widgets".split()
)
# Those of them that are no main text, however long.
_FIRM = frozenset(
    "ad ads advert advertisement adverts advertorial comment comments consent cookie cookies discussion disqus gdpr hidden outbrain promoted "
    "reactions replies reply respond sponsor sponsored taboola".split()
)
_SAFE = frozenset(("html", "body", "main"))
# Words of a class or id that tell what a page has or which state it is in, before and behind a region's name.
_STATE_BEFORE = frozenset("has have hide no not show toggle when with without".split())
_STATE_BEHIND = frozenset(
    "active closed collapsed disabled enabled expanded free inactive layout none off on open opened page shown visible".split()
)
#: Words before "hidden" that leave it its meaning; in others it stands for some screens, for print or for overflow.
_HIDDEN_BEFORE = frozenset("is js visually".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|title|svg|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
# Headings of readers' comments and labels of adverts in the languages served.
_COMMENTS = re.compile(
    r"\W*(\d+\s+)?(reader\s+|user\s+)?(comments?|kommentare?|leserkommentare|commentaires?|comentarios?|leave a (reply|comment)|"
    r"join the (discussion|conversation))\s*(\(?\d+\)?)?\W*", re.I)
_ADVERT = re.compile(r"\W*(advertisement|advertorial|sponsored|anzeige|werbung|publicité|publicidad)(\s+content)?\s*([:|–—-]\s.*|\W*)", re.I | re.S)
_RIGHTS = re.compile(r"^\s*(©|\(c\)\s|copyright\b)", re.I)


class Block(NamedTuple):
    text: str
    linked: int  # characters inside links
    article: int  # 0 outside of any
    region: int = 0  # the innermost doubtful one, 0 outside of any


def _named(token: str, head_only: bool) -> str | None:
    """The region other than the main text that a class or id names, if any; with ``head_only``, by its first word."""
    parts = [part.lower() for part in _NAME_PART.findall(token)]
    if not parts or (len(parts) > 1 and parts[-1] in _STATE_BEHIND):
        return None
    if "hidden" in parts:
        return "hidden" if parts[-1] == "hidden" and all(part in _HIDDEN_BEFORE for part in parts[:-1]) else None
    for part in parts[:1] if head_only else parts:
        if part in _STATE_BEFORE:
            return None
        if part in _NEVER_NAME:
            return part
    return None


def _judged(tag: str, attributes: str, inside: bool) -> tuple[bool, str | None]:
    """Whether an element's region is no main text, whatever it holds; and its kind, if it is doubtful."""
    if tag in _NEVER or (tag == "header" and not inside):
        return True, None
    kind = _DOUBTFUL.get(tag)
    if not attributes.strip():
        return False, kind
    values = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)} if tag not in ("html", "body") else {}
    if "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in values.get("style", "").replace(" ", "").lower():
        return True, None
    role = values.get("role", "").lower()
    if role in _NEVER_ROLE:
        return True, None
    if tag in _SAFE:
        return False, kind
    names = f"{values.get('class', '')} {values.get('id', '')}".split()
    kinds = [k for k in [kind, _DOUBTFUL_ROLE.get(role), *(_named(name, tag == "article") for name in names)] if k]
    return False, next((k for k in kinds if k in _FIRM), kinds[0] if kinds else None)


def _unclosed(html: str) -> set[int]:
    """Where elements begin that may be left out and are never closed."""
    still: dict[str, list[int]] = {}
    for token in _TOKEN.finditer(html):
        tag = (token[3] or "").lower()
        if tag in _NEVER or tag in _DOUBTFUL or tag == "header":
            if not token[2]:
                still.setdefault(tag, []).append(token.start())
            elif still.get(tag):
                still[tag].pop()
    return {at for places in still.values() for at in places}


def blocks(html: str) -> tuple[list[Block], list[frozenset[str]]]:
    """The candidate blocks of a page in order, white space collapsed and references decoded; and per
    doubtful region its kind and those of the regions around it, without such as hold an article."""
    found: list[Block] = []
    parts: dict[int, list[str]] = {}  # text of the open block by region
    linked: dict[int, int] = {}
    breaks = articles = current = 0
    stack: list[tuple[str, bool, bool]] = []  # open elements, whether their region is left out or doubtful
    opened: dict[str, int] = {}  # how many elements of a name are open
    loose: list[int] = []  # places in the stack of elements that are never closed
    around, kinds, holds = [0], [""], [0]  # per doubtful region: the next outer one, its kind, 1 for an article in it and 2 for a main
    region = left_out = links = inside = 0
    unclosed = _unclosed(html)

    def end_block() -> None:
        for own, pieces in parts.items():
            text = " ".join("".join(pieces).split())
            if text:
                found.append(Block(text, min(linked.get(own, 0), len(text)), current if inside else 0, own))
        parts.clear()
        linked.clear()

    def text_between(a: int, b: int) -> None:
        nonlocal breaks
        if a < b and not left_out:
            piece = unescape(html[a:b])
            parts.setdefault(region, []).append(piece)
            bare = len(" ".join(piece.split()))
            if bare:
                breaks = 0
            linked[region] = linked.get(region, 0) + bare * bool(links)

    def close(at: int) -> None:
        nonlocal left_out, links, inside, region
        while len(stack) > at:
            tag, out, doubtful = stack.pop()
            opened[tag] -= 1
            left_out -= out
            if doubtful:
                region = around[region]
            links -= tag == "a"
            inside -= tag in _ARTICLE
        while loose and loose[-1] >= at:
            loose.pop()

    position = 0
    for token in _TOKEN.finditer(html):
        text_between(position, token.start())
        position = token.end()
        tag = (token[3] or "").lower()
        if not tag:
            continue
        if tag in _BLOCK:
            end_block()
        if tag == "br":
            breaks += 1
            parts.setdefault(region, []).append(" ")
            if breaks == 2:
                end_block()
        elif token[2]:
            if opened.get(tag):
                at = len(stack) - 1
                while stack[at][0] != tag:
                    at -= 1
                close(at)
        elif tag not in _VOID:
            if loose and tag in _ENDS:
                close(loose[0])
            if tag in ("p", "li", "a", "option") and stack and stack[-1][0] == tag:
                close(len(stack) - 1)
            if token[4].rstrip().endswith("/"):
                continue
            out, kind = _judged(tag, token[4], bool(inside))
            if kind:
                around.append(region)
                kinds.append(kind)
                holds.append(0)
                region = len(kinds) - 1
            elif tag in _ARTICLE and not out and not left_out:
                mark, at = 1 + (tag == "main"), region
                while at and not holds[at] & mark:
                    holds[at] |= mark
                    at = around[at]
            if tag in _ARTICLE:
                articles += not inside
                current = articles
                inside += 1
            if token.start() in unclosed:
                loose.append(len(stack))
            stack.append((tag, out, bool(kind)))
            opened[tag] = opened.get(tag, 0) + 1
            left_out += out
            links += tag == "a"
    text_between(position, len(html))
    end_block()
    doubts = [frozenset()]
    for outer, kind, held in zip(around[1:], kinds[1:], holds[1:]):
        # Asides hold teasers that are marked as articles.
        doubts.append(doubts[outer] if held & 2 or (held and kind != "aside") or kind in doubts[outer] else doubts[outer] | {kind})
    return found, doubts


def _outweighing(found: list[Block], labels: list[bool | None], doubts: list[frozenset[str]]) -> frozenset[str]:
    """The kinds of doubtful regions that are main text, as little other text is decided to be that.

    Without any decided text, long blocks without links stand for it.
    """
    for weigh in (lambda b, own: own, lambda b, own: own is None and len(b.text) >= LONG and not b.linked):
        size: dict[frozenset[str], int] = {}
        for b, own in zip(found, labels):
            if weigh(b, own):
                size[doubts[b.region]] = size.get(doubts[b.region], 0) + len(b.text)
        if size:
            break
    spared: frozenset[str] = frozenset()
    while True:
        outside = sum(n for kinds, n in size.items() if kinds <= spared)
        others = [(n, sorted(kinds)) for kinds, n in size.items() if not kinds <= spared and not kinds & _FIRM]
        most, kinds = max(others, default=(0, []))
        if not others or most < OUTWEIGH * outside:
            return spared
        spared |= frozenset(kinds)


def _before_comments(found: list[Block], labels: list[bool | None]) -> list[bool]:
    """Whether blocks come before the heading of readers' comments, if main text does, in their article or outside of any."""
    told: set[int] = set()
    over: set[int] = set()
    out = []
    for b, own in zip(found, labels):
        if own:
            told.add(b.article)
        elif b.article in told and len(b.text) < LONG and _COMMENTS.fullmatch(b.text):
            over.add(b.article)
        out.append(b.article not in over)
    return out


def decided(block: Block) -> bool | None:
    """First pass: main text or not, or None where a block alone does not tell."""
    if block.linked > LINK_DENSITY * len(block.text) or _RIGHTS.match(block.text) or _ADVERT.fullmatch(block.text):
        return False
    words = [w.strip(".,;:!?\"'()").lower() for w in block.text.split()]
    stops = sum(w in STOP_WORDS for w in words)
    if block.linked > FEW_STOP_LINKS * len(block.text) and stops < FEW_STOP * len(words):
        return False
    if len(block.text) >= LONG and stops >= STOP_DENSITY * len(words):
        return True
    return None


def _inherited(labels: list[bool | None]) -> list[bool]:
    """Second pass: the nearest decided neighbour's label, on a tie main text; without any, main text."""
    n = len(labels)
    before, after = [n + 1] * n, [n + 1] * n
    for order, away in ((range(n), before), (range(n - 1, -1, -1), after)):
        last = None
        for i in order:
            if labels[i] is not None:
                last = i
            if last is not None:
                away[i] = abs(i - last)
    out = []
    for i, own in enumerate(labels):
        if own is None:
            near = [labels[i - before[i]]] if before[i] < after[i] else [labels[i + after[i]]] if after[i] < before[i] else []
            own = near[0] if near else before[i] > n or bool(labels[i - before[i]] or labels[i + after[i]])
        out.append(own)
    return out


def _marked(labels: list[bool | None]) -> list[bool]:
    """Second pass in a chosen article: ambiguous blocks are main text, unless there is other main text
    and all of their nearest decided neighbours, before and behind, are none."""
    if True not in labels:
        return [own is not False for own in labels]
    sides = []
    for step in (1, -1):
        last, side = None, []
        for own in labels[::step]:
            last = last if own is None else own
            side.append(last)
        sides.append(side[::step])
    return [own if own is not None else bool(before or after) for own, before, after in zip(labels, *sides)]


def _chosen(found: list[Block], labels: list[bool | None]) -> set[int]:
    """The articles, and 0 for the text outside of any, with a fair share of the decided text.

    Without any decided text, long blocks stand for it, and without these the marks alone count.
    """
    for weigh in (lambda b, own: own, lambda b, own: own is None and len(b.text) >= LONG):
        size: dict[int, int] = {}
        for b, own in zip(found, labels):
            size[b.article] = size.get(b.article, 0) + len(b.text) * bool(weigh(b, own))
        if any(size.values()):
            return {part for part, n in size.items() if n >= SHARE * max(size.values())}
    return {b.article for b in found if b.article} or {0}


def main_text(html: str | None) -> str:
    """The main text of a page, its blocks joined by line feeds; empty if there is none."""
    found, doubts = blocks(html or "")
    labels = [decided(b) for b in found]
    spared = _outweighing(found, labels, doubts)
    stay = [a and doubts[b.region] <= spared for a, b in zip(_before_comments(found, labels), found)]
    found, labels = [b for b, own in zip(found, stay) if own], [label for label, own in zip(labels, stay) if own]
    chosen = _chosen(found, labels)
    keep = [bool(own) and len(b.text) >= LONG_OUTSIDE for b, own in zip(found, labels)]
    for part in chosen:
        at = [i for i, b in enumerate(found) if b.article == part]
        for i, own in zip(at, (_marked if part else _inherited)([labels[i] for i in at])):
            # In an article, a long block without links needs no neighbours.
            keep[i] = own or bool(part and labels[i] is None and len(found[i].text) >= LONG and not found[i].linked)
    return "\n".join(b.text for b, own in zip(found, keep) if own)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py()) for h in batch.column("html")]
        yield pa.record_batch([
            batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
        ], names=["page_id", "url", "text", "n_chars"])


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: ``page_id, url, text, n_chars``.

    A null page counts as empty and has the empty text; null ids and urls stay null; repeated rows
    are extracted each. An empty table gives an empty result. Other columns are ignored. Every page
    is one row of one task, so there is no shuffle; the work on a page grows with its length, however
    deep its elements nest and whether they are closed or not.
    """
    kinds = [df.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    rows = df.select(col(id_col).alias("page_id"), col(url_col).alias("url"), col(html_col).alias("html"))
    return rows.mapInArrow(partial(_extracted), f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")


def op2_html_text(spark, sf_dir):
    return extract(pages(spark, sf_dir))
