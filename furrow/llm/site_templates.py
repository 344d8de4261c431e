"""Main text of web pages by site template removal.

Each page is read once into its text blocks and, for each block, the hashes of the
element subtrees that hold it. Spark counts between how many different contents (the
page's other blocks) of a host a subtree stands, so copies of a page count once;
subtrees that stand between many are template, and the blocks inside them go. Menus,
headers, footers, sidebars, notices, scripts, adverts, forms and comments are left out by
tag or name while reading, on every host alike.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.session import broadcast_if_small, persist_reliably

# A subtree is template when it stands between so many different contents of the host, and between this share of the
# host's contents; so many are always enough, however many pages the host has.
LEAST_PAGES = 5
LEAST_SHARE = 0.1
ENOUGH_PAGES = 100

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.DOTALL
)
_RAW = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "xmp")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
# Elements whose text is never the article's, wherever they stand; all but the first line give way to an article or main element inside.
_NEVER = frozenset("head nav footer".split())
_NAMED = frozenset("form button select dialog menu search object video audio canvas map".split())
_NAMED_ROLES = frozenset("navigation contentinfo search form dialog menu menubar".split())
_GUESSED_ROLES = frozenset("banner complementary alert".split())
# Whole class or id words. Comments and adverts count everywhere, the others only outside articles.
_COMMENTS = re.compile(r"(?:(?:user|reader|page|post|article|blog)s?[-_])?comments?(?:[-_]?(?:list|area|section|block|box|body|content|form|thread|wrapper|container|\d+))?|(?:user[-_])?discussions?(?:[-_](?:list|area|section|thread))?|repl(?:y|ies)|respond|disqus(?:[-_]thread)?", re.IGNORECASE)
_ADVERTS = re.compile(r"(?:ads?|adverts?|advertisements?)(?:[-_](?:banner|block|box|container|label|slot|unit|wrapper|\d+))?|adsbygoogle|sponsored(?:[-_](?:content|links?|post))?", re.IGNORECASE)
_AROUND = r"(?:(?:site|page|main|top|bottom|left|right|primary|secondary|global|mobile)[-_])?(?:{})(?:[-_]?(?:bar|block|box|buttons?|container|inner|items?|links?|list|wrap|wrapper|\d+))?"
_MENUS = re.compile(_AROUND.format("menu|nav|navbar|navigation|breadcrumbs?|footer"), re.IGNORECASE)
_NAMES = re.compile(
    _AROUND.format(
        "advertising|sponsors?|promos?|promotions?|banner|cookies?|consent|gdpr|(?:cookies?|consent|gdpr|privacy)[-_](?:banner|consent|message|notice|popup)|notices?|notification|alert|popup|modal|overlay|sidebar|side|widget|header|masthead|share|sharing|social|related|(?:related|recommended)[-_](?:articles|posts|stories)|recommended|newsletter|subscribe|signup|login|search|pagination|pager|toolbar|skip"
    ),
    re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.IGNORECASE)
# Names that no article's own part bears count inside articles too; beside a name of the main part none of the others count.
_PLAIN = re.compile(
    _AROUND.format(r"sidebar|(?:cookies?|consent|gdpr|privacy)[-_](?:banner|consent|message|notice|popup)|newsletter(?:[-_](?:signup|form|box))?|share[-_](?:buttons?|bar|links?)|social[-_](?:share|sharing|links?|buttons?|bar)"), re.IGNORECASE
)
_STORY = re.compile(r"(?:main|page|post|entry|article|story)?[-_]?(?:content|story|text|body|entry|post)", re.IGNORECASE)
# A new one of these ends an open one.
_ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt tr figcaption".split())


# How surely an element is left out.
_KEPT, _GUESS, _RULE, _ALWAYS = range(4)


class _Element:
    __slots__ = ("tag", "above", "rule", "main", "parts", "blocks", "digest", "inside")

    def __init__(self, tag: str, above: _Element | None, rule: int, main: int):
        self.tag, self.above, self.rule, self.main = tag, above, rule, main
        self.parts: list[str] = [tag]
        self.blocks: list[int] = []
        self.digest: int | None = None
        self.inside = 0


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _signed(number: int) -> int:
    return (number + (1 << 63)) % (1 << 64) - (1 << 63)


@dataclass
class Page:
    """Blocks of a page's main part, each with its subtrees; the subtrees with the sum of the other blocks' hashes outside them; that sum for the whole page."""

    blocks: list[str]
    owners: list[list[int]]
    subtrees: set[tuple[int, int]]
    content: int


def _rule(tag: str, attributes: str, main: int) -> int:
    """How surely an element is left out by its own tag and attributes."""
    if tag in _NEVER:
        return _ALWAYS
    rule = _RULE if tag in _NAMED else _GUESS if main < 2 and tag in ("header", "aside") else _KEPT
    if not attributes or tag in ("html", "body"):
        return rule
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").strip()
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            rule = max(rule, _RULE)
        elif name == "role":
            rule = max(rule, _RULE if value.lower() in _NAMED_ROLES else _GUESS if main < 2 and value.lower() in _GUESSED_ROLES else _KEPT)
        # The id of a heading or paragraph is an anchor.
        elif name == "class" or (name == "id" and tag not in _LEAVES):
            words = value.split()
            story = any(_STORY.fullmatch(w) for w in words)
            for word in words:
                if _COMMENTS.fullmatch(word):
                    return _ALWAYS
                if tag in ("article", "main"):
                    continue
                if _ADVERTS.fullmatch(word) or (main < 2 and _MENUS.fullmatch(word)):
                    rule = max(rule, _RULE)
                elif not story and (_NAMES.fullmatch(word) if main < 2 else _PLAIN.fullmatch(word)):
                    rule = max(rule, _GUESS)
    return rule


def read_page(html: str) -> list[tuple[str, list[int]]]:
    """Blocks of the page's main part in order, each with the hashes of the subtrees that may be template."""
    page = parse_page(html)
    return list(zip(page.blocks, page.owners))


def _after_inline(html: str, at: int, tag: str, unbalanced: set[str]) -> int:
    """Place after the end of an inline element that begins before `at`; elements of its name inside it count.

    Where ends are missing, the first end tag is taken, and from then on for this tag.
    """
    depth, first = 1, None
    for mark in re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])[^>]*>", re.IGNORECASE).finditer(html, at):
        depth += -1 if mark.group(1) else 1
        if mark.group(1) and first is None:
            first = mark.end()
        if depth == 0 or (first and tag in unbalanced):
            return mark.end()
    unbalanced.add(tag)
    return first or at


def parse_page(html: str) -> Page:
    unbalanced: set[str] = set()
    stack = [_Element("", None, _KEPT, 0)]
    elements = [stack[0]]
    blocks: list[tuple[str, _Element]] = []
    owners: list[list[int]] = []
    text: list[str] = []

    def flush() -> None:
        if not text:
            return
        block = " ".join(unescape("".join(text)).split())
        text.clear()
        if block:
            top = stack[-1]
            top.parts.append(block)
            top.blocks.append(len(blocks))
            blocks.append((block, top))
            owners.append([])

    def close() -> None:
        flush()
        done = stack.pop()
        if done.blocks:
            digest = _hash("\x00".join(done.parts))
            # Inside an article its own paragraphs are never template, only what is put between them.
            if done.tag not in ("html", "body", "article", "main") and not (done.main >= 2 and done.tag in _LEAVES):
                done.digest = digest
                for b in done.blocks:
                    owners[b].append(digest)
            stack[-1].parts.append(str(digest))
            stack[-1].blocks.extend(done.blocks)

    at = 0
    while at < len(html):
        found = _TAG.search(html, at)
        end = found.start() if found else len(html)
        if end > at and stack[-1].rule < _ALWAYS:
            text.append(html[at:end])
        if not found:
            break
        at = found.end()
        closing, tag, attributes = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            if tag not in _BLOCKS:
                continue
            place = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if place:
                while len(stack) > place:
                    close()
            else:
                flush()
            continue
        if tag in _RAW:
            over = _RAW[tag].search(html, at)
            at = over.end() if over else len(html)
            if tag not in _BLOCKS and stack[-1].rule < _ALWAYS:
                text.append(" ")
            continue
        if tag == "br" and stack[-1].rule < _ALWAYS:
            text.append(" ")
        if tag not in _BLOCKS and stack[-1].rule < _ALWAYS and tag not in _VOID and _rule(tag, attributes, stack[-1].main) > _GUESS:
            # An inline element that is left out: its text goes up to its end tag.
            at = _after_inline(html, at, tag, unbalanced)
            continue
        if tag not in _BLOCKS:
            continue
        flush()
        if tag in _VOID:
            continue
        if tag in _BLOCKS and stack[-1].tag == "p":
            close()
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in _ENDS.get(tag, ()):
                while len(stack) > i:
                    close()
                break
            if stack[i].tag not in _LEAVES:
                break
        top = stack[-1]
        main = top.main | (2 if tag == "article" else 1 if tag == "main" else 0)
        # What is left out for good passes this on; the rest is settled at the end.
        rule = _ALWAYS if top.rule == _ALWAYS else _rule(tag, attributes, top.main)
        if tag in ("article", "main") and rule == _KEPT:
            # Nothing around an article or main element is left out.
            for around in reversed(stack):
                if around.main and around.tag in ("article", "main"):
                    break
                around.rule = _KEPT
        stack.append(_Element(tag, top, rule, main))
        elements.append(stack[-1])
    while len(stack) > 1:
        close()
    flush()
    for element in elements[1:]:
        element.rule = max(element.rule, element.above.rule)
    # Beside a main element only articles are read; without one the whole body is.
    least = int(any(e.rule == _KEPT and e.main & 1 for _, e in blocks))
    chosen = [(b, e, o) for (b, e), o in zip(blocks, owners) if e.rule == _KEPT and e.main >= least]
    for block, element, _ in chosen:
        element.inside += _hash(block)
    for element in reversed(elements[1:]):
        element.above.inside += element.inside
    whole = stack[0].inside
    held = {o for _, _, own in chosen for o in own}
    subtrees = {(e.digest, _signed(whole - e.inside)) for e in elements if e.digest in held}
    return Page([b for b, _, _ in chosen], [o for _, _, o in chosen], subtrees, _signed(whole))


_SUBTREES = pa.list_(pa.struct([("subtree", pa.int64()), ("outside", pa.int64())]))
_READ = "page_id long, url string, host string, content long, blocks array<string>, owners array<array<long>>, subtrees array<struct<subtree:long,outside:long>>"
_HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, len(batch), 256):
            part = batch.slice(start, 256)
            columns: list[list] = [[] for _ in range(5)]
            for url, html in zip(part["url"].to_pylist(), part["html"].to_pylist()):
                host = _HOST.match(url or "")
                page = parse_page(html or "")
                subtrees = [{"subtree": s, "outside": o} for s, o in sorted(page.subtrees)]
                for column, value in zip(columns, (host.group(1).lower() if host else "", page.content, page.blocks, page.owners, subtrees)):
                    column.append(value)
            kinds = (pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.list_(pa.int64())), _SUBTREES)
            arrays = [part["page_id"], part["url"], *(pa.array(c, k) for c, k in zip(columns, kinds))]
            yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "host", "content", "blocks", "owners", "subtrees"])


def main_texts(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """page_id, url and text of every row of `pages` (page_id, url, html).

    The text holds the blocks of the page's main element and its articles (without a main
    element, of its whole body) outside menus, headers, footers, sidebars, notices, adverts,
    forms and comments and outside the host's template, each with its references decoded and white space as
    single spaces, joined by two line ends; it is empty if nothing is left. Paragraphs,
    headings and cells of an article are never template. Pages with equal
    blocks outside a subtree count once towards it, whatever else differs in them. A null
    html is empty; a null url or one without a host shares the host "". Repeated rows and
    null ids stay; other columns are left aside.
    """
    typed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    read = persist_reliably(typed.mapInArrow(_read, _READ).withColumn("row", F.monotonically_increasing_id()))
    hosts = read.select("host", "content").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    single = read.select("host", F.inline("subtrees")).distinct()
    counted = single.groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("times"))
    # Only subtrees between enough contents move on.
    least = F.least(F.col("pages") * least_share, F.lit(ENOUGH_PAGES))
    often = counted.filter(F.col("times") >= least_pages).join(hosts, "host").filter(F.col("times") >= least).select("host", "subtree")
    template = broadcast_if_small(often)
    held = read.select("row", "host", F.explode("subtrees.subtree").alias("subtree")).join(template, ["host", "subtree"])
    hits = broadcast_if_small(held.groupBy("row").agg(F.collect_set("subtree").alias("template")))
    found = F.coalesce("template", F.array().cast("array<long>"))
    left = F.filter(F.arrays_zip("blocks", "owners"), lambda b: ~F.arrays_overlap(b["owners"], found))
    return read.join(hits, "row", "left").select("page_id", "url", F.array_join(left["blocks"], "\n\n").alias("text"))
