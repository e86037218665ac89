"""Main-text extraction by line-block distribution.

Markup is stripped to lines: a block-level tag or a line break ends a line. Regions that markup itself
names as apart from the article (scripts, styles, menus, page headers and footers, sidebars,
notices, adverts, forms, reader comments) leave a stretch of empty lines. Over the line lengths a
window of ``WINDOW`` lines is summed; text begins where the sum surges and ends where it dives
to nothing. The borders of an article (or main) element are dives, too.

On every page the stretches between surge and dive choose the text: the article with most text in its stretches, or a
stretch outside of articles if it has more. All lines of the chosen container are kept, those before the surge and after later dives
included: of the article element, or else of the innermost section-like element that holds over half of the stretch. Outside
of articles other stretches that are at least half as long are kept as well. Only on pages too short for any window to reach ``SURGE``
lines outside of articles don't count where an article holds text.

Null and empty pages give the empty text, as do pages whose lines are all boilerplate. Malformed
markup is read as far as it goes: an unclosed element ends with its parent. Nothing between surge and dive is dropped.
"""

from __future__ import annotations

import re
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .tables import read

WINDOW = 3
#: Sum of a window from which text surges, unless the page's largest sum is under twice that.
SURGE = 80

_RAW = "script|style|noscript|template|svg|textarea|iframe|title|object|canvas|math|audio|video"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>",
    re.S | re.I,
)
_BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "label legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Start tags that end an open paragraph.
_AFTER_P = _BLOCK - frozenset("body br button caption frameset head html label legend optgroup option select tbody td tfoot th thead tr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_APART = frozenset("nav footer aside form head menu button select dialog fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Words of class and id values that name a region apart from the article.
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer disqus footer gdpr header login masthead menu "
    "modal nav navbar navigation newsletter notice notices overlay pagination popup promo promoted promotion related reply respond responses search share sharing sidebar signup skip social sponsor sponsored "
    "subscribe subscription toolbar topbar widget widgets".split()
)
#: Of these, what an article uses for its own parts; and what marks a whole article as none.
_OWN = frozenset("header banner masthead".split())
_OTHER = frozenset("ad ads advert advertisement comment comments promo promoted related reply respond sponsored teaser".split())
#: A class that only says whether something else is there.
_ABOUT = re.compile(r"^(has|with|no|without|show|hide|is|js)[-_]", re.I)
_ATTRS = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_HEADINGS = ("article", "main")
#: Elements that hold a text as a whole, besides the page itself.
_BOXES = frozenset("article body center div main section td th".split())


def _apart(tag: str, attrs: str, inside: bool) -> bool:
    """Whether an element's tag or attributes set it apart from the article."""
    if tag in _APART or (tag == "header" and not inside):
        return True
    if not attrs or tag in ("html", "body", "main"):
        return False
    names = _OTHER if tag == "article" else _NAMES - _OWN if inside else _NAMES
    for name, *values in _ATTRS.findall(attrs):
        name, value = name.lower(), "".join(values).lower()
        if name in ("class", "id"):
            for one in "".join(values).split():
                if not _ABOUT.match(one) and any(w in names for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", one).lower())):
                    return True
        elif name == "role":
            if value in _ROLES:
                return True
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            return True
    return False


def lines(html: str) -> tuple[list[tuple[str, int, int]], list[int]]:
    """(text, article, box) of each line, and the parent of each box.

    article is the box of the outermost article or main element that the line is in, 0 for none; box is the innermost container, 0 for
    the page. Boxes are numbered in their order. Stripped regions and the borders of articles stand as ``WINDOW`` empty lines.
    """
    out: list[tuple[str, int, int]] = []
    parents = [0]
    parts: list[str] = []
    stack: list[tuple[str, bool, bool, int]] = []  # tag, begins a stripped region, begins an article, the box around it
    skip, article, box, depth = 0, 0, 0, 0

    def gap() -> None:
        out.extend([("", article, box)] * WINDOW)

    def end() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((text, article, box))

    def close() -> str:
        """Ends the innermost element."""
        nonlocal skip, article, box, depth
        if stack[-1][0] in _BLOCK:
            end()
        tag, region, opens, box = stack.pop()
        if region:
            skip -= 1
            if not skip:
                gap()
        if opens:
            depth -= 1
            if not depth:
                article = 0
                gap()
        return tag

    at = 0
    for m in _TOKEN.finditer(html):
        if not skip and m.start() > at:
            parts.append(html[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in _BLOCK:
            end()
        if m[2]:
            if any(t == tag for t, *_ in reversed(stack)):
                while close() != tag:
                    pass
            continue
        if skip and tag in _AFTER_P:  # only stripped paragraphs are in the stack
            for t, *_ in reversed(stack):
                if t == "p":
                    while close() != "p":
                        pass
                    break
                if t in _BLOCK:
                    break
        if tag not in _VOID:
            region = _apart(tag, m[4], depth > 0)
            opens = tag in _HEADINGS and not skip and not region
            if tag != "p" or region:
                stack.append((tag, region, opens, box))
            if region:
                end()
                skip += 1
            elif not skip and tag in _BOXES:
                if opens and not depth:
                    gap()
                parents.append(box)
                box = len(parents) - 1
            if opens:
                depth += 1
                if depth == 1:
                    article = box
    if not skip and at < len(html):
        parts.append(html[at:])
    end()
    return out, parents


def _windows(size: list[int]) -> tuple[list[int], list[int], list[int]]:
    """The line lengths, their running totals and the sum of the window that begins at each line."""
    n = len(size)
    total = [0, *accumulate(size)]
    return size, total, [total[min(i + WINDOW, n)] - total[i] for i in range(n)]


def _first(size: list[int], i: int) -> int:
    """The first line from ``i`` on that isn't empty."""
    while not size[i]:
        i += 1
    return i


def _container(stretch: list[tuple[str, int, int]], parents: list[int]) -> int:
    """The innermost box that holds over half of the stretch's text."""
    inside = [0] * len(parents)
    for text, _, box in stretch:
        inside[box] += len(text)
    half = sum(inside) / 2
    for box in range(len(parents) - 1, 0, -1):  # those within a box come after it
        if inside[box] > half:
            return box
        inside[parents[box]] += inside[box]
    return 0


def extract(html: str | None) -> str:
    """The main text of a page, its blocks joined by line breaks."""
    if not html:
        return ""
    found, parents = lines(html)
    size, total, sums = _windows([len(t) for t, _, _ in found])
    if not any(sums):
        return ""
    if max(sums) < SURGE and any(t and a for t, a, _ in found):
        size, total, sums = _windows([len(t) if a else 0 for t, a, _ in found])
    n = len(size)
    surge = min(SURGE, (max(sums) + 1) // 2)
    stretches: list[tuple[int, int]] = []
    i = 0
    while i < n:
        if sums[i] < surge:
            i += 1
            continue
        while i > 0 and size[i - 1]:  # lines right before the surge belong to it
            i -= 1
        j = i
        while j < n and sums[j] > 0:
            j += 1
        stretches.append((i, j))
        i = j + 1
    # the text of each article's stretches and of each other stretch
    length: dict[tuple[int, int], int] = {}
    for i, j in stretches:
        article = found[_first(size, i)][1]
        key = (article, 0) if article else (0, i)
        length[key] = length.get(key, 0) + total[j] - total[i]
    article, begin = max(length, key=length.__getitem__)
    end = dict(stretches).get(begin, begin)
    home = article or _container(found[begin:end], parents)
    kept = [False] * len(parents)
    kept[home] = True
    for b in range(home + 1, len(parents)):
        kept[b] = kept[parents[b]]
    keep = [kept[b] for _, _, b in found]
    if not article:
        for i, j in stretches:
            if 2 * (total[j] - total[i]) >= length[article, begin]:
                keep[i:j] = [True] * (j - i)
    return "\n".join(t for (t, _, _), k in zip(found, keep, strict=True) if t and k)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every page."""

    def run(batches):
        for b in K.slices(batches, "html"):
            texts = [extract(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: the main text of every page."""
    return extract_pages(read(spark, sf_dir, "pages"))
