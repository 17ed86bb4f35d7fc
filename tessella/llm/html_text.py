"""Main text of web pages by tag-path ratios.

Every text of a page hangs below a path of tags from the root. Per path, the mean text
length and the mean punctuation of its texts are set against the number of its texts;
both ratios are smoothed over similar paths, fused, and paths above a share of the
strongest one select the blocks to keep. Inside an article, names that only hold a mark
("related-work") leave it to the ratios whether the block belongs to the text.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import quoted

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.S)
SPACES = re.compile(r"[ \t\n\r\f\v   　]+")
PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？]")
MARK = re.compile(r"[a-z0-9]+")

# Elements whose content is never text of the page, and those that stand beside the article.
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object", "canvas")
BESIDE = (
    "nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "option", "input",
    "label", "fieldset", "datalist", "head",
)
ROLES = (
    "navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu",
    "menubar", "toolbar", "form", "note",
)
# Parts of class and id names that mark the same things.
MARKS = (
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "breadcrumb",
    "breadcrumbs", "comment", "comments", "commentlist", "disqus", "respond", "consent", "cookie", "cookies", "gdpr",
    "footer", "foot", "header", "masthead", "menu", "nav", "navbar", "navigation", "newsletter", "subscribe",
    "notice", "popup", "modal", "overlay", "pager", "pagination", "promo", "promoted", "promotion", "related",
    "recommended", "share", "sharing", "social", "sidebar", "skip", "sponsor", "sponsored", "toolbar", "widget",
    "login", "signup",
)
# Marks that are doubtful inside an article when they are only part of a longer name, as in
# "entry-header" or "related-work": there the ratios decide.
DOUBTFUL = (
    "banner", "foot", "footer", "header", "label", "masthead", "notice", "overlay", "promoted", "promotion", "related",
    "recommended", "share", "sharing", "skip", "social", "toolbar", "widget",
)
# A header inside the article belongs to it, and so do notes that its text carries.
MAIN = ("article", "main")
VOID = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
)
BLOCKS = (
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header",
    "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td",
    "tfoot", "th", "thead", "tr", "ul",
)
# A start tag in the second column ends open elements of the first, up to the third.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
CLOSES_P = frozenset(BLOCKS) - {"body", "html", "head", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "summary", "figcaption"}
_RAW, _BESIDE, _MARKS, _VOID, _BLOCKS, _ROLES = map(frozenset, (RAW, BESIDE, MARKS, VOID, BLOCKS, ROLES))
_DOUBTFUL = frozenset(DOUBTFUL)
_HEADED = frozenset(f"h{n}{mark}" for n in range(1, 7) for mark in ("", "?"))

SHARE = 0.05
# Doubtful blocks need this share of the strongest ratio.
DOUBT = 0.5
DOUBTED, OUT = 1, 2
INLINE = {"b", "i", "em", "strong", "a", "span", "u", "s", "small", "sub", "sup", "code", "mark", "font", "q", "cite", "abbr", "time", "kbd", "var", "br", "wbr", "img", "del", "ins", "big", "tt", "label"}


@dataclass
class Block:
    path: tuple[str, ...]
    beside: int
    article: bool
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def text(self) -> str:
        return SPACES.sub(" ", "".join(self.parts)).strip(" ")


def is_beside(tag: str, attributes: str, in_article: bool, in_text: bool = False) -> int:
    """0, DOUBTED or OUT; ``in_text``: inside an article element, where doubts are possible."""
    if tag in _BESIDE and not (tag == "header" and in_article):
        return OUT
    if not attributes:
        return 0
    level = 0
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id") and tag not in ("body", "html", *MAIN):
            for token in value.split():
                marks = _MARKS.intersection(MARK.findall(token))
                if not marks:
                    continue
                doubtful = in_text and tag not in INLINE and token not in marks and marks <= _DOUBTFUL
                if not doubtful:
                    return OUT
                level = DOUBTED
        elif name == "role" and value in _ROLES or name == "aria-hidden" and value == "true":
            return OUT
        elif name == "style" and "display:none" in value.replace(" ", ""):
            return OUT
    return OUT if re.search(r"(?:^|\s)hidden(?:\s|$)", attributes) else level


def blocks_of(page: str) -> list[Block]:
    """Blocks of text in page order, with the tag path of each."""
    stack: list[tuple[str, int, bool]] = []  # tag, beside, in the article
    out: list[Block] = []
    current: Block | None = None
    position, end = 0, len(page)

    def add(raw: str) -> None:
        nonlocal current
        if not raw:
            return
        holder = next((e for e in reversed(stack) if e[0] not in INLINE), ("", 0, False))
        if stack and stack[-1][1] == OUT and holder[1] != OUT:
            return  # an inline element beside the text of its block
        if current is None:
            path = tuple(t + "?" * (level == DOUBTED) for t, level, _ in stack if t not in INLINE)
            current = Block(path, holder[1], holder[2])
            out.append(current)
        text = html.unescape(raw)
        current.parts.append(text)
        if any(t == "a" for t, *_ in stack):
            current.linked += len(text.strip())

    def close(at: int) -> None:
        nonlocal current
        if any(t not in INLINE for t, *_ in stack[at:]):
            current = None
        del stack[at:]

    while position < end:
        found = TOKEN.search(page, position)
        if not found:
            add(page[position:])
            break
        add(page[position : found.start()])
        position = found.end()
        closing, tag, attributes = found.group(1), (found.group(2) or "").lower(), found.group(3) or ""
        if not tag:
            if found.group(0).startswith("<![CDATA["):
                add(html.escape(found.group(0)[9:].removesuffix("]]>")))
            continue
        if closing:
            for at in range(len(stack) - 1, -1, -1):
                if stack[at][0] == tag:
                    close(at)
                    break
            else:
                if tag in _BLOCKS:
                    current = None
            continue
        if tag in _RAW:
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, position)
            if stop:
                position = stop.end()
                continue
            if tag in ("script", "style", "textarea", "title"):
                break  # never closed: the rest is raw
            continue
        if tag in CLOSES_P:
            for at in range(len(stack) - 1, -1, -1):
                if stack[at][0] == "p":
                    close(at)
                    break
                if stack[at][0] in _BLOCKS:
                    break
            current = None
        elif tag in _BLOCKS:
            current = None
        if tag in IMPLIED:
            ended, limits = IMPLIED[tag]
            for at in range(len(stack) - 1, -1, -1):
                if stack[at][0] in limits:
                    break
                if stack[at][0] in ended:
                    close(at)
                    if tag not in ("tr",):
                        break
        elif tag == "body":
            close(next((i for i, (t, *_) in enumerate(stack) if t == "head"), len(stack)))
        if tag in _VOID:
            if tag in ("br", "hr", "wbr", "img") and current is not None:
                current.parts.append("" if tag == "wbr" else " ")
            if tag == "hr":
                current = None
            continue
        if attributes.rstrip().endswith("/") and tag not in _BLOCKS and tag not in INLINE:
            continue
        beside, article = (stack[-1][1], stack[-1][2]) if stack else (0, False)
        article = article or tag in MAIN
        in_text = article and "=" in attributes and any(t == "article" for t, *_ in stack)
        stack.append((tag, max(beside, is_beside(tag, attributes, article, in_text)), article))
    return out


def similarity(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """How much of two paths is common from the root on, 0 to 1."""
    common = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        common += 1
    return common / max(len(a), len(b), 1)


def main_text(page: str | None, share: float = SHARE) -> str:
    """The article of a page; '' for NULL, empty pages and pages without text."""
    if not page:
        return ""
    kept = [(b, t) for b in blocks_of(page) if b.beside != OUT and (t := b.text())]
    if any(b.article for b, _ in kept):
        kept = [(b, t) for b, t in kept if b.article]
    sums: dict[tuple[str, ...], list[float]] = {}
    for block, text in kept:
        entry = sums.setdefault(block.path, [0, 0.0, 0.0])
        entry[0] += 1
        entry[1] += max(len(text) - block.linked, 0)
        entry[2] += len(PUNCTUATION.findall(text))
    if not sums:
        return ""
    ratios = {path: (length / n, marks / n) for path, (n, length, marks) in sums.items()}
    scores = {}
    for path in ratios:
        weights = {other: math.exp(-((1 - similarity(path, other)) ** 2) / 0.125) for other in ratios}
        total = sum(weights.values())
        length, marks = (
            sum(w * ratios[other][i] for other, w in weights.items()) / total for i in (0, 1)
        )
        scores[path] = length * (1 + marks)
    best = max(scores.values())

    def stays(block: Block) -> bool:
        if block.article and _HEADED.intersection(block.path):
            return True  # titles are short, whatever their path
        if block.beside == DOUBTED:
            return scores[block.path] >= max(DOUBT, share) * best
        return scores[block.path] >= share * best

    return "\n".join(text for block, text in kept if stays(block))


def extract_pages(
    df: DataFrame,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
) -> DataFrame:
    """One row per page: id, url, text, n_chars.

    A NULL or empty page has an empty text. Ids and urls, NULL ones too, are passed on.
    Repeated pages give repeated rows; other columns are not read; an empty table stays
    empty. Pages are read whole.
    """

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(main_text, na_action=None).astype(object)

    text = df.select(
        quoted(id_column).alias(id_column),
        quoted(url_column).alias(url_column),
        extract(quoted(html_column)).alias("text"),
    )
    return text.withColumn("n_chars", F.char_length("text").cast("long"))
