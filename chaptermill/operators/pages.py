"""Operators on HTML pages: siblings, chapters, removal of contents, texts of elements.

Pages are cut into top-level siblings by one pass of a tolerant tokenizer: void elements
never open, a block start closes an open paragraph (one that holds nothing yet is dropped),
script and style hold raw text, an end tag without its start is dropped. A null page gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .contents import fold_page

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
RAW = ("script", "style", "textarea", "title")

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S)
_WRAPPERS = frozenset(("html", "body"))


def siblings(page: str) -> list[tuple[str, str]]:
    """(tag, markup) of the top-level siblings in order; text between them has tag "". Outer html and body don't count as levels; a head is dropped."""
    out: list[tuple[str, str]] = []
    stack: list[str] = []
    begin = at = 0
    skip_head = False

    def flush(end: int) -> None:
        nonlocal begin
        if page[begin:end].strip():
            out.append(("", page[begin:end]))
        begin = end

    while True:
        m = _TOKEN.search(page, at)
        if not m:
            break
        at = m.end()
        name = (m.group(2) or "").lower()
        closing = m.group(1) == "/"
        if not name or name in _WRAPPERS:
            if not stack and not skip_head:
                flush(m.start())
                begin = m.end()
            continue
        if name == "head":
            skip_head = not closing
            begin = m.end()
            continue
        if skip_head:
            continue
        if closing:
            if name in stack:
                while stack.pop() != name:
                    pass
                if not stack:
                    out.append((tag, page[begin : m.end()]))
                    begin = m.end()
            elif not stack:
                flush(m.start())
                begin = m.end()
            continue
        if name in BLOCK and "p" in stack:
            while stack.pop() != "p":
                pass
            if not stack:
                if page[begin : m.start()].rpartition(">")[2].strip() or page.count("<", begin, m.start()) > 1:
                    out.append((tag, page[begin : m.start()] + "</p>"))
                begin = m.start()
        if not stack:
            flush(m.start())
            begin = m.start()
            tag = name
        if name in VOID or m.group(3).endswith("/"):
            if not stack:
                out.append((name, m.group()))
                begin = m.end()
            continue
        stack.append(name)
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.start() if end else len(page)
    if stack:
        out.append((tag, page[begin:]))
    elif not skip_head:
        flush(len(page))
    return out


def sibling_rows(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos from 0, tag, html) of the top-level siblings of each page. A narrow stage."""
    rows = df.select(F.col(key).alias("k"), F.col(html).alias("h")).filter("h is not null")
    kind = rows.schema["k"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [(k, i, *s) for k, h in zip(part["k"], part["h"], strict=True) for i, s in enumerate(siblings(h))]
            yield pd.DataFrame(found, columns=["k", "pos", "tag", "html"])

    return rows.mapInPandas(run, f"k {kind}, pos int, tag string, html string").withColumnRenamed("k", key)


def _inside(markup: str) -> str:
    """What stands between the tags of an element."""
    return re.sub(r"</[A-Za-z][^<>]*>\Z", "", markup[_TOKEN.match(markup).end() :])


def split_at(page: str, tag: str = "h1") -> list[str]:
    """Parts of a page from each element `tag` up to the next one among its own parent's children, in the order of the elements.

    What stands before the first one of a parent is dropped. A part of an outer `tag` holds the elements nested in it whole, those that begin parts too.
    """
    start = re.compile(rf"<{tag}\b", re.I)
    parts: list[list[str]] = []
    levels: list[tuple[Iterator[tuple[str, str]], list[str] | None]] = [(iter(siblings(page)), None)]
    while levels:
        rest, part = levels.pop()
        for name, text in rest:
            if name == tag:
                part = [text]
                parts.append(part)
            elif part is not None:
                part.append(text)
            if name and name not in RAW and start.search(text, 1):
                levels += [(rest, part), (iter(siblings(_inside(text))), None)]
                break
    return ["".join(p) for p in parts]


def chapters(df: DataFrame, key: str, html: str, tag: str = "h1", only: int | None = None) -> DataFrame:
    """(key, chapter_no from 1, html) of the chapters of each page; only: keep that chapter of pages which have it. A narrow stage."""
    rows = df.select(F.col(key).alias("k"), F.col(html).alias("h")).filter("h is not null")
    kind = rows.schema["k"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [(k, i, c) for k, h in zip(part["k"], part["h"], strict=True) for i, c in enumerate(split_at(h, tag), 1) if only is None or i == only]
            yield pd.DataFrame(found, columns=["k", "chapter_no", "html"])

    return rows.mapInPandas(run, f"k {kind}, chapter_no int, html string").withColumnRenamed("k", key)


def without_chapters(df: DataFrame, key: str, html: str, tag: str = "h1") -> DataFrame:
    """Pages of which no chapter comes out, whole."""
    return df.join(chapters(df, key, html, tag).select(key).distinct(), key, "left_anti")


_LINK = "#__RefHeading"
_ENTRY = re.compile(r"\A\d+(\.\d+)*\s+.*\s+\d+\Z", re.S)
_TAGS = re.compile(r"<[^<>]*>")
_PARAGRAPH = re.compile(r"<p\b[^>]*>.*?(?:</p>|(?=<p\b)|\Z)", re.S | re.I)


def contents_removed(page: str, word: str = "СОДЕРЖАНИЕ") -> str:
    """The page without its table of contents, inside <html><body>.

    First the paragraphs from the first one that holds `word` on, as long as they hold links
    to headings; other elements between stay, and nothing goes if the first one has no such
    link. Then any other paragraph of entries: a number, a text and a page, or two links.
    """
    out: list[str] = []
    state = "before"
    for tag, text in siblings(page):
        if tag == "p":
            plain = _TAGS.sub("", text).strip()
            n_links = text.count(_LINK)
            if state == "before" and word in plain:
                state = "in"
            if state == "in":
                if n_links:
                    continue
                state = "after"
            if n_links and (_ENTRY.match(plain) or n_links >= 2):
                continue
        elif tag and _LINK in text:
            text = _PARAGRAPH.sub(lambda m: "" if m.group().count(_LINK) >= 2 or _LINK in m.group() and _ENTRY.match(_TAGS.sub("", m.group()).strip()) else m.group(), text)
        out.append(text)
    return "<html><body>" + "".join(out) + "</body></html>"


def without_contents(df: DataFrame, key: str, html: str, toc: str | None = None) -> DataFrame:
    """(key, html) of pages without their tables of contents; a null page stays null.

    toc: array of (level, number, title) by which the anchors of a page are folded into headings before, in the same pass.
    """
    rows = df.select(F.col(key).alias("k"), F.col(html).alias("h"), *([F.col(toc).alias("t")] if toc else []))
    kind = rows.schema["k"].dataType.simpleString()

    def one(page: str, entries) -> str:
        return contents_removed(page if entries is None else fold_page(page, [(e["level"], e["number"], e["title"]) for e in entries]))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            entries = part["t"] if toc else [None] * len(part)
            yield pd.DataFrame({"k": part["k"], "h": [None if h is None else one(h, e) for h, e in zip(part["h"], entries, strict=True)]})

    return rows.mapInPandas(run, f"k {kind}, h string").withColumnsRenamed({"k": key, "h": html})


# Texts of elements, in the JVM.


def heading_texts(html: Column) -> Column:
    """Texts of the headings h1 to h6, blank ones included."""
    return F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<h[1-6]\b[^>]*>(.*?)</h[1-6]\s*>"), F.lit(1)), lambda x: T.strip(T.plain(x)))


def code_texts(html: Column) -> Column:
    """Texts of pre and of code elements; code inside pre counts twice."""
    of = lambda tag: F.transform(F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>"), F.lit(1)), lambda x: T.strip(T.plain(x)))
    return F.concat(of("pre"), of("code"))


def completeness(html: Column, markdown: Column, headers: float = 0.2, code: float = 0.3, code_size: int = 10) -> Column:
    """(n_headers, lost_headers, n_code, lost_code, incomplete): texts of the page that don't stand in the answer.

    Incomplete if more than the given shares are lost. Blank texts count in the total but are
    never lost; code of up to code_size characters is never lost. Unknown (null) if either is null.
    """

    def of(texts: Column) -> Column:
        h, c = texts["h"], texts["c"]
        lost_h = F.size(F.filter(h, lambda x: (x != "") & ~F.contains(markdown, x)))
        lost_c = F.size(F.filter(c, lambda x: (F.length(x) > code_size) & ~F.contains(markdown, x)))
        counts = F.struct(F.size(h).alias("n_headers"), lost_h.alias("lost_headers"), F.size(c).alias("n_code"), lost_c.alias("lost_code"))
        share = lambda n, lost, all_: n[lost] / F.greatest(n[all_], F.lit(1))
        judged = lambda n: F.struct(*(n[k].alias(k) for k in ("n_headers", "lost_headers", "n_code", "lost_code")), ((share(n, "lost_headers", "n_headers") > headers) | (share(n, "lost_code", "n_code") > code)).alias("incomplete"))
        return T.bound(counts, judged)

    return F.when(html.isNotNull() & markdown.isNotNull(), T.bound(F.struct(heading_texts(html).alias("h"), code_texts(html).alias("c")), of))


_HEADING = re.compile(r"<h[1-6]\b[^>]*>(.*?)</h[1-6]\s*>", re.I | re.S | re.A)
_CODE = tuple(re.compile(rf"<{tag}\b[^>]*>(.*?)</{tag}\s*>", re.I | re.S | re.A) for tag in ("pre", "code"))
_MARKUP = re.compile(r"<!--.*?-->|<[^<>]*>", re.S)


def complete(page: str, markdown: str, headers: float = 0.2, code: float = 0.3, code_size: int = 10) -> bool:
    """Whether completeness() calls an answer complete, row by row: for tasks that ask a model again."""

    def plain(text: str) -> str:
        text = _MARKUP.sub("", text)
        for entity, char in T.ENTITIES:
            text = text.replace(entity, char)
        return text.strip()

    heads = [plain(x) for x in _HEADING.findall(page)]
    codes = [plain(x) for pattern in _CODE for x in pattern.findall(page)]
    lost_heads = sum(x != "" and x not in markdown for x in heads)
    lost_codes = sum(len(x) > code_size and x not in markdown for x in codes)
    return lost_heads / max(len(heads), 1) <= headers and lost_codes / max(len(codes), 1) <= code
