"""Tables of contents: parsing, numbering maps, and the fold of anchors into headings.

Null and blank texts are dropped by the parser; styles are compared with case. Repeated
rows stay repeated unless an operator says it makes them one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.skew import split_join


def paragraphs(df: DataFrame, text: str = "text") -> DataFrame:
    """df with text stripped, without rows whose text is null or blank."""
    return df.withColumn(text, T.strip(F.col(text))).filter(F.col(text) != "")


def contents_rows(df: DataFrame, style: str = "style") -> DataFrame:
    """Rows whose style begins with "toc"."""
    return df.filter(F.col(style).startswith("toc"))


def parsed_contents(df: DataFrame, style: str = "style", text: str = "text") -> DataFrame:
    """Rows of a table of contents with level (of the style), number and title (of the text); others are dropped.

    A page number after a tab is no part of the title. Columns of these names are replaced.
    """
    line = rf"\A(\d+(?:\.\d+)*)[{T.SPACE}]+([^\t]+)(?:\t\d+)?\n?\z"
    kept = contents_rows(paragraphs(df, text), style).withColumn("__level", F.regexp_extract(style, r"toc (\d+)", 1)).filter("__level <> ''")
    found = kept.filter(F.col(text).rlike(line))
    return (
        found.withColumn("level", F.col("__level").cast("int"))
        .withColumn("number", F.regexp_extract(text, line, 1))
        .withColumn("title", T.strip(F.regexp_extract(text, line, 2)))
        .drop("__level")
    )


def entries(paragraphs: Column) -> Column:
    """Array of (level, number, title) of the paragraphs (style, text) of one document, by the rules of parsed_contents()."""
    line = rf"\A(\d+(?:\.\d+)*)[{T.SPACE}]+([^\t]+)(?:\t\d+)?\n?\z"
    stripped = F.transform(F.filter(paragraphs, lambda p: p["style"].rlike(r"\Atoc.*\z") & p["style"].rlike(r"toc \d")), lambda p: F.struct(p["style"].alias("style"), T.strip(p["text"]).alias("text")))
    return F.transform(
        F.filter(stripped, lambda p: p["text"].rlike(line)),
        lambda p: F.struct(F.regexp_extract(p["style"], r"toc (\d+)", 1).cast("int").alias("level"), F.regexp_extract(p["text"], line, 1).alias("number"), T.strip(F.regexp_extract(p["text"], line, 2)).alias("title")),
    )


def numbering_map(df: DataFrame, group: str, pos: str = "pos", title: str = "title", number: str = "number") -> DataFrame:
    """(group, title, number, first_pos): of titles that occur again the first place and the last number.

    A partial aggregation, so a group of any size is no hot spot. Null titles are dropped.
    """
    return df.filter(F.col(title).isNotNull()).groupBy(group, title).agg(F.max_by(number, F.struct(pos, number)).alias(number), F.min(pos).alias("first_pos"))


ANCHOR = r'<a id="__RefHeading___\d+"></a>'


def folded(html: Column, toc: Column, drop_on_miss: bool = True) -> Column:
    """Markup whose anchors became headings, by the entries (level, number, title) of toc in order.

    The first anchor followed by an entry's title (tags and white space between, case ignored)
    becomes its heading; if there is none, the first anchor left is dropped unless
    drop_on_miss is false. In the end anchors that are left are dropped. An empty toc changes
    nothing. Time grows with the entries times the size, so fold chapters, not whole books.
    """

    def step(page: Column, entry: Column) -> Column:
        found = F.concat(F.lit(rf"(?iu:{ANCHOR}[{T.SPACE}]*(?:<[^>]+>[{T.SPACE}]*)*"), T.quoted_pattern(entry["title"]), F.lit(")"))
        heading = F.concat(F.lit("<h"), entry["level"].cast("string"), F.lit(">"), T.quoted_replacement(entry["number"]), F.lit(" "), T.quoted_replacement(entry["title"]), F.lit("</h"), entry["level"].cast("string"), F.lit(">"))
        missed = T.replace_first(page, F.lit(ANCHOR), F.lit("")) if drop_on_miss else page
        return F.when(F.regexp_like(page, found), T.replace_first(page, found, heading)).otherwise(missed)

    return F.when(F.size(toc) == 0, html).otherwise(F.regexp_replace(F.aggregate(toc, html, step), ANCHOR, ""))


_ANCHOR = re.compile(ANCHOR)
_SKIPPED = re.compile(r"\s*(?:<[^>]+>\s*)*")


def fold_page(page: str, entries: list[tuple[int, str, str]]) -> str:
    """folded() of one page by its entries (level, number, title), row by row.

    The page is cut at its anchors once; what follows each, without tags before it, is looked at by its beginning
    only, so the time is that of the page and of entries times anchors, not of entries times the page.
    """
    if not entries:
        return page
    segments = _ANCHOR.split(page)  # what stands before the first anchor, and what follows each
    before = list(range(-1, len(segments) - 1))
    after = [*range(1, len(segments)), 0]  # the anchors left as a chain; 0 stands for the page's beginning and end
    begins: dict[int, tuple[int, int]] = {}  # of an anchor: the segment and place where its text begins

    def begin(k: int) -> tuple[int, int]:
        if k not in begins:
            at = _SKIPPED.match(segments[k]).end()
            begins[k] = begin(after[k]) if at == len(segments[k]) and after[k] and not segments[k].rstrip().endswith("<") else (k, at)
        return begins[k]

    def drop(k: int, text: str) -> None:
        """Anchor k goes; text takes the place of what follows it, joined to what stands before."""
        left, right = before[k], after[k]
        segments[left] += text
        after[left], before[right] = right, left if right else before[right]
        begins.pop(k, None)
        while left > 0 and left in begins:  # what follows these begins elsewhere now, or did so by way of k
            begins.pop(left)
            left = before[left]

    for level, number, title in entries:
        wanted, size = title.lower(), len(title)
        k = after[0]
        while k:
            at = begin(k)
            if segments[at[0]][at[1] : at[1] + size].lower() == wanted:
                break
            k = after[k]
        if k:
            found, place = begin(k)
            rest = segments[found][place + size :]
            while after[k] and k != found:
                following = after[k]
                drop(k, "")
                k = following
            drop(k, f"<h{level}>{number} {title}</h{level}>{rest}")
        elif after[0]:
            drop(after[0], segments[after[0]])
    k = after[0]
    out = [segments[0]]
    while k:
        out.append(segments[k])
        k = after[k]
    return "".join(out)


def heading_levels(df: DataFrame, number: str = "number") -> DataFrame:
    """df with depth, the parts of its number."""
    return df.withColumn("depth", T.number_level(F.col(number)))


def numbered_depth(text: Column) -> Column:
    """Depth of the first pattern of numbered headings a text has, from 4 parts of a number down to 1 (then with a second, small letter); null if none."""
    return (
        F.when(text.rlike(rf"\A\d+\.\d+\.\d+\.\d+[{T.SPACE}]+[А-Я]"), 4)
        .when(text.rlike(rf"\A\d+\.\d+\.\d+[{T.SPACE}]+[А-Я]"), 3)
        .when(text.rlike(rf"\A\d+\.\d+[{T.SPACE}]+[А-Я]"), 2)
        .when(text.rlike(rf"\A\d+[{T.SPACE}]+[А-Я][а-я]"), 1)
    )


def begins_content(text: Column) -> Column:
    """Whether a paragraph begins the content proper: a first-level number and a Russian capital."""
    return text.startswith("1 Общие сведения") | text.rlike(rf"\A\d+[{T.SPACE}]+[А-Я]")


def numbered_russian(text: Column) -> Column:
    return text.rlike(rf"\A\d+(?:\.\d+)*[{T.SPACE}]+[А-Я]")


def numbered(text: Column) -> Column:
    """Whether a text begins with a dotted number and a word of any alphabet."""
    return text.rlike(rf"(?U)\A\d+(?:\.\d+)*[{T.SPACE}]+\w")


def first_in_order(df: DataFrame, group: str, order: list[str], n: int, place: str) -> DataFrame:
    """The first n rows of each group in an order, with their places from 1; each task keeps its own n before the shuffle."""
    from pyspark.sql import Window

    return df.withColumn(place, F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col(place) <= n)


def first_rows(df: DataFrame, group: str, pos: str, n: int) -> DataFrame:
    """The first n rows of each group by place; each task keeps its own n before the shuffle. To break after the row that exceeds m, ask for m + 1."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(group).orderBy(pos))
    return df.withColumn("__n", place).filter(F.col("__n") <= n).drop("__n")


def from_first(df: DataFrame, group: str, pos: str, start: Column) -> DataFrame:
    """Rows of each group from its first row on for which start holds; groups without such a row are dropped.

    The first places are aggregated before any shuffle and joined back, rows of large groups in parts.
    """
    first = df.filter(start).groupBy(F.col(group).alias("__group")).agg(F.min(pos).alias("__first"))
    return split_join(df, first, group, "__group", pos).filter(F.col(pos) >= F.col("__first")).drop("__group", "__first")
