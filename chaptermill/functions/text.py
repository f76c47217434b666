"""String functions with the semantics of plain Unicode text handling, as Spark columns.

All stay in the JVM. A null argument gives null unless stated otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it (Java's \s and trim() know ASCII only), inside a character class.
SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: What ends a line: CR LF, or one of LF, VT, FF, CR, FS, GS, RS, NEL, LS, PS.
LINE_END = r"\r\n|[\n\x{b}\f\r\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"

#: Entities that plain() resolves, in this order.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\xa0"), ("&amp;", "&"))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of value, with value computed once however often f uses it; inside a lambda a column is computed again at each use."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"[{SPACE}]+\z", "")


def lines(c: Column) -> Column:
    """The lines of a text; a line end at its end adds no empty line, and an empty text has none."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(c, rf"(?:{LINE_END})\z", ""), LINE_END, -1))


def words(c: Column) -> Column:
    """Runs of characters between white space; a blank text has none."""
    return F.filter(F.split(c, rf"[{SPACE}]+"), lambda w: w != "")


def word_set(c: Column) -> Column:
    """The distinct words in lower case."""
    return F.array_distinct(words(F.lower(c)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements of two arrays of distinct elements; 0 if both are empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, 0.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def quoted_pattern(c: Column) -> Column:
    """A pattern that matches exactly the text c."""
    return F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def quoted_replacement(c: Column) -> Column:
    """A replacement that puts exactly the text c."""
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))


def replace_first(c: Column, pattern: Column, replacement: Column) -> Column:
    """c with the first match of pattern replaced; pattern must not have groups."""
    return F.regexp_replace(c, F.concat(F.lit(r"(?s)\A(.*?)(?:"), pattern, F.lit(")")), F.concat(F.lit("$1"), replacement))


def preview(c: Column, size: int = 80) -> Column:
    """The first size characters, with three dots if there are more."""
    return F.when(F.length(c) > size, F.concat(F.left(c, F.lit(size)), F.lit("..."))).otherwise(c)


def number_level(number: Column) -> Column:
    """Level of a dotted number: its parts."""
    return F.size(F.split(number, r"\."))


def leading_number(c: Column) -> Column:
    """The dotted number that a text begins with, or null."""
    found = F.regexp_extract(c, rf"\A(\d+(?:\.\d+)*)[{SPACE}]", 1)
    return F.when(found != "", found)


def stem(path: Column) -> Column:
    """The last part of a path without its extension; a name that only begins with a dot keeps it."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)\z", 1), r"(?<=.)\.[^.]*\z", "")


def without_extension(path: Column) -> Column:
    """A path without the extension of its last part."""
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]*\z", "")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def plain(html: Column) -> Column:
    """Text of markup: without tags, the five basic entities resolved."""
    text = F.regexp_replace(html, r"(?s)<!--.*?-->|<[^<>]*>", "")
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text
