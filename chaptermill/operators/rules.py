"""Rules of style for chapters, row by row in the JVM: what a text must look like, and rewrites that bring it there.

A null text gives null, an empty one an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

# Languages that are shown under another name, and what ends a file name of a language.
SHOWN_AS = {"terminal": "bash Terminal"}
FILE_ENDS = {"yaml": ".yaml", "conf": ".conf", "json": ".json", "bash": ".sh"}
#: How notes begin, in six languages.
NOTE_WORDS = ("Примечание", "Примітка", "Note", "Hinweis", "Nota")
TABLE_WRAPPER = '<div class="joplin-table-wrapper">'

_CODE = r"(?s)<pre[^<>]*><code class=\"language-(\w+)(?: filename-([^\"\s]+))?\"[^<>]*>(.*?)</code></pre>"


def code_fences(html: Column) -> Column:
    """Fenced block of each code sample of a page that names its language: language, then the file's name, then the code."""
    parts = F.arrays_zip(*(F.regexp_extract_all(html, F.lit(_CODE), F.lit(i)).alias(n) for i, n in ((1, "language"), (2, "file"), (3, "code"))))

    def one(p: Column) -> Column:
        language, ends = p["language"], F.lit("")
        for name, end in FILE_ENDS.items():
            ends = F.when(p["language"] == name, end).otherwise(ends)
        for name, shown in SHOWN_AS.items():
            language = F.when(p["language"] == name, shown).otherwise(language)
        file = F.when(p["file"] != "", F.concat(F.lit(" "), p["file"], ends)).otherwise("")
        return F.concat(F.lit("```"), language, file, F.lit("\n"), T.rstrip(T.plain(p["code"])), F.lit("\n```"))

    return F.transform(parts, one)


def annotations(html: Column) -> Column:
    """Annotation block of each element of class app-annotation."""
    inside = F.regexp_extract_all(html, F.lit(r"(?s)<div class=\"app-annotation\">(.*?)</div>"), F.lit(1))
    return F.transform(inside, lambda x: F.concat(F.lit("::AppAnnotation\n"), T.strip(T.plain(x)), F.lit("\n::")))


def captions(html: Column) -> Column:
    """Text of each element of class image-caption."""
    return F.transform(F.regexp_extract_all(html, F.lit(r"(?s)<div class=\"image-caption\">(.*?)</div>"), F.lit(1)), lambda x: T.strip(T.plain(x)))


def component_lists(html: Column) -> Column:
    """Items of lists of class component-list as Markdown, each ended by a semicolon."""
    lists = F.array_join(F.regexp_extract_all(html, F.lit(r"(?s)<ul class=\"component-list\">(.*?)</ul>"), F.lit(1)), "")
    items = F.regexp_extract_all(lists, F.lit(r"(?s)<li[^<>]*>(.*?)</li>"), F.lit(1))
    return F.transform(items, lambda x: F.concat(F.lit("- "), F.regexp_replace(T.strip(T.plain(x)), r"[;.]\z", ""), F.lit(";")))


def front_matter(title: Column, **links: Column) -> Column:
    """Front matter of a manifest: its title, then readPrev, readNext or nextRead (structs of to and label, null to leave one out)."""
    quoted = lambda c: F.concat(F.lit("'"), F.replace(F.coalesce(c, F.lit("")), F.lit("'"), F.lit("''")), F.lit("'"))
    blocks = [F.when(link.isNotNull(), F.concat(F.lit(f"{key}:\n  to: "), quoted(link["to"]), F.lit("\n  label: "), quoted(link["label"]), F.lit("\n"))).otherwise("") for key, link in links.items()]
    return F.concat(F.lit("---\ntitle: "), quoted(title), F.lit("\n"), *blocks, F.lit("---\n"))


def misnumbered_headings(markdown: Column) -> Column:
    """Headings of levels 2 to 4 whose number hasn't as many parts as their level, and numbered ones of level 1, as (line_no, line)."""
    placed = F.transform(T.lines(markdown), lambda x, i: F.struct(i.alias("line_no"), x.alias("line")))
    right = r"\A(?:## \d+\.\d+ |### \d+\.\d+\.\d+ |#### \d+\.\d+\.\d+\.\d+ )[^ ]"
    wrong = lambda x: x.rlike(r"\A#{2,4} .") & ~x.rlike(right) | x.rlike(r"\A# \d+(?:\.\d+)* ")
    return F.filter(placed, lambda p: wrong(p["line"]))


def listed_paragraphs(markdown: Column) -> Column:
    """Markdown in which paragraphs of one line that end with ";", and the one that follows them, became items of a list."""
    paragraphs = F.split(markdown, r"\n[ \t]*\n+")

    def of(all_: Column) -> Column:
        plain = lambda x: ~x.rlike(r"\A(?:[-#|>!:`<]|\d+[.)] )") & ~x.contains("\n")
        opens = lambda i: F.coalesce(plain(F.get(all_, i)) & T.rstrip(F.get(all_, i)).endswith(";"), F.lit(False))
        item = lambda i: opens(i) | opens(i - 1) & plain(F.get(all_, i))
        one = lambda x, i: F.concat(F.when(i == 0, "").when(item(i) & opens(i - 1), "\n").otherwise("\n\n"), F.when(item(i), F.concat(F.lit("- "), x)).otherwise(x))
        return F.array_join(F.transform(all_, one), "")

    return T.bound(paragraphs, of)


def component_items(markdown: Column) -> Column:
    """(line_no, line, right) of the items that begin with a name in backticks; right: a long dash, a text and a semicolon (a full stop at the end of the list) follow."""
    placed = F.transform(T.lines(markdown), lambda x, i: F.struct(i.alias("line_no"), x.alias("line"), x.rlike(r"\A- `[^`]+` — .*[^\s;.][;.]\s*\z").alias("right")))
    return F.filter(placed, lambda p: p["line"].startswith("- `"))


def table_columns(markdown: Column) -> Column:
    """(line_no, columns, breaks) of each table: alignment of each column (l, c, r or - if none is given) by its second line, and line breaks inside cells of its first row."""

    def of(lines: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            cells = F.transform(F.split(F.regexp_replace(x, r"\A\||\|\s*\z", ""), r"\|"), lambda c: F.trim(c))
            side = lambda c: F.when(c.startswith(":") & c.endswith(":"), "c").when(c.startswith(":"), "l").when(c.endswith(":"), "r").otherwise("-")
            row = F.struct(i.alias("line_no"), F.array_join(F.transform(cells, side), "").alias("columns"), F.coalesce(F.regexp_count(F.get(lines, i + 1), F.lit(r"(?i)<br\s*/?>")), F.lit(0)).alias("breaks"))
            return F.when(x.rlike(r"\A\|(?:\s*:?-+:?\s*\|)+\s*\z"), row)

        return F.filter(F.transform(lines, one), lambda r: r.isNotNull())

    return T.bound(T.lines(markdown), of)


def bare_notes(markdown: Column) -> Column:
    """(line_no, line) of notes that aren't blockquotes beginning with an emphasised word and a dash."""
    words = "|".join(NOTE_WORDS)
    placed = F.transform(T.lines(markdown), lambda x, i: F.struct(i.alias("line_no"), x.alias("line")))
    return F.filter(placed, lambda p: p["line"].rlike(rf"\A(?:> ?)?[_*]*(?:{words})[_*]*(?:[:.]| ?[–—-] )") & ~p["line"].rlike(rf"\A> _(?:{words})_ – [^ ]"))


def image_blocks(markdown: Column) -> Column:
    """Markdown whose images stand in sign-image blocks."""
    return F.regexp_replace(markdown, r"(?m)^!\[([^\]\n]*)\]\(([^)\s]+)\)[ \t]*$", "::sign-image\nsrc: $2\nsign: $1\n::")


def sign_images(markdown: Column) -> Column:
    """(src, sign, number) of each sign-image block; number: that of a sign that names its picture, else null."""
    block = r"(?m)^::sign-image[ \t]*\nsrc: ([^\n]*)\nsign: ([^\n]*)\n::"
    parts = F.arrays_zip(F.regexp_extract_all(markdown, F.lit(block), F.lit(1)).alias("src"), F.regexp_extract_all(markdown, F.lit(block), F.lit(2)).alias("sign"))
    number = lambda p: F.regexp_extract(p["sign"], r"\A(?:Рисунок|Figure|Abbildung|Figura|Imagem) (\d+) – ", 1)
    return F.transform(parts, lambda p: F.struct(p["src"].alias("src"), p["sign"].alias("sign"), F.when(number(p) != "", number(p)).alias("number")))


def wrapped_tables(markdown: Column) -> Column:
    """Markdown whose HTML tables stand in their wrapper; those that already do stay."""
    once = F.regexp_replace(markdown, r"(?s)<table\b.*?</table>", TABLE_WRAPPER + "\n$0\n</div>")
    return F.regexp_replace(once, r"(" + TABLE_WRAPPER + r"\s*)" + TABLE_WRAPPER + r"\n(?s)(.*?</table>)\n</div>(\s*</div>)", "$1$2$3")
