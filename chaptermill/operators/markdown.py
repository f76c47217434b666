"""Operators on Markdown that stay inside one row: numbering, links, validators, rules.

Every text is one row, so its lines are an array and each operator is a narrow projection:
nothing is shuffled and no text is split over tasks. A null text gives null, an empty one
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

IMAGE_ROOT = "/images/developer/administrator"


def heading_level(line: Column) -> Column:
    """2, 3 or 4 for a heading of that level with a text, else 0."""
    return F.when(~line.startswith("##"), 0).when(line.rlike(r"\A## ."), 2).when(line.rlike(r"\A### ."), 3).when(line.rlike(r"\A#### ."), 4).otherwise(0)


def _fences(lines: Column) -> Column:
    """Places of the lines that open or close a block of code."""
    return F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(r"\A[ \t]*(```|~~~)"), i)), lambda i: i.isNotNull())


def headings(lines: Column, skip_code: bool = False) -> Column:
    """Array of (at, level) of the headings of levels 2 to 4 among lines."""
    found = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), heading_level(x).alias("level"))), lambda h: h["level"] > 0)
    if skip_code:
        return T.bound(_fences(lines), lambda fences: F.filter(found, lambda h: F.size(F.filter(fences, lambda p: p < h["at"])) % 2 == 0))
    return found


def heading_numbers(found: Column, chapter: Column) -> Column:
    """Numbers of headings in order: chapter.h2, chapter.h2.h3 and so on; a deeper counter restarts under each higher heading."""
    start = F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, h: Column) -> Column:
        level = h["level"]
        a = s["a"] + (level == 2).cast("int")
        b = F.when(level == 2, 0).otherwise(s["b"] + (level == 3).cast("int"))
        c = F.when(level <= 3, 0).otherwise(s["c"] + 1)
        number = F.concat_ws(".", chapter.cast("string"), a.cast("string"), F.when(level >= 3, b.cast("string")), F.when(level == 4, c.cast("string")))
        return F.struct(a.alias("a"), b.alias("b"), c.alias("c"), F.concat(s["out"], F.array(number)).alias("out"))

    return F.aggregate(found, start, step)["out"]


def _with_numbers(lines: Column, found: Column, chapter: Column, strip_existing: bool = False) -> Column:
    """Lines as one text, each heading among them with its number before its text."""

    def one(line: Column, number: Column) -> Column:
        marks = F.regexp_extract(line, r"\A(#+) ", 1)
        rest = F.substr(line, F.length(marks) + 2)
        if strip_existing:
            rest = F.regexp_replace(rest, r"\A\d+(?:\.\d+)*\.?\s+", "")
        return F.concat(marks, F.lit(" "), number, F.lit(" "), rest)

    def numbered(numbers: Column) -> Column:
        """Each heading, and the lines up to the next one."""
        following = lambda k: F.coalesce(F.get(found, k + 1)["at"], F.size(lines))
        first = F.coalesce(F.get(found, F.lit(0))["at"], F.size(lines))
        parts = F.transform(found, lambda h, k: F.concat(F.array(one(F.get(lines, h["at"]), F.get(numbers, k))), F.slice(lines, h["at"] + 2, following(k) - h["at"] - 1)))
        return F.array_join(F.flatten(F.concat(F.array(F.slice(lines, F.lit(1), first)), parts)), "\n")

    return T.bound(heading_numbers(found, chapter), numbered)


def renumbered(markdown: Column, chapter: Column, strip_existing: bool = False, skip_code: bool = False) -> Column:
    """Markdown with numbers put before the texts of its headings of levels 2 to 4.

    strip_existing drops a number the text begins with; skip_code leaves lines inside blocks of code.
    """
    return T.bound(T.lines(markdown), lambda lines: T.bound(headings(lines, skip_code), lambda found: _with_numbers(lines, found, chapter, strip_existing)))


def page(markdown: Column, chapter: Column) -> Column:
    """(markdown, n_headings, n_warnings): renumbered(), and how many headings and warnings() there are; the text is cut into lines once."""

    def of(lines: Column, found: Column) -> Column:
        n_warnings = F.size(_annotations(lines)) + F.size(_captions(lines)) + F.size(_lists(lines))
        return F.struct(_with_numbers(lines, found, chapter).alias("markdown"), F.size(found).alias("n_headings"), n_warnings.alias("n_warnings"))

    return T.bound(T.lines(markdown), lambda lines: T.bound(headings(lines), lambda found: of(lines, found)))


def images_under(markdown: Column, slug: Column, root: str = IMAGE_ROOT) -> Column:
    """Every image's path put under root/slug/, absolute addresses included; twice applied it is put twice."""
    put = F.concat(F.lit(rf"![$1]({root}/"), T.quoted_replacement(slug), F.lit("/$2)"))
    return F.regexp_replace(markdown, F.lit(r"(?d)!\[(.*?)\]\((.*?)\)"), put)


# Validators: each an array of warnings, in the order of lines.


def caption_warnings(markdown: Column) -> Column:
    """Table captions that aren't "> Таблица N – text"."""
    return T.bound(T.lines(markdown), _captions)


def _captions(lines: Column) -> Column:
    bad = F.filter(lines, lambda x: x.startswith("> Таблица") & ~x.rlike(r"\A> Таблица \d+ – .+"))
    return F.transform(bad, lambda x: F.concat(F.lit("Invalid table caption: "), x))


def list_warnings(markdown: Column) -> Column:
    """Items of a run of "- " lines that don't end with ";", and last items that don't end with "."."""
    return T.bound(T.lines(markdown), _lists)


def _lists(lines: Column) -> Column:
    def one(x: Column, i: Column) -> Column:
        last = ~F.coalesce(F.get(lines, i + 1).startswith("- "), F.lit(False))
        wrong = F.when(last, ~T.rstrip(x).endswith(".")).otherwise(~T.rstrip(x).endswith(";"))
        return F.when(x.startswith("- ") & wrong, F.concat(F.when(last, F.lit("Last list item should end with '.': ")).otherwise(F.lit("List item should end with ';': ")), x))

    return F.filter(F.transform(lines, one), lambda w: w.isNotNull())


def annotation_warnings(markdown: Column) -> Column:
    """One warning if starts and ends of annotations differ in number, else one if an end stands before its start."""
    return T.bound(T.lines(markdown), _annotations)


def annotation_marks(lines: Column) -> Column:
    """(s, e): places of the lines at which annotations start (once for each mark) and end."""
    count = F.transform(lines, lambda x, i: F.when(x.contains("::AppAnnotation"), F.array_repeat(i, F.regexp_count(x, F.lit("::AppAnnotation")))))
    ends = F.transform(lines, lambda x, i: F.when(x.startswith("::") & x.rlike(rf"\A::[{T.SPACE}]*\z"), i))
    return F.struct(F.flatten(F.filter(count, lambda a: a.isNotNull())).alias("s"), F.filter(ends, lambda i: i.isNotNull()).alias("e"))


def _annotations(lines: Column) -> Column:
    def of(both: Column) -> Column:
        s, e = both["s"], both["e"]
        crossed = F.exists(F.zip_with(s, e, lambda a, b: a > b), lambda x: x)
        return (
            F.when(F.size(s) != F.size(e), F.array(F.lit("Mismatched ::AppAnnotation blocks")))
            .when(crossed, F.array(F.lit("Incorrect ::AppAnnotation block ordering")))
            .otherwise(F.array().cast("array<string>"))
        )

    return F.when(lines.isNotNull(), T.bound(annotation_marks(lines), of))


def warnings(markdown: Column) -> Column:
    """All validators' warnings: annotations, captions, lists; the text is cut into lines once."""
    return T.bound(T.lines(markdown), lambda lines: F.concat(_annotations(lines), _captions(lines), _lists(lines)))


# Rules of style that a text can be checked for.


def h1_titles(markdown: Column) -> Column:
    return F.transform(F.filter(T.lines(markdown), lambda x: x.rlike(r"\A# .")), lambda x: T.strip(F.substr(x, F.lit(3))))


def repeated_headings(markdown: Column) -> Column:
    """Heading lines that occur again, each once, in the order of their first place."""
    found = F.filter(T.lines(markdown), lambda x: x.rlike(r"\A#{1,6} ."))
    return _repeated(found)


def _repeated(values: Column) -> Column:
    """Values that an array has more than once, each once; neighbours of its sorted copy tell."""
    again = T.bound(F.array_sort(values), lambda a: F.filter(a, lambda x, i: (i > 0) & (x == F.get(a, i - 1))))
    return F.array_intersect(values, again)


def without_repeated_paragraphs(markdown: Column) -> Column:
    """Paragraphs (parts between blank lines) that occurred before are dropped."""
    return F.array_join(F.array_distinct(F.split(markdown, r"\n[ \t]*\n+")), "\n\n")


def tables_without_caption(markdown: Column) -> Column:
    """Lines (as numbers) at which a table ends that no caption follows, blank lines aside."""

    def of(kept: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            after = F.get(kept, i + 1)
            goes_on = after["line"].startswith("|") & (after["at"] == x["at"] + 1)
            end = x["line"].startswith("|") & ~F.coalesce(goes_on, F.lit(False))
            return F.when(end & ~F.coalesce(after["line"].rlike(r"(?U)\A> \w+ \d+ – "), F.lit(False)), x["at"])

        return F.filter(F.transform(kept, one), lambda i: i.isNotNull())

    placed = F.transform(T.lines(markdown), lambda x, i: F.struct(i.alias("at"), x.alias("line")))
    return T.bound(F.filter(placed, lambda x: T.strip(x["line"]) != ""), of)


def annotation_texts(markdown: Column) -> Column:
    """Texts of the annotation blocks; those of blocks with nothing but annotations between are merged."""
    joined = F.regexp_replace(markdown, r"\n::[ \t]*\n+::AppAnnotation[^\n]*\n", "\n")
    return F.transform(F.regexp_extract_all(joined, F.lit(r"(?s)::AppAnnotation[^\n]*\n(.*?)\n::[ \t]*(?=\n|\z)"), F.lit(1)), T.strip)


def links(markdown: Column) -> Column:
    """Targets of links that aren't images."""
    return F.regexp_extract_all(markdown, F.lit(r"(?<!!)\[[^\]\n]*\]\(([^)\s]+)"), F.lit(1))


def anchors_of_headings(markdown: Column) -> Column:
    """Anchor of each heading: lower case words with hyphens between."""
    found = F.filter(T.lines(markdown), lambda x: x.rlike(r"\A#{1,6} ."))
    return F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(F.lower(T.strip(F.regexp_replace(x, r"\A#+ ", ""))), r"[^\p{L}\p{N}\s_-]", ""), r"\s", "-"))


def picture_numbers_repeated(markdown: Column) -> Column:
    """Numbers that more than one picture caption has."""
    numbers = F.regexp_extract_all(markdown, F.lit(r"(?m)^> (?:Рисунок|Figure|Abbildung|Figura|Imagem) (\d+) –"), F.lit(1))
    return _repeated(numbers)


# Parts of an answer.


def unfenced(content: Column, language: str) -> Column:
    """Inside of the first fenced block of a language, or null."""
    inside = F.regexp_extract(content, rf"(?s)```{language}\s*(.*?)\s*```", 1)
    return F.when(content.rlike(rf"(?s)```{language}\s*.*?\s*```"), inside)


def front_matter(markdown: Column) -> Column:
    """Lines between the fences a text begins with, or null."""
    return F.when(markdown.rlike(r"(?s)\A---[ \t]*\r?\n.*?(?:\A|\n)---[ \t]*(?:\r?\n|\z)"), F.regexp_extract(markdown, r"(?s)\A---[ \t]*\r?\n(.*?)(?:\r?\n)?---[ \t]*(?:\r?\n|\z)", 1))


def body(markdown: Column) -> Column:
    """The text after its front matter."""
    return F.regexp_replace(markdown, r"(?s)\A---[ \t]*\r?\n.*?(?<=\n)---[ \t]*(?:\r?\n|\z)", "")


def front_map(markdown: Column) -> Column:
    """Map of the top-level keys of the front matter to their values as text; empty without front matter.

    Quoted values lose their quotes; a text over several lines, plain or after ">", becomes one line, one after "|"
    keeps its lines. Lists and nested keys keep their lines. Of a key that occurs again the last one counts.
    """
    pattern = r"(?m)^([A-Za-z_][\w-]*):[ \t]*([^\n]*(?:\n(?:[ \t]+[^\n]*|- [^\n]*))*)"
    front = F.regexp_replace(F.coalesce(front_matter(markdown), F.lit("")), r"\r\n?", "\n")
    pairs = F.arrays_zip(F.regexp_extract_all(front, F.lit(pattern), F.lit(1)).alias("k"), F.regexp_extract_all(front, F.lit(pattern), F.lit(2)).alias("v"))

    def value(v: Column) -> Column:
        own = F.regexp_replace(F.regexp_replace(v, r"\A[|>][+-]?[ \t]*\n", ""), r"\s+\z", "")
        one_line = F.regexp_replace(F.regexp_replace(own, r"\A[ \t]+", ""), r"[ \t]*\n[ \t]*", " ")
        quoted = F.regexp_replace(F.regexp_replace(one_line, r"(?s)\A'(.*)'\z", "$1"), r'(?s)\A"(.*)"\z', "$1")
        text = F.when(one_line.startswith("'") & one_line.endswith("'"), F.replace(quoted, F.lit("''"), F.lit("'"))).when(one_line.startswith('"') & one_line.endswith('"'), F.replace(quoted, F.lit('\\"'), F.lit('"'))).otherwise(one_line)
        nested = v.startswith("\n") | v.rlike(r"\n- ")
        return F.when(nested, F.regexp_replace(own, r"\A\n", "")).when(v.startswith("|"), F.regexp_replace(own, r"(?m)^[ \t]+", "")).otherwise(text)

    return F.map_from_entries(F.array_distinct(F.transform(pairs, lambda p: F.struct(p["k"], value(F.element_at(F.filter(pairs, lambda q: q["k"] == p["k"]), F.lit(-1))["v"])))))


def front_value(markdown: Column, key: str) -> Column:
    """Value of a key of the front matter as in front_map(); null if it has none or an empty one."""
    return F.nullif(F.try_element_at(front_map(markdown), F.lit(key)), F.lit(""))


def title(markdown: Column) -> Column:
    """Title of the front matter, or empty."""
    return F.coalesce(front_value(markdown, "title"), F.lit(""))


def with_navigation(markdown: Column, prev_to: Column, prev_label: Column, next_to: Column, next_label: Column) -> Column:
    """Markdown whose front matter has readPrev and readNext, other keys kept in place; a null target drops the key."""
    quoted = lambda c: F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))
    block = lambda key, to, label: F.when(to.isNotNull(), F.concat(F.lit(f"{key}:\n  to: "), quoted(to), F.lit("\n  label: "), quoted(F.coalesce(label, F.lit(""))), F.lit("\n")))
    kept = F.regexp_replace(F.coalesce(front_matter(markdown), F.lit("")), r"(?m)^(?:readPrev|readNext):[^\n]*(?:\n[ \t]+[^\n]*)*\n?", "")
    kept = F.when(T.strip(kept) == "", F.lit("")).otherwise(F.concat(T.rstrip(kept), F.lit("\n")))
    return F.concat(
        F.lit("---\n"), kept, F.coalesce(block("readPrev", prev_to, prev_label), F.lit("")), F.coalesce(block("readNext", next_to, next_label), F.lit("")), F.lit("---\n"), body(markdown)
    )
