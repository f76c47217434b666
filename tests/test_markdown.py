"""Markdown operators against literals and a plain Python statement of the same rules."""

import random
import re

from pyspark.sql import functions as F

from chaptermill.functions import slugs
from chaptermill.functions import text as T
from chaptermill.operators import markdown as M


def values(spark, texts, column):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", column(F.col("t")).alias("x")).collect()
    return [r.x for r in sorted(rows)]


def renumbered_plainly(md, chapter):
    count, out = [0, 0, 0], []
    for line in md.splitlines():
        for level in (2, 3, 4):
            if m := re.match("#" * level + " (.+)", line):
                count[level - 2] += 1
                count[level - 1 :] = [0] * (4 - level)
                line = "#" * level + " " + ".".join(map(str, [chapter, *count[: level - 1]])) + " " + m.group(1)
                break
        out.append(line)
    return "\n".join(out)


def test_numbers_follow_levels(spark):
    md = "# T\n## Intro\n### Detail\n#### Deep\n### Next\n## Second\n##### five\n##x"
    assert values(spark, [md], lambda c: M.renumbered(c, F.lit(1))) == ["# T\n## 1.1 Intro\n### 1.1.1 Detail\n#### 1.1.1.1 Deep\n### 1.1.2 Next\n## 1.2 Second\n##### five\n##x"]


def test_numbers_null_empty_and_ends(spark):
    got = values(spark, [None, "", "### a\r\n## b\n", "\n\n"], lambda c: M.renumbered(c, F.lit(7)))
    assert got == [None, "", "### 7.0.1 a\n## 7.1 b", "\n"]


def test_numbers_random(spark):
    rng = random.Random(5)
    parts = ["## a", "### b", "#### c", "# d", "text", "", "## ", "###", "- x", "\r", "##\tq"]
    texts = ["\n".join(rng.choice(parts) for _ in range(rng.randrange(0, 40))) for _ in range(300)]
    assert values(spark, texts, lambda c: M.renumbered(c, F.lit(3))) == [renumbered_plainly(t, 3) for t in texts]


def test_numbers_options(spark):
    md = "## 4.1 a\n```\n## code\n```\n### 4.1.1 b"
    assert values(spark, [md], lambda c: M.renumbered(c, F.lit(2), strip_existing=True, skip_code=True)) == ["## 2.1 a\n```\n## code\n```\n### 2.1.1 b"]


def test_images(spark):
    got = values(spark, ["![Alt](image.png) ![](b)", None, "[no](x)"], lambda c: M.images_under(c, F.lit("gu$i\\de")))
    assert got == ["![Alt](/images/developer/administrator/gu$i\\de/image.png) ![](/images/developer/administrator/gu$i\\de/b)", None, "[no](x)"]


def test_validators(spark):
    ok = "::AppAnnotation\nx\n::\n> Таблица 1 – Описание\n- один;\n- два."
    bad = "::AppAnnotation\n> Таблица X - Описание\n- один\n- два"
    crossed = "::\n::AppAnnotation"
    got = values(spark, [ok, bad, crossed, "", None], M.warnings)
    assert got[0] == [] and got[3] == [] and got[4] is None
    assert got[1] == ["Mismatched ::AppAnnotation blocks", "Invalid table caption: > Таблица X - Описание", "List item should end with ';': - один", "Last list item should end with '.': - два"]
    assert got[2] == ["Incorrect ::AppAnnotation block ordering"]


def test_rules(spark):
    md = "# T\n\npara\n\n## a\n\npara\n\n## a\n\n| x |\n|---|\n\n> Таблица 1 – y\n\n| z |\n\ntext\n\n> Рисунок 2 – a\n> Рисунок 2 – b"
    df = spark.createDataFrame([(md,)], "t string")
    row = df.select(M.h1_titles(F.col("t")).alias("h1"), M.repeated_headings(F.col("t")).alias("rep"), M.tables_without_caption(F.col("t")).alias("tab"), M.picture_numbers_repeated(F.col("t")).alias("pic"), M.without_repeated_paragraphs(F.col("t")).alias("u"), M.links(F.lit("[a](b) ![c](d)")).alias("l")).first()
    assert (row.h1, row.rep, row.tab, row.pic, row.l) == (["T"], ["## a"], [15], ["2"], ["b"])
    assert row.u.count("para") == 1 and row.u.count("## a") == 1


def test_annotation_texts_merge(spark):
    md = "::AppAnnotation\none\n::\n\n::AppAnnotation\ntwo\n::\n\ntext\n\n::AppAnnotation\nthree\n::\n"
    assert values(spark, [md], M.annotation_texts) == [["one\ntwo", "three"]]


def test_front_matter_and_navigation(spark):
    md = "---\ntitle: 'A: b'\nreadNext:\n  to: '/old'\n  label: 'x'\nkeep: 1\n---\n\n# A"
    df = spark.createDataFrame([(md,), ("# no",), ("---\n---\nx",)], "t string")
    nav = M.with_navigation(F.col("t"), F.lit("/p"), F.lit("it's"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    got = df.select(M.title(F.col("t")).alias("title"), nav.alias("nav"), M.body(F.col("t")).alias("body")).collect()
    assert [r.title for r in got] == ["A: b", "", ""]
    assert got[0].nav == "---\ntitle: 'A: b'\nkeep: 1\nreadPrev:\n  to: '/p'\n  label: 'it''s'\n---\n\n# A"
    assert got[1].nav.startswith("---\nreadPrev:") and got[1].body == "# no" and got[2].body == "x"


def test_text_functions(spark):
    texts = ["\xa0a b ", "a\x0bb c\n", "", "x" * 81, ".md", "a/b.c.md"]
    assert values(spark, texts, T.strip)[0] == "a b"
    assert values(spark, texts, T.lines)[1] == texts[1].splitlines() and values(spark, texts, T.lines)[2] == []
    assert values(spark, texts, T.words)[0] == texts[0].split()
    assert values(spark, texts, T.preview)[3] == "x" * 80 + "..."
    assert values(spark, texts, T.stem)[4:] == [".md", "b.c"]
    assert values(spark, ["a.b*c", r"x\E.y"], lambda c: F.regexp_replace(c, T.quoted_pattern(c), F.lit("-"))) == ["-", "-"]
    assert values(spark, ["aXbXc"], lambda c: T.replace_first(c, F.lit("X"), T.quoted_replacement(F.lit("$1\\")))) == ["a$1\\bXc"]


def test_slugs(spark):
    titles = ["Общие сведения", "Щит и Ёлка — №5", "Crème Brûlée", "Підключення", "1,000 x", "  ", "Straße", None]
    want = ["obshchie-svedeniia", "shchit-i-elka-5", "creme-brulee", "pidkliuchennia", "1000-x", "", "strasse", None]
    assert values(spark, titles, slugs.slugify) == want


def test_captions_after_many_blank_lines(spark):
    texts = ["| a |\n\n\n\n \n\xa0\n> Таблица 1 – far", "| a |\n\n\n\n\ntext\n> Таблица 1 – after a text", "| a |\n\n| b |\n> Tabelle 2 – near", "| a |\n| b |\n\n\n\n", "", None]
    assert values(spark, texts, M.tables_without_caption) == [[], [0], [0], [1], [], None]
