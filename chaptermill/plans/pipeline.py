"""The whole way of a document: DOCX, page, chapters, answers, Markdown, warnings, navigation.

Each stage is a plan over rows; only parsing of markup and the model are Arrow stages. All
chapters are processed unless one is asked for.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import slugs
from ..functions import text as T
from ..operators import answers, contents, enrich, navigation, pages
from ..operators import markdown as M
from ..sources import docx
from ..sources.files import Settings
from . import lineage


@dataclass
class Result:
    markdown: DataFrame  # path, chapter_no, filename, title, markdown
    warnings: DataFrame  # path, chapter_no, ord, message
    rejected: DataFrame  # path, chapter_no, error
    unconverted: DataFrame  # path, error: documents of which no chapter comes out
    asked: DataFrame  # path, chapter_no, status, attempts


def document_pages(files: DataFrame, style_map: dict[str, str] | None = None) -> DataFrame:
    """(path, html) of DOCX files: anchors folded into headings by the file's own contents, which are then removed. Each file is parsed once; no shuffle."""
    read = docx.documents(files, style_map).filter("error is null")
    return pages.without_contents(read.select("path", "html", contents.entries(F.col("contents")).alias("toc")), "path", "html", "toc")


def document_chapters(files: DataFrame, only: int | None = None, style_map: dict[str, str] | None = None) -> DataFrame:
    """(path, chapter_no, html) of DOCX files, split at h1. The dry run ends here."""
    return pages.chapters(document_pages(files, style_map), "path", "html", only=only)


def complete_answer(html: str, content: str | None) -> bool:
    """Whether an answer is to be taken at once: JSON whose Markdown holds what the page says. Other answers, fenced blocks included, aren't asked for again."""
    markdown = answers.json_markdown(content)
    return markdown is None or pages.complete(html, markdown)


def unread(files: DataFrame, style_map: dict[str, str] | None = None) -> DataFrame:
    """(path, error) of DOCX files that can't be read."""
    return docx.documents(files, style_map).filter("error is not null").select("path", "error")


def unconverted(files: DataFrame, style_map: dict[str, str] | None = None) -> DataFrame:
    """(path, error) of DOCX files of which no chapter comes out: those that can't be read, and pages without h1."""
    empty = pages.without_chapters(document_pages(files, style_map), "path", "html").select("path", F.lit("no h1 begins a chapter").alias("error"))
    return unread(files, style_map).unionByName(empty)


def processed(answered: DataFrame) -> DataFrame:
    """Rows (path, chapter_no, html, content, error) with manifest fields, Markdown numbered by the chapter's place and with images moved under the document's slug, and what is missing in an incomplete answer.

    The error that comes in is that of an answer taken although it is incomplete; the one that goes out is why a row is no good.
    """
    parsed = answered.withColumn("a", answers.parsed_answer(F.col("content"))).withColumn("violations", answers.manifest_violations(F.col("a.manifest")))
    done = M.images_under(M.renumbered(F.col("a.markdown"), F.col("chapter_no")), slugs.slugify(T.stem(F.col("path"))))
    return parsed.select(
        "path", "chapter_no", F.get_json_object("a.manifest", "$.filename").alias("filename"), F.get_json_object("a.manifest", "$.title").alias("title"), done.alias("markdown"),
        F.coalesce("a.error", F.when(F.size("violations") > 0, F.array_join("violations", "; "))).alias("error"), T.bound(pages.completeness(F.col("html"), F.col("a.markdown")), lambda c: F.when(c["incomplete"] | F.col("error").isNotNull(), _missing(c))).alias("incomplete"),
    )


def _missing(c: Column) -> Column:
    return F.format_string("Incomplete answer: %d of %d headings and %d of %d pieces of code are missing", c["lost_headers"], c["n_headers"], c["lost_code"], c["n_code"])


def converted(files: DataFrame, settings: Settings, rules: str, examples: str, factory: Callable[[], enrich.Transport] | None = None, only: int | None = None, style_map: dict[str, str] | None = None, sleep: Callable[[float], None] = time.sleep) -> Result:
    """The full run. The model's answers are written to the checkpoint folder before they are used twice."""
    chapters = document_chapters(files, only, style_map)
    asked = chapters.withColumn("payload", answers.payload(answers.messages(F.col("html"), rules, examples), settings.model or "", settings.provider))
    got = lineage.kept(enrich.enriched(asked, "path", "payload", settings, factory, complete_answer, "html", ["chapter_no", "html"], sleep))
    rows = processed(got.filter("content is not null"))
    good = rows.filter("error is null")
    failed = got.filter("content is null").select("path", "chapter_no", "error").unionByName(rows.filter("error is not null").select("path", "chapter_no", "error"))
    # Names alone are put in order; the texts are joined to their neighbours' names.
    placed = navigation.neighbours(good.select("path", "chapter_no", "filename", "title"), "path", ["filename", "chapter_no"], ["filename", "title"]).drop("ord", "filename", "title")
    placed = good.select("path", "chapter_no", "filename", "title", "markdown").join(placed, ["path", "chapter_no"])
    link = lambda c: navigation.link_target(F.col(c))
    final = placed.select("path", "chapter_no", "filename", "title", M.with_navigation(F.col("markdown"), link("prev_filename"), F.col("prev_title"), link("next_filename"), F.col("next_title")).alias("markdown"))
    warned = good.select("path", "chapter_no", F.posexplode(F.concat(F.array_compact(F.array("incomplete")), M.warnings(F.col("markdown")))).alias("ord", "message"))
    return Result(final, warned, failed, unconverted(files, style_map), got.select("path", "chapter_no", "status", "attempts"))
