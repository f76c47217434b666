"""Command line: python -m chaptermill run INPUT --out DIR [--dry-run] …, python -m chaptermill navigate DIR --out DIR."""

from __future__ import annotations

import argparse
import os
import posixpath
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import answers, navigation
from .operators import markdown as M
from .plans import pipeline
from .sources import docx, files, sinks


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="chaptermill", description="Convert DOCX files to numbered, linked Markdown chapters.")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="convert the DOCX files of a file or folder")
    run.add_argument("input")
    run.add_argument("--out", required=True, help="output folder, shared by all executors")
    run.add_argument("--dry-run", action="store_true", help="write the chapters' HTML and ask no model")
    run.add_argument("--provider", choices=sorted(files.ENDPOINTS))
    run.add_argument("--model")
    run.add_argument("--style-map", help="file of a style map")
    run.add_argument("--rules", help="file of formatting rules")
    run.add_argument("--samples", help="folder of Markdown examples")
    run.add_argument("--examples", type=int, default=2, help="examples in a prompt")
    run.add_argument("--chapter", type=int, help="convert only this chapter of each document")
    move = commands.add_parser("navigate", help="put previous and next links into Markdown files and write toc.json")
    move.add_argument("input")
    move.add_argument("--out", required=True)
    return parser


def _read(path: str | None) -> str:
    if not path:
        return ""
    with open(path, encoding="utf-8") as file:
        return file.read()


def dry_run(found: DataFrame, root: str, out: str, style_map: dict[str, str], only: int | None) -> DataFrame:
    """(path, n_bytes) of the files of a dry run, which are written when the result is: html/chapter_N.html of each document, or html/full_document.html where no chapter comes out."""
    pages = pipeline.document_pages(found, style_map)
    from .operators import pages as P

    chapters = P.chapters(pages, "path", "html", only=only)
    whole = pages.join(chapters.select("path").distinct(), "path", "left_anti")
    named = chapters.unionByName(whole.withColumn("chapter_no", F.lit(None).cast("int"))).withColumn("folder", sinks.document_folder(F.col("path"), root))
    return sinks.page_files(named, out, "folder", "chapter_no", "html")


def navigate(spark: SparkSession, folder: str, out: str) -> int:
    """Markdown files of a folder with links to their neighbours, and toc.json, in another folder."""
    found = files.markdown_files(spark, folder).select("name", "title", "text").withColumn("g", F.lit(""))
    placed = navigation.neighbours(found, "g", ["name"], ["name", "title"])
    link = lambda c: navigation.link_target(F.col(c))
    linked = placed.select("name", M.with_navigation(F.col("text"), link("prev_name"), F.col("prev_title"), link("next_name"), F.col("next_title")).alias("text"))
    n = sinks.markdown_files(linked, out, "name", "text").count()
    sinks.contents_file(found.select("name", "title"), posixpath.join(out, "toc.json"), "name", "title")
    return n


def main(arguments: list[str] | None = None, spark: SparkSession | None = None, factory=None) -> int:
    args = _parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("chaptermill").getOrCreate()
    if args.command == "navigate":
        print(f"{navigate(spark, args.input, args.out)} files")
        return 0
    found = docx.files(spark, args.input)
    style_map = docx.style_map_of(_read(args.style_map))
    if args.dry_run:
        print(f"{dry_run(found, args.input, args.out, style_map, args.chapter).count()} files")
        pipeline.unread(found, style_map).write.mode("overwrite").parquet(posixpath.join(args.out, "_unconverted"))
        return 0
    own = files.Settings.from_environment()
    if args.provider:
        own = files.Settings.from_environment(os.environ | {"LLM_PROVIDER": args.provider})
    settings = files.checked(replace(own, model=args.model or own.model)) if factory is None else replace(own, model=args.model or own.model)
    examples = ""
    if args.samples:
        chosen = answers.example_sample(files.samples(spark, args.samples), "path", args.examples)
        examples = chosen.agg(answers.joined_examples(chosen, "path", "text")).first()[0]
    result = pipeline.converted(found, settings, _read(args.rules), examples, factory, args.chapter, style_map)
    named = sinks.distinct_names(result.markdown.withColumns({"folder": sinks.document_folder(F.col("path"), args.input), "name": sinks.safe_name(F.col("filename"))}), ["folder"], "name", ["chapter_no"])
    n = sinks.write_files(named.withColumn("file", F.concat_ws("/", "folder", "name")), args.out, "file", "markdown").count()
    media = sinks.media_files(docx.media(found), args.input, args.out)
    media.write.mode("overwrite").parquet(posixpath.join(args.out, "_media"))
    result.warnings.write.mode("overwrite").parquet(posixpath.join(args.out, "_warnings"))
    result.rejected.write.mode("overwrite").parquet(posixpath.join(args.out, "_rejected"))
    result.unconverted.write.mode("overwrite").parquet(posixpath.join(args.out, "_unconverted"))
    sinks.contents_lines(named, posixpath.join(args.out, "_toc"), "folder", "filename", "title")
    print(f"{n} files")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
