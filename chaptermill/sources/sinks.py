"""Writing rows as files: pages, Markdown, media, contents.

Files are written by the tasks that hold the rows; nothing goes through the driver. Names are
made safe first. A task that runs again writes the same files again, each under a temporary
name that is then renamed (object stores show a file only once it is whole), so a lost
executor leaves no half file. The folder has to be one that all executors share: a path, or
an address of a file system that pyarrow knows (file, hdfs, s3, gs).
"""

from __future__ import annotations

import json
import os
import posixpath
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import navigation

#: Bytes of a name above which its middle becomes a digest of the whole; file systems take 255.
NAME_BYTES = 180


def safe_name(name: Column, ordinal: Column | None = None) -> Column:
    """name without folders, leading dots and signs that files don't have; an ordinal put before it keeps names apart; null and blank give "unnamed".

    A long name keeps its beginning and extension, with a digest of the whole name between, so different names stay different.
    """
    last = F.regexp_extract(F.replace(name, F.lit("\\"), F.lit("/")), r"([^/]*)/*\z", 1)
    plain = F.regexp_replace(F.regexp_replace(last, r"[\x00-\x1f<>:\"|?*~]", "_"), r"\A[.\s]+|[.\s]+\z", "")
    short = F.concat(F.left(plain, F.lit(NAME_BYTES // 4)), F.lit("~"), F.md5(plain), F.regexp_extract(plain, r"(\.\w{1,10})\z", 1))
    plain = F.when(F.octet_length(plain) > NAME_BYTES, short).otherwise(plain)
    plain = F.when(F.coalesce(plain, F.lit("")) == "", "unnamed").otherwise(plain)
    return F.concat_ws(".", ordinal.cast("string"), plain) if ordinal is not None else plain


_SCHEME = r"\A[A-Za-z][A-Za-z0-9+.-]*:(?://(?=/))?"


def relative_path(path: Column, root: str) -> Column:
    """path as seen from the folder root (a file stands for its folder); one that lies elsewhere stays whole, without its scheme."""
    local = root if re.match(_SCHEME, root) else os.path.abspath(root)
    base = re.sub(_SCHEME, "", local).rstrip("/")
    whole = F.regexp_replace(path, _SCHEME, "")
    inside = F.when(whole == base, F.regexp_extract(whole, r"([^/]*)\z", 1)).when(whole.startswith(base + "/"), F.substr(whole, F.lit(len(base) + 2)))
    return F.regexp_replace(F.coalesce(inside, whole), r"\A/+", "")


def own_name(name: Column) -> Column:
    """safe_name(), with a digest of the name before its extension where it isn't the name itself: different names stay different."""
    safe = safe_name(name)
    stem = T.without_extension(safe)
    return F.when(safe == name, safe).otherwise(F.concat(stem, F.lit("~"), F.left(F.md5(F.coalesce(name, F.lit(""))), F.lit(12)), F.substr(safe, F.length(stem) + 1)))


def document_folder(path: Column, root: str) -> Column:
    """Folder of a document's files: its path from root on without extension, each part made safe; different documents have different folders."""
    return F.array_join(F.transform(F.split(T.without_extension(relative_path(path, root)), "/"), lambda part: own_name(part)), "/")


def distinct_names(df: DataFrame, group: list[str], name: str, order: list[str]) -> DataFrame:
    """df in which no name stands twice in a group, letter case aside: the second one in order gets ~2 before its extension, and so on.

    Names come from safe_name(), which leaves no "~" before digits, so a new name meets no other one.
    """
    place = F.row_number().over(Window.partitionBy(*group, F.lower(name)).orderBy(*order))
    stem = T.without_extension(F.col(name))
    again = F.concat(stem, F.lit("~"), F.col("__place").cast("string"), F.substr(F.col(name), F.length(stem) + 1))
    return df.withColumn("__place", place).withColumn(name, F.when(F.col("__place") > 1, again).otherwise(F.col(name))).drop("__place")


def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the folder's path in it."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:/", folder):
        system, base = fs.FileSystem.from_uri(re.sub(r"\Afile:/+", "file:///", folder))
        return system, base.rstrip("/")
    return fs.LocalFileSystem(), os.path.abspath(folder)


def _target(base: str, name: str) -> str:
    path = posixpath.normpath(posixpath.join(base, name))
    if not path.startswith(base.rstrip("/") + "/"):
        raise ValueError(f"{name} leaves the folder")
    return path


class _Output:
    """A file that stands under its name once it is whole."""

    def __init__(self, system: fs.FileSystem, path: str) -> None:
        self.system, self.path, self.size = system, path, 0
        folder = posixpath.dirname(path)
        system.create_dir(folder, recursive=True)
        self.part = f"{folder}/.{uuid.uuid4().hex}.part" if system.type_name in ("local", "hdfs") else path
        self.stream = system.open_output_stream(self.part)

    def write(self, raw: bytes) -> None:
        self.stream.write(raw)
        self.size += len(raw)

    def done(self, error: str | None = None) -> None:
        self.stream.close()
        if error:
            self.system.delete_file(self.part)
        elif self.part != self.path:
            self.system.move(self.part, self.path)


def write_files(df: DataFrame, folder: str, name: str, content: str) -> DataFrame:
    """Writes each row's content (text or binary; null as empty) under folder/name and gives (path, n_bytes) of what was written.

    Lazy: the files are written when the result is. Names may have folders; such that leave the folder are refused.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = file_system(folder)
        for part in parts:
            out = []
            for n, c in zip(part["n"], part["c"], strict=True):
                file = _Output(system, _target(base, n))
                file.write(b"" if c is None else c.encode() if isinstance(c, str) else bytes(c))
                file.done()
                out.append((file.path, file.size))
            yield pd.DataFrame(out, columns=["path", "n_bytes"])

    return df.select(F.col(name).alias("n"), F.col(content).alias("c")).mapInPandas(run, "path string, n_bytes long")


def write_pieces(df: DataFrame, folder: str, key: str, name: str) -> DataFrame:
    """Writes rows (key, name, at, data, error) whose data is a file or, from byte `at` on, a piece of it that follows its other pieces in one task.

    Gives (key, file, n_bytes, error) of each file; one with an error isn't written. Lazy, and refuses names as write_files() does.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = file_system(folder)
        key_, file = None, None

        def ended(error: str | None = None) -> pd.DataFrame:
            file.done(error)
            return pd.DataFrame([(key_, file.path, None if error else file.size, error)], columns=["k", "path", "n_bytes", "error"])

        for part in parts:
            for k, n, at, data, error in zip(part["k"], part["n"], part["at"], part["data"], part["error"], strict=True):
                if at == 0:
                    if file:
                        yield ended()
                    key_, file = k, _Output(system, _target(base, n))
                if error:
                    yield ended(error)
                    file = None
                    continue
                file.write(data)
        if file:
            yield ended()

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("k"), F.col(name).alias("n"), "at", "data", "error")
    return rows.mapInPandas(run, f"k {kind}, path string, n_bytes long, error string").withColumnRenamed("path", "file").withColumnRenamed("k", key)


def chapter_files(chapters: DataFrame, folder: str, document: str, number: str, html: str) -> DataFrame:
    """One html/chapter_N.html for each chapter, in a folder for each document (a safe relative path)."""
    named = chapters.select(F.concat(F.col(document).cast("string"), F.lit("/html/chapter_"), F.col(number).cast("string"), F.lit(".html")).alias("n"), F.col(html).alias("c"))
    return write_files(named, folder, "n", "c")


def whole_pages(pages: DataFrame, folder: str, document: str, html: str) -> DataFrame:
    """html/full_document.html for pages of which no chapter came out."""
    named = pages.select(F.concat(F.col(document).cast("string"), F.lit("/html/full_document.html")).alias("n"), F.col(html).alias("c"))
    return write_files(named, folder, "n", "c")


def page_files(pages: DataFrame, folder: str, document: str, number: str, html: str) -> DataFrame:
    """chapter_files() of rows with a number and whole_pages() of those without, in one stage."""
    name = F.coalesce(F.concat(F.lit("chapter_"), F.col(number).cast("string")), F.lit("full_document"))
    return write_files(pages.select(F.concat(F.col(document), F.lit("/html/"), name, F.lit(".html")).alias("n"), F.col(html).alias("c")), folder, "n", "c")


def media_files(media: DataFrame, root: str, folder: str) -> DataFrame:
    """Writes the media of DOCX files to folder/document/media/name, pieces of one entry in one task; documents as in document_folder()."""
    file = F.concat_ws("/", document_folder(F.col("path"), root), F.lit("media"), own_name(F.col("name")))
    return write_pieces(media.withColumn("file", file), folder, "path", "file")


def markdown_files(df: DataFrame, folder: str, name: str, markdown: str, ordinal: str | None = None) -> DataFrame:
    """Files of one folder; names that are equal once they are safe get a number."""
    named = df.select(safe_name(F.col(name), F.col(ordinal) if ordinal else None).alias("n"), F.col(name).alias("own"), F.col(markdown).alias("c"))
    return write_files(distinct_names(named, [], "n", ["own", "c"]), folder, "n", "c")


def contents_lines(df: DataFrame, folder: str, group: str, name: str, title: str) -> None:
    """toc.json entries as JSON lines, one folder for each group, in order inside and across part files; other alphabets are kept as they are."""
    entries = navigation.contents_entries(df, group, name, title)
    entries.repartitionByRange(F.col(group), F.col("ord")).sortWithinPartitions(group, "ord").write.partitionBy(group).mode("overwrite").json(folder)


def contents_file(df: DataFrame, path: str, name: str, title: str) -> int:
    """Writes one folder's toc.json (array of title and to in the order of names, indent 2) on the driver, entry by entry, and gives their number.

    For the files of one output folder; contents of many groups go to contents_lines().
    """
    entries = navigation.contents_entries(df.withColumn("__g", F.lit("")), "__g", name, title).orderBy("ord").select("title", "to")
    system, target = file_system(path)
    file, n = _Output(system, target), 0
    for n, entry in enumerate(entries.toLocalIterator(), 1):
        text = json.dumps(entry.asDict(), ensure_ascii=False, indent=2).replace("\n", "\n  ")
        file.write((("[\n  " if n == 1 else ",\n  ") + text).encode())
    file.write(b"\n]" if n else b"[]")
    file.done()
    return n
