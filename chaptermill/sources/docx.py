"""DOCX files: paragraphs with styles and list numbering, heading styles, media, and HTML.

Files are read as binary rows and parsed one by one inside Arrow-fed tasks with the standard
library; documents() gives HTML and the paragraphs of the contents from one pass over a file.
A file that is no DOCX gives no paragraphs and an error text, never a failed job. Files are
never gathered on the driver.
"""

from __future__ import annotations

import html
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"

#: Paragraph style (in lower case) to element; what isn't listed is <p>.
STYLE_MAP = {"title": "h1", "heading 1": "h1", "heading 2": "h2", "heading 3": "h3", "heading 4": "h4", "heading 5": "h5", "heading 6": "h6", "quote": "blockquote", "code": "pre"}
#: Parts of more bytes are read as a stream, element by element, instead of at once.
PART_BYTES = 256 << 20
#: Bytes of media in one row; larger entries are several rows.
PIECE_BYTES = 16 << 20


def files(spark: SparkSession, path: str, pattern: str = "*.docx") -> DataFrame:
    """(path, modificationTime, length, content) of the files under path, recursively."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)


def _elements(archive: zipfile.ZipFile, name: str, depth: int) -> Iterator[tuple[str, ElementTree.Element]]:
    """(tag of the parent, element) of the elements so many levels below the root of a part, in order; none if the archive lacks the part.

    Elements of a large part are freed once the next one is asked for.
    """
    try:
        large = archive.getinfo(name).file_size > PART_BYTES
    except KeyError:
        return
    with archive.open(name) as part:
        raw = part.read(4096 if large else -1)
    if b"<!DOCTYPE" in raw[:4096] or b"<!ENTITY" in raw[:4096]:
        raise ValueError("document type declarations aren't read")
    if not large:
        parents = [ElementTree.fromstring(raw)] if raw else []
        for _ in range(depth - 1):
            parents = [child for parent in parents for child in parent]
        yield from ((parent.tag, child) for parent in parents for child in parent)
        return
    above: list[ElementTree.Element] = []
    with archive.open(name) as part:
        for event, element in ElementTree.iterparse(part, ("start", "end")):
            if event == "start":
                above.append(element)
                continue
            above.pop()
            if len(above) == depth:
                yield above[-1].tag, element
            if 0 < len(above) <= depth:
                above[-1].remove(element)


def style_names(archive: zipfile.ZipFile) -> dict[str, tuple[str, str]]:
    """(type, name) of each style by its id."""
    out = {}
    for _, style in _elements(archive, "word/styles.xml", 1):
        if style.tag != f"{W}style":
            continue
        name = style.find(f"{W}name")
        out[style.get(f"{W}styleId", "")] = (style.get(f"{W}type", ""), name.get(f"{W}val", "") if name is not None else "")
    return out


def _text(element: ElementTree.Element) -> str:
    out = []
    for node in element.iter():
        if node.tag == f"{W}t":
            out.append(node.text or "")
        elif node.tag == f"{W}tab" and node.get(f"{W}val") is None:
            out.append("\t")
        elif node.tag in (f"{W}br", f"{W}cr"):
            out.append("\n")
        elif node.tag == f"{W}noBreakHyphen":
            out.append("-")
    return "".join(out)


def _value(element: ElementTree.Element | None) -> int | None:
    value = element.get(f"{W}val") or "" if element is not None else ""
    return int(value) if value.lstrip("-").isdigit() else None


def _numbering(p: ElementTree.Element) -> tuple[int | None, int | None]:
    """(num_id, ilvl) of a paragraph, null where it has none."""
    return _value(p.find(f"{W}pPr/{W}numPr/{W}numId")), _value(p.find(f"{W}pPr/{W}numPr/{W}ilvl"))


def parsed(content: bytes) -> list[tuple[int, str, str, int | None, int | None]]:
    """(pos from 0, style, text, num_id, ilvl) of every paragraph in order, those in tables included."""
    return list(_document(content, None, True, lambda p, style, number: True)[1])


# Elements of a paragraph or of a body whose children count as if they stood in their place, and those that hold what was deleted.
_THROUGH = frozenset(W + name for name in ("ins", "moveTo", "smartTag", "customXml", "sdtContent", "fldSimple"))
_GONE = frozenset(W + name for name in ("del", "moveFrom"))


def _children(element: ElementTree.Element) -> Iterator[ElementTree.Element]:
    """Children, those inside content controls and tracked insertions included."""
    for node in element:
        if node.tag == f"{W}sdt" or node.tag in _THROUGH:
            yield from _children(node)
        elif node.tag not in _GONE:
            yield node


class _Html:
    """HTML of body elements, one after another; open lists are kept between them."""

    def __init__(self, styles: dict[str, tuple[str, str]], targets: dict[str, str], ordered: set[tuple[int, int]], mapping: dict[str, str]) -> None:
        self.styles, self.targets, self.ordered, self.mapping = styles, targets, ordered, mapping

    def style(self, p: ElementTree.Element) -> str:
        style = p.find(f"{W}pPr/{W}pStyle")
        return self.styles.get(style.get(f"{W}val", ""), ("", style.get(f"{W}val", "")))[1] if style is not None else "Normal"

    def inline(self, p: ElementTree.Element) -> str:
        out = []
        for node in _children(p):
            if node.tag == f"{W}bookmarkStart" and node.get(f"{W}name", "").startswith("__RefHeading"):
                out.append(f'<a id="{html.escape(node.get(f"{W}name", ""))}"></a>')
            elif node.tag == f"{W}hyperlink":
                anchor = node.get(f"{W}anchor")
                to = self.targets.get(node.get(f"{R}id", ""), "") + (f"#{anchor}" if anchor else "")
                out.append(f'<a href="{html.escape(to)}">{self.inline(node)}</a>' if to else self.inline(node))
            elif node.tag == f"{W}r":
                text = html.escape(_text(node), quote=False)
                props = node.find(f"{W}rPr")
                on = lambda e: e is not None and e.get(f"{W}val", "1") not in ("0", "false")
                if text and props is not None and on(props.find(f"{W}b")):
                    text = f"<strong>{text}</strong>"
                if text and props is not None and on(props.find(f"{W}i")):
                    text = f"<em>{text}</em>"
                out.append(text)
                for blip in node.iter(f"{A}blip"):
                    out.append(f'<img src="{html.escape(self.targets.get(blip.get(f"{R}embed", ""), ""))}"/>')
        return "".join(out)

    def blocks(self, nodes: Iterator[ElementTree.Element]) -> Iterator[str]:
        """Markup of paragraphs and tables; list items by their levels, a deeper list inside the item before it. Empty paragraphs are dropped."""
        lists: list[tuple[str, int]] = []

        def closed(down_to: int) -> str:
            out = ""
            while lists and lists[-1][1] > down_to:
                out += f"</li></{lists.pop()[0]}>"
            return out

        for node in nodes:
            if node.tag == f"{W}p":
                name = self.style(node).lower()
                number, level = _numbering(node)
                inside = self.inline(node)
                if number is None or number == 0 or name in self.mapping:
                    tag = self.mapping.get(name, "p")
                    if inside:
                        yield closed(-1) + f"<{tag}>{inside}</{tag}>"
                    continue
                if not inside:
                    continue
                level = max(0, level or 0)
                kind = "ol" if (number, level) in self.ordered else "ul"
                before = closed(level)
                if lists and lists[-1] == (kind, level):
                    yield f"{before}</li><li>{inside}"
                    continue
                if lists and lists[-1][1] == level:
                    before += closed(level - 1)
                lists.append((kind, level))
                yield f"{before}<{kind}><li>{inside}"
            elif node.tag == f"{W}tbl":
                rows = (row for row in _children(node) if row.tag == f"{W}tr")
                cells = lambda row: (c for c in _children(row) if c.tag == f"{W}tc")
                table = "".join("<tr>" + "".join(f"<td>{''.join(self.blocks(_children(c)))}</td>" for c in cells(row)) + "</tr>" for row in rows)
                yield f"{closed(-1)}<table>{table}</table>"
        yield closed(-1)


def _ordered(archive: zipfile.ZipFile) -> set[tuple[int, int]]:
    """(num_id, level) of the lists that are numbered rather than marked."""
    formats: dict[str, dict[int, str]] = {}
    out = set()
    for _, node in _elements(archive, "word/numbering.xml", 1):
        if node.tag == f"{W}abstractNum":
            levels = ((_int(x.get(f"{W}ilvl")), x.find(f"{W}numFmt")) for x in node.iter(f"{W}lvl"))
            formats[node.get(f"{W}abstractNumId", "")] = {level: f.get(f"{W}val", "") for level, f in levels if f is not None}
        elif node.tag == f"{W}num":
            of = node.find(f"{W}abstractNumId")
            for level, kind in formats.get(of.get(f"{W}val", "") if of is not None else "", {}).items():
                if kind not in ("bullet", "none"):
                    out.add((_int(node.get(f"{W}numId")), level))
    return out


def _int(value: str | None) -> int:
    return int(value) if value and value.isdigit() else 0


def _document(content: bytes, style_map: dict[str, str] | None, no_html: bool, keep) -> tuple[str, list[tuple]]:
    """(HTML, rows of the paragraphs that keep(p, style, pos) takes) of a DOCX, its main part being read once."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        styles = style_names(archive)
        targets = {} if no_html else {r.get("Id", ""): r.get("Target", "") for _, r in _elements(archive, "word/_rels/document.xml.rels", 1)}
        made = _Html(styles, targets, set() if no_html else _ordered(archive), STYLE_MAP | (style_map or {}))
        rows: list[tuple] = []
        pos = 0

        def body() -> Iterator[ElementTree.Element]:
            nonlocal pos
            for parent, block in _elements(archive, "word/document.xml", 2):
                for p in block.iter(f"{W}p"):
                    style = made.style(p)
                    if keep(p, style, pos):
                        rows.append((pos, style, _text(p), *_numbering(p)))
                    pos += 1
                if parent == f"{W}body":
                    if block.tag == f"{W}sdt" or block.tag in _THROUGH:
                        yield from _children(block)
                    elif block.tag not in _GONE:
                        yield block

        if no_html:
            for _ in body():
                pass
            return "", rows
        return "".join(made.blocks(body())), rows


def to_html(content: bytes, style_map: dict[str, str] | None = None) -> str:
    """HTML of a DOCX: paragraphs by the style map, nested list items, tables in tables, emphasis, links, anchors and images; what was inserted or stands in a content control belongs to it."""
    return _document(content, style_map, False, lambda p, style, pos: False)[0]


def _each(df: DataFrame, schema: str, work) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                rows = work(path, content)
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    columns = [c.split()[0] for c in schema.split(", ")]
    return df.select("path", "content").mapInPandas(run, schema)


def paragraphs(df: DataFrame) -> DataFrame:
    """(path, pos, style, text, num_id, ilvl, error) of the paragraphs of binary rows (path, content)."""

    def work(path: str, content: bytes | None) -> list[tuple]:
        try:
            return [(path, *row, None) for row in parsed(content or b"")]
        except Exception as e:  # noqa: BLE001
            return [(path, None, None, None, None, None, str(e)[:200])]

    found = _each(df, "path string, pos double, style string, text string, num_id double, ilvl double, error string", work)
    return found.withColumns({c: found[c].cast("int") for c in ("pos", "num_id", "ilvl")})


def heading_styles(df: DataFrame) -> DataFrame:
    """(path, style_id, name) of the paragraph styles whose name holds "heading", case ignored."""

    def work(path: str, content: bytes | None) -> list[tuple]:
        try:
            with zipfile.ZipFile(io.BytesIO(content or b"")) as archive:
                return [(path, i, name) for i, (kind, name) in style_names(archive).items() if kind == "paragraph" and "heading" in name.lower()]
        except Exception:  # noqa: BLE001
            return []

    return _each(df, "path string, style_id string, name string", work)


def media_of(content: bytes) -> Iterator[tuple[str, int, bytes | None, str | None]]:
    """(name, at, data, error) of the media entries of a DOCX, in pieces of bounded size that begin at byte `at`; an entry that can't be read ends with an error."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for entry in archive.infolist():
            if not entry.filename.startswith("word/media/") or entry.is_dir():
                continue
            name, at = entry.filename.rpartition("/")[2], 0
            try:
                with archive.open(entry) as part:
                    while (data := part.read(PIECE_BYTES)) or not at:
                        yield name, at, data, None
                        at += len(data)
                        if not data:
                            break
            except Exception as e:  # noqa: BLE001
                yield name, at, None, f"{name}: {e}"[:200]


def media(df: DataFrame) -> DataFrame:
    """(path, name, at, data, error) of the images and other media inside DOCX files.

    Data is one row, for entries above PIECE_BYTES several rows, which follow one another in one task. An entry that
    can't be read gives a row with an error, the others stay. A file that is no DOCX gives no rows; pages() has its error.
    """
    columns = ["path", "name", "at", "data", "error"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                try:
                    for row in media_of(content or b""):
                        yield pd.DataFrame([(path, *row)], columns=columns)
                except Exception:  # noqa: BLE001, S112
                    continue

    return df.select("path", "content").mapInPandas(run, "path string, name string, at long, data binary, error string")


def pages(df: DataFrame, style_map: dict[str, str] | None = None) -> DataFrame:
    """(path, html, error) of DOCX files; html is null where there is an error."""

    def work(path: str, content: bytes | None) -> list[tuple]:
        try:
            return [(path, to_html(content or b"", style_map), None)]
        except Exception as e:  # noqa: BLE001
            return [(path, None, str(e)[:200])]

    return _each(df, "path string, html string, error string", work)


def documents(df: DataFrame, style_map: dict[str, str] | None = None) -> DataFrame:
    """(path, html, contents, error) of DOCX files, each parsed once; contents: array of (pos, style, text) of the paragraphs whose style begins with "toc"."""

    def work(path: str, content: bytes | None) -> list[tuple]:
        try:
            page, rows = _document(content or b"", style_map, False, lambda p, style, pos: style.startswith("toc"))
            return [(path, page, [{"pos": r[0], "style": r[1], "text": r[2]} for r in rows], None)]
        except Exception as e:  # noqa: BLE001
            return [(path, None, None, str(e)[:200])]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                yield pd.DataFrame(work(path, content), columns=["path", "html", "contents", "error"])

    return df.select("path", "content").mapInPandas(run, "path string, html string, contents array<struct<pos: int, style: string, text: string>>, error string")


def style_map_of(text: str) -> dict[str, str]:
    """A style map from lines like p[style-name='Heading 1'] => h1:fresh; other lines are ignored."""
    found = re.findall(r"p\[style-name=['\"]([^'\"]+)['\"]\]\s*=>\s*(\w+)", text)
    return {name.lower(): tag for name, tag in found}
