"""Small DOCX files from paragraphs, for round trips and tests."""

from __future__ import annotations

import io
import zipfile
from dataclasses import dataclass
from xml.sax.saxutils import escape, quoteattr

_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


@dataclass(frozen=True)
class Paragraph:
    """A paragraph with what may be around its text. anchor: name of a bookmark before it; link: address its text leads to; inserted: as a tracked insertion; control: inside a content control; nested: inside a table in a table."""

    style: str
    text: str
    num_id: int | None = None
    ilvl: int = 0
    anchor: str | None = None
    link: str | None = None
    inserted: bool = False
    control: bool = False
    nested: bool = False


def written(paragraphs: list[tuple[str, str] | Paragraph], media: dict[str, bytes] | None = None, ordered: tuple[int, ...] = ()) -> bytes:
    """A DOCX of paragraphs, given whole or as (style name, text). Tabs become tab elements; characters that XML can't hold are dropped.

    ordered: the num_ids of numbered lists; other lists have marks.
    """
    given = [p if isinstance(p, Paragraph) else Paragraph(*p) for p in paragraphs]
    ids = {name: f"s{i}" for i, name in enumerate(dict.fromkeys(p.style for p in given))}
    links = {link: f"rId{i}" for i, link in enumerate(dict.fromkeys(p.link for p in given if p.link), 1)}
    allowed = lambda t: "".join(c for c in t if c in "\t\n\r" or ord(c) >= 32 and not 0xFFFE <= ord(c) <= 0xFFFF)

    def run(text: str) -> str:
        parts = [f'<w:t xml:space="preserve">{escape(p, {chr(13): "&#13;"})}</w:t>' for p in allowed(text).split("\t")]
        return "<w:r>" + "<w:tab/>".join(parts) + "</w:r>"

    def block(p: Paragraph) -> str:
        number = f'<w:numPr><w:ilvl w:val="{p.ilvl}"/><w:numId w:val="{p.num_id}"/></w:numPr>' if p.num_id is not None else ""
        inside = run(p.text)
        if p.link:
            inside = f'<w:hyperlink r:id="{links[p.link]}">{inside}</w:hyperlink>'
        if p.inserted:
            inside = f"<w:ins>{inside}</w:ins>"
        if p.anchor:
            inside = f"<w:bookmarkStart w:name={quoteattr(p.anchor)}/>" + inside
        out = f'<w:p><w:pPr><w:pStyle w:val="{ids[p.style]}"/>{number}</w:pPr>{inside}</w:p>'
        if p.nested:
            cell = lambda x: f"<w:tbl><w:tr><w:tc>{x}</w:tc></w:tr></w:tbl>"
            out = cell(cell(out))
        return f"<w:sdt><w:sdtContent>{out}</w:sdtContent></w:sdt>" if p.control else out

    body = "".join(map(block, given))
    head = '<?xml version="1.0" encoding="UTF-8"?>'
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="{i}"><w:name w:val={quoteattr(n)}/></w:style>' for n, i in ids.items())
    numbers = sorted({p.num_id for p in given if p.num_id is not None})
    levels = lambda n: "".join(f'<w:lvl w:ilvl="{i}"><w:numFmt w:val="{"decimal" if n in ordered else "bullet"}"/></w:lvl>' for i in range(9))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f"{head}<w:document {_NS}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f"{head}<w:styles {_NS}>{styles}</w:styles>")
        if numbers:
            kinds = "".join(f'<w:abstractNum w:abstractNumId="{n}">{levels(n)}</w:abstractNum>' for n in numbers)
            z.writestr("word/numbering.xml", f"{head}<w:numbering {_NS}>{kinds}" + "".join(f'<w:num w:numId="{n}"><w:abstractNumId w:val="{n}"/></w:num>' for n in numbers) + "</w:numbering>")
        if links:
            listed = "".join(f'<Relationship Id="{i}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/hyperlink" Target={quoteattr(link)} TargetMode="External"/>' for link, i in links.items())
            z.writestr("word/_rels/document.xml.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{listed}</Relationships>')
        for name, raw in (media or {}).items():
            z.writestr(f"word/media/{name}", raw)
    return out.getvalue()
