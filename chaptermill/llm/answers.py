"""What the checks of model answers share: unwrapping, readable text, ends of texts, and their place in the source."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass
from itertools import chain

_FRONT = re.compile(r"\A\s*---[ \t]*\r?\n.*?^---[ \t]*$", re.M | re.S)
_WRAPPED = re.compile(r"\A(?P<before>[^\n]{0,300}\n\s*)??\s*```(?P<kind>(?:markdown|md|html|text|xml)?)[ \t]*\r?\n(?P<body>.*?)(?P<end>\r?\n?[ \t]*```[ \t]*)?\s*\Z", re.S | re.I)
_PAGE = re.compile(r"\s*(?:<!doctype|<html|<head|<body|<h[1-6]\b|<p\b)", re.I)
_HEADING = re.compile(r"^#{1,6} ", re.M)
_FENCE = re.compile(r"^[ \t]*(```|~~~)[^\n]*$", re.M)
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|</?[A-Za-z][^<>]*>", re.S)
_ALNUM = re.compile(r"[\W_]+")
#: White space and characters that cannot be seen.
UNSEEN = "".join(
    chr(c)
    for c in chain(
        range(0x21), range(0x7F, 0xA1), (0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x1680, 0x17B4, 0x17B5), range(0x180B, 0x1810), range(0x2000, 0x2010), range(0x2028, 0x2030), range(0x205F, 0x2070), (0x2800, 0x3000, 0x3164), range(0xFE00, 0xFE10), (0xFEFF, 0xFFA0)
    )
)
#: A line that shows at once that a text has something to read.
_READS = re.compile(r"^(?:[#>*-]+ )*[^\W_]+[ ,.]", re.M)
_READABLE_ASIDE = re.compile(r"!\[\s*\]\([^)]*\)|^[ \t]*(?:```|~~~)[^\n]*$|^::\w*[ \t]*$|&(?:nbsp|\#160|zwnj|zwj|shy|\#x?[0-9a-fA-F]+);", re.M)
#: What gateways put after a cut.
_MARK = re.compile(r"(?:\s*(?:�+|…|\.{3,}|\[(?:\.{3}|…|[^\[\]\n]{0,30}(?:truncat|cut|обрезан|сокращ|gekürzt|cortado|truncado)[^\[\]\n]{0,30})\]|<\|?(?:endoftext|im_end|eot)\|?>))+\Z", re.I)

#: Letters of an answer that are looked for in its source, and what of an answer isn't text of its source.
TAIL = 24
_NOT_IN_SOURCE = re.compile(r"!\[[^\]\n]*(?:\](?:\([^)\n]*\)?)?)?|^[ \t]*(?:```|~~~)[^\n]*$|^::\w*|<[^<>]*>?|&\w*;?", re.M)


def unwrapped(markdown: str) -> tuple[str, bool]:
    """The text inside one fence around the whole answer, and whether that fence is left open; else the text itself.

    A short line of preface may stand before the fence. A fence that is closed inside and
    followed by text is no wrapping.
    """
    m = _WRAPPED.match(markdown)
    if not m or (m.group("before") or "").lstrip().startswith(("#", "|", "-", ">", "<", ":", "!", "`")):
        return markdown, False
    body, kind, closed = m.group("body"), m.group("kind").lower(), m.group("end") is not None
    if kind == "html" and not _PAGE.match(body) or kind in ("", "text", "xml") and not (closed and (_PAGE.match(body) or _HEADING.search(body))):
        return markdown, False
    if len(_FENCE.findall(body)) % 2 and closed:  # what closes last belongs to a block inside
        return body + m.group("end"), True
    return body, not closed


def is_empty(markdown: str | None) -> bool:
    """Whether there is nothing to read but white space, invisible characters, bare markup or front matter."""
    if not markdown:
        return True
    if not markdown.lstrip().startswith("---") and "<!--" not in markdown and _READS.search(markdown):
        return False
    text = unwrapped(_FRONT.sub("", markdown))[0]
    text = _TAG.sub(" ", _READABLE_ASIDE.sub(" ", _FRONT.sub("", text)))
    return not any(c.isalnum() for c in text)


def letters(text: str) -> str:
    """Letters and digits alone."""
    return _ALNUM.sub("", text)


def source_letters(chapter_html: str) -> str:
    """Letters and digits of a chapter's text without tags, those of its code samples included."""
    return letters(_TAG.sub(" ", html.unescape(_TAG.sub(" ", chapter_html))))


def squeezed(text: str) -> str:
    """Without white space, in lower case."""
    return "".join(text.split()).lower()


@dataclass(frozen=True)
class Ending:
    mark: str  # what stands after the text: "bytes", "dots", "ellipsis" or ""
    kind: str  # open: inside a fence, table row, link or code; stop: at a stop; bare: at a word; none: no text
    line: str  # kind of the last line: prose, item, caption, heading, table, code, other
    words: tuple[str, str]  # the last two words of the last line
    tail: str  # the last TAIL letters and digits


def _tail(body: str) -> str:
    """The last TAIL letters and digits that can stand in a source. Windows at the end begin at a line and at no place inside a tag, so they give what the whole text gives."""
    most = 500
    while True:
        begin = body.rfind("\n", 0, max(0, len(body) - most)) + 1
        if (tag := body.rfind("<", 0, begin)) > body.rfind(">", 0, begin):
            begin = tag
        found = letters(_NOT_IN_SOURCE.sub(" ", body[begin:]))
        if len(found) >= TAIL or not begin:
            return found[-TAIL:]
        most *= 8


def _marks(body: str) -> re.Match | None:
    """What was put after a text. The window grows until what stands before the match has room for another mark."""
    most = 200
    while True:
        begin = max(0, len(body) - most)
        found = _MARK.search(body, begin)
        if not begin or not found and not body[begin:].isspace() or found and found.start() - begin > 100:
            return found
        most *= 8


def kept_part(text: str) -> str:
    """A text without what may have been put after a cut: white space, dots, broken and unseen characters, notes."""
    body = text.rstrip(UNSEEN)
    found = _marks(body)
    return body[: found.start()].rstrip(UNSEEN) if found else body


_STOP = re.compile(r"[.!?;:|>}\])\"»”’'`*]\Z|\Z(?<=::)")
_WORDS = re.compile(r"[^\W_]+")
_INLINE = re.compile(r"`[^`\n]*`")


def ending(markdown: str) -> Ending:
    """How a text ends."""
    body = unwrapped(markdown.rstrip(UNSEEN))[0]
    if front := _FRONT.match(body):
        body = body[front.end() :]
    body = body.rstrip(UNSEEN)
    found = _marks(body)
    mark = ""
    if found:
        mark = "bytes" if "�" in found.group() else "ellipsis" if found.group().strip() == "…" else "dots"
        body = body[: found.start()]
    begin = body.rfind("\n") + 1
    last = body[begin:]
    fences = _FENCE.findall(body)
    inside = len(fences) % 2 == 1
    stripped = last.strip()
    if not stripped:
        kind, line = "none", "other"
    elif stripped.startswith(("```", "~~~")) and not inside:
        kind, line = "stop", "code"
    elif inside:
        kind, line = "open", "code"
    elif stripped.startswith("|"):
        kind, line = ("stop" if stripped.endswith("|") and len(stripped) > 1 else "open"), "table"
    elif stripped.startswith("!["):
        kind, line = ("stop" if re.search(r"\]\([^)\s]*\)\Z", stripped) else "open"), "other"
    elif stripped.startswith("::"):
        kind, line = ("stop" if stripped == "::" else "open"), "other"
    else:
        line = "heading" if stripped.startswith("#") else "caption" if re.match(r">\s*\w+ \d+\s*[–—-]", stripped) else "item" if re.match(r"[-*+]\s|\d+[.)]\s", stripped) else "prose"
        plain = _INLINE.sub("x", stripped)
        if "`" in plain:
            kind = "open"
        elif plain.count("(") > plain.count(")") or plain.count("«") > plain.count("»") or re.match(r"<(?:tr|td|th|table|p|li)\b", stripped) and not stripped.endswith(">"):
            kind = "open"
        else:
            kind = "stop" if _STOP.search(stripped) else "bare"
    tokens = _WORDS.findall(last)[-2:]
    words = ("", *tokens)[-2:] if tokens else ("", "")
    return Ending(mark, kind, line, (words[0].lower(), words[1].lower()), _tail(body))


def place_in_source(tail: str, chapter_html: str | None) -> str:
    """Where the last letters of an answer stand in its source: end, inside, elsewhere (not in it) or unknown."""
    if not chapter_html or len(tail) < 8:
        return "unknown"
    near = chapter_html[-6 * TAIL - 400 :]
    # A cut through a tag would leave half of it; begin after the first whole one.
    if source_letters(near[near.find(">") + 1 :] if "<" not in near[: near.find(">") + 1] else near).endswith(tail):
        return "end"
    whole = source_letters(chapter_html)
    if whole.endswith(tail):
        return "end"
    if tail in whole:
        return "inside"
    return "elsewhere"


_BLOCK_TAG = re.compile(r"(?:<|&(?:amp;)*lt;)/?(?:p|h[1-6]|li|ul|ol|div|pre|img|br|html|body|section|article|blockquote)\b[^<>\n]{0,300}?(?:>|&(?:amp;)*gt;)", re.I)


def markup_share(markdown: str) -> float:
    """Block tags (tables aside, also escaped) for each 100 characters of text outside code samples of Markdown."""
    body = unwrapped(markdown)[0]
    outside, at, is_open = [], 0, False
    for m in _FENCE.finditer(body):
        if not is_open:
            outside.append(body[at : m.start()])
        at, is_open = m.end(), not is_open
    if not is_open:
        outside.append(body[at:])
    text = "".join(outside)
    return 100 * len(_BLOCK_TAG.findall(text)) / max(100, len(text))
