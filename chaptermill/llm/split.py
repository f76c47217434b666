"""Splitting oversized HTML at natural boundaries by lexical cohesion, with overlap.

A text of more than `limit` code points is cut into pieces of at most `limit`; each piece
after the first begins with exactly the last `overlap` code points of the piece before it.

Gaps between blocks of the text are scored by the similarity of the words in a sliding
window before and after them, words that stand all over the text weighing less; valleys of
that curve mark changes of topic. Within the
window of sizes a piece may have, the cut goes to the gap with the deepest valley (of
equally deep ones the last). Where the window has no gap between blocks, the cut goes to
the end of a sentence, else to white space, else to the last place that splits no tag,
entity or accented letter, else to the limit.

Null texts and texts of at most `limit` give no piece; a repeated row gives its pieces once.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import sliced

LIMIT, OVERLAP = 4000, 200
#: Words on each side of a gap that are compared there, and gaps compared at once.
WINDOW_WORDS, GAPS_AT_ONCE = 60, 256

_GAP = re.compile(
    r"</(?:p|li|tr|table|tbody|ul|ol|pre|div|h[1-6]|blockquote|section|article|dl|dd|dt|figure|figcaption|details)\s*>(?:\s*</(?:tr|table|tbody|ul|ol|div|blockquote|section|article|dl|figure|details)\s*>)*\s*"
    r"|<[bh]r\b[^<>]*>\s*|\n\s*\n",
    re.I,
)
_WORD = re.compile(r"<[^<>]*>|([^\W\d_]{2,})")
_SENTENCE = re.compile(r"[.!?…]+[\"'»”)\]]*\s+")
_SPACE = re.compile(r"\s+")


def rarity(words: np.ndarray) -> np.ndarray:
    """Weight of each word (a number from 0): how few of the text's stretches of WINDOW_WORDS words have it; a 0 at the end for the place outside a text."""
    stretches = -(-len(words) // WINDOW_WORDS)
    pairs = np.unique(words.astype(np.int64) * max(1, stretches) + np.arange(len(words)) // WINDOW_WORDS)
    having = np.bincount(pairs // max(1, stretches), minlength=int(words.max()) + 1 if len(words) else 0)
    return np.append(np.log((stretches + 1) / np.maximum(having, 1)), 0.0)


def _likeness(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cosine of the weighted counts of words in the windows before and after each place; words are numbers from 0."""
    weight = rarity(words) ** 2
    padded = np.concatenate([np.full(WINDOW_WORDS, -1, np.int32), words, np.full(WINDOW_WORDS, -1, np.int32)])
    window = np.arange(WINDOW_WORDS)
    out = []
    for some in np.array_split(at, range(GAPS_AT_ONCE, len(at), GAPS_AT_ONCE)):
        before, after = padded[some[:, None] + window], padded[some[:, None] + WINDOW_WORDS + window]
        shared = lambda a, b: ((a[:, :, None] == b[:, None, :]).sum(2) * weight[a]).sum(1)
        norm = np.sqrt(shared(before, before) * shared(after, after))
        out.append(shared(before, after) / np.maximum(norm, 1e-9))
    return np.concatenate(out)


def valley_depths(text: str, gaps: list[int]) -> np.ndarray:
    """How deep the valley of word similarity is at each gap (sorted places in text)."""
    if not gaps:
        return np.zeros(0)
    places, words = [], []
    numbers: dict[str, int] = {}
    for m in _WORD.finditer(text):
        if m.lastindex:
            places.append(m.start())
            words.append(numbers.setdefault(m.group(1).lower(), len(numbers)))
    likeness = _likeness(np.array(words, np.int32), np.searchsorted(np.array(places, np.int64), np.array(gaps, np.int64)))

    def peaks(s: np.ndarray) -> np.ndarray:  # the top reached by climbing to the left
        starts = np.ones(len(s), bool)
        starts[1:] = s[:-1] < s[1:]
        return s[np.flatnonzero(starts)][np.cumsum(starts) - 1]

    return peaks(likeness) + peaks(likeness[::-1])[::-1] - 2 * likeness


def _last(pattern: re.Pattern, text: str, low: int, high: int) -> int:
    """The last end of a match in (low, high] that lies outside a tag, or -1."""
    found = -1
    for m in pattern.finditer(text, low, high):
        if low < m.end() <= high and text.rfind("<", low, m.start()) <= text.rfind(">", low, m.start()):
            found = m.end()
    return found


def _unnatural(text: str, low: int, high: int) -> int:
    cut = high
    tag = text.rfind("<", low, cut)
    if tag > low and text.find(">", tag, cut) < 0:
        cut = tag
    entity = text.rfind("&", max(low, cut - 10), cut)
    if entity > low and ";" in text[cut : cut + 9] and ";" not in text[entity:cut]:
        cut = entity
    while cut > low + 1 and cut < len(text) and (unicodedata.combining(text[cut]) or text[cut] in "‍️" or text[cut - 1] == "‍"):
        cut -= 1
    return cut if cut > low + 1 else high


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(begin, end) of each piece of text; one piece if it isn't longer than limit."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap has to be less than half of limit")
    if len(text) <= limit:
        return [(0, len(text))]
    gaps = sorted({m.end() for m in _GAP.finditer(text)} - {len(text)})
    depth = valley_depths(text, gaps)
    out, begin, done = [], 0, 0  # done: end of the piece before
    while len(text) - begin > limit:
        high = begin + limit
        cut = -1
        for low in (done + (high - done) // 2, max(done, overlap) + (high - done) // 10):
            a, b = bisect_right(gaps, low), bisect_right(gaps, high)
            if a < b:
                best = depth[a:b]
                cut = gaps[a + len(best) - 1 - int(np.argmax(best[::-1]))]
                break
        if cut < 0:
            low = max(done, overlap) + (high - done) // 4
            cut = _last(_SENTENCE, text, low, high)
            cut = cut if cut > 0 else _last(_SPACE, text, low, high)
            cut = cut if cut > 0 else _unnatural(text, low, high)
        out.append((begin, cut))
        begin, done = cut - overlap, cut
    return [*out, (begin, len(text))]


def split_oversized(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, piece_no from 1, n_pieces, begin, piece) of each text of more than limit code points.

    Shorter and null texts never leave the JVM. Only oversized rows are shuffled, to drop repeated ones.
    """
    large = df.select(F.col(key).alias("k"), F.col(text).alias("t")).filter(F.length("t") > limit).dropDuplicates(["k"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "t"):
            keys, no, n, begins, pieces = [], [], [], [], []
            for k, t in zip(batch.column("k").to_pylist(), batch.column("t").to_pylist(), strict=True):
                spans = cuts(t, limit, overlap)
                for i, (a, b) in enumerate(spans, 1):
                    keys.append(k), no.append(i), n.append(len(spans)), begins.append(a), pieces.append(t[a:b])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, batch.column("k").type), pa.array(no, pa.int32()), pa.array(n, pa.int32()), pa.array(begins, pa.int32()), pa.array(pieces, pa.string())],
                ["k", "piece_no", "n_pieces", "begin", "piece"],
            )

    kind = large.schema["k"].dataType.simpleString()
    return large.mapInArrow(run, f"k {kind}, piece_no int, n_pieces int, begin int, piece string").withColumnRenamed("k", key)
