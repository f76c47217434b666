"""Visually identical text with different characters: one consistent form of a text.

Texts that look the same get equal forms. Arrow text is copied to numpy code-point
arrays; a lookup table gives each code point its expansion (full-width and other
presentation forms, decomposed accents, look-alike letters, nothing for invisible
characters), gathers and expansion offsets apply it to a whole batch, and marks are put
in canonical order and composed by vector passes. No string call is made per row.

The form is readable: after comparison letters are found, a word that holds a letter
only Cyrillic has is written in Cyrillic letters throughout. Case, spelling, accents,
punctuation and spaces are kept, since they can be seen.

Null gives null. An empty text and one of invisible characters only give the empty text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import code_points, from_code_points, sliced

# Letters of other scripts that are drawn like a Latin letter.
LOOKS_LIKE = {
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "α": "a", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J",
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѵ": "V", "Ү": "Y", "Ӏ": "I", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ӕ": "Æ",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h",
    "ѵ": "v", "ү": "y", "ӏ": "l", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӕ": "æ", "ә": "ə", "Ә": "Ə",
    # Armenian
    "Օ": "O", "օ": "o", "հ": "h",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮓ": "Z", "Ꮩ": "V",
    "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B", "Ꮐ": "G",
    # Coptic
    "Ⲁ": "A", "Ⲃ": "B", "Ⲉ": "E", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X",
    "ⲟ": "o", "ⲣ": "p", "ⲥ": "c",
    # Lisu
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S",
    "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    # Latin letters drawn like others, hyphens, apostrophes
    "ɑ": "a", "ɡ": "g", "ı": "i", "ǝ": "ə", "‐": "-", "‑": "-", "ʼ": "’",
}

#: Compatibility decompositions that do not change what is seen.
SAME_LOOK = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>")
_PLANES = (range(0x30000), range(0xE0000, 0xE1000))
_BITS = 21


@lru_cache(1)
def _tables() -> dict[str, np.ndarray]:
    """length, start: the expansion of each code point in pool (start -1: itself); ccc; pair, whole: compositions."""
    top = 0x110000
    length, start, ccc = np.ones(top, np.uint8), np.full(top, -1, np.int32), np.zeros(top, np.uint8)
    letter, cyrillic = np.zeros(top, bool), np.zeros(top, bool)
    look = {ord(a): ord(b) for a, b in LOOKS_LIKE.items()}
    pool: list[int] = []
    pairs: dict[int, int] = {}

    def expanded(c: int) -> tuple[int, ...]:
        ch = chr(c)
        kind = unicodedata.category(ch)
        if kind in ("Zs", "Zl", "Zp") or ch in "\t\n\v\f\r\x85⠀":
            return (32,)
        if kind in ("Cf", "Cc") or c in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0x180B <= c <= 0x180F or 0xFE00 <= c <= 0xFE0F or 0xE0100 <= c <= 0xE01EF:
            return ()
        parts = unicodedata.decomposition(ch).split()
        if parts and parts[0][0] == "<":
            tag, parts = parts[0], parts[1:]
            if tag not in SAME_LOOK or parts[0] == "0020":
                parts = []
        if parts:
            return tuple(x for p in parts for x in expanded(int(p, 16)))
        return (look.get(c, c),)

    for plane in _PLANES:
        for c in plane:
            if 0xD800 <= c < 0xE000:
                continue
            ch = chr(c)
            ccc[c] = unicodedata.combining(ch)
            kind = unicodedata.category(ch)
            letter[c] = kind[0] in "LM"
            cyrillic[c] = kind[0] == "L" and 0x400 <= c < 0x530
            to = expanded(c)
            if to != (c,):
                length[c], start[c] = len(to), len(pool)
                pool.extend(to)
            canonical = unicodedata.decomposition(ch)
            if canonical and canonical[0] != "<" and " " in canonical:
                a, b = (int(x, 16) for x in canonical.split())
                if unicodedata.normalize("NFC", chr(a) + chr(b)) == ch:
                    pairs[a << _BITS | b] = c
    # What a Latin letter is in a Cyrillic word; composed letters by rule from their bases.
    back = np.arange(top, dtype=np.uint32)
    twins = {v: k for k, v in reversed(LOOKS_LIKE.items()) if 0x400 <= ord(k) < 0x530}
    for latin, own in twins.items():
        back[ord(latin)] = ord(own)
    for key, c in pairs.items():
        base, mark = key >> _BITS, key & ((1 << _BITS) - 1)
        own = twins.get(chr(base)) if base < top else None
        both = unicodedata.normalize("NFC", own + chr(mark)) if own else ""
        if len(both) == 1:
            back[c] = ord(both)
    keys = np.array(sorted(pairs), np.int64)
    return {
        "length": length, "start": start, "pool": np.array(pool or [0], np.uint32), "ccc": ccc, "letter": letter, "cyrillic": cyrillic,
        "back": back, "pair": keys, "whole": np.array([pairs[int(k)] for k in keys], np.uint32),
    }


def _expand(points: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = _tables()
    size = t["length"][points].astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(size)))
    source = np.repeat(points, size)
    within = np.arange(ends[-1], dtype=np.int64) - np.repeat(ends[:-1], size)
    first = t["start"][source]
    own = first < 0
    out = np.where(own, source, t["pool"][np.where(own, 0, first + within)])
    return out.astype(np.uint32), ends[rows]


def _compose(points: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Canonical order of marks, then composition of each mark with its base unless one of its class stands between."""
    t = _tables()
    ccc = t["ccc"][points]
    marks = np.flatnonzero(ccc)
    jamo = ((points >= 0x1161) & (points < 0x11C3)).any() if len(points) else False
    keep = np.ones(len(points), bool)
    points = points.copy()
    if len(marks):
        first_of_row = np.zeros(len(points) + 1, bool)
        first_of_row[rows] = True
        breaks = np.ones(len(marks), bool)
        breaks[1:] = (np.diff(marks) != 1) | first_of_row[marks[1:]]
        run = np.cumsum(breaks) - 1
        order = np.lexsort((np.arange(len(marks)), ccc[marks], run))
        points[marks] = points[marks[order]]
        classes = ccc[marks[order]]
        run_start = np.flatnonzero(breaks)
        run_size = np.diff(np.append(run_start, len(marks)))
        base = marks[run_start] - 1
        has_base = (marks[run_start] > 0) & ~first_of_row[marks[run_start]]
        blocked = np.zeros(len(run_start), np.int64)
        alive, k = np.flatnonzero(has_base), 0
        while len(alive):
            at = run_start[alive] + k
            mark, cls = points[marks[at]].astype(np.int64), classes[at].astype(np.int64)
            key = points[base[alive]].astype(np.int64) << _BITS | mark
            where = np.minimum(np.searchsorted(t["pair"], key), len(t["pair"]) - 1)
            fits = (t["pair"][where] == key) & (blocked[alive] < cls)
            points[base[alive[fits]]] = t["whole"][where[fits]]
            keep[marks[at[fits]]] = False
            blocked[alive[~fits]] = cls[~fits]
            k += 1
            alive = alive[run_size[alive] > k]
    if jamo:  # conjoining jamo: leading + vowel, then syllable + trailing
        for low, high, size, base_of in ((0x1161, 0x1176, 28, lambda a: (a >= 0x1100) & (a < 0x1113)), (0x11A8, 0x11C3, 1, lambda a: (a >= 0xAC00) & (a < 0xD7A4) & ((a - 0xAC00) % 28 == 0))):
            left = np.flatnonzero(keep)
            a, b = points[left[:-1]].astype(np.int64), points[left[1:]].astype(np.int64)
            same = np.searchsorted(rows, left[:-1], "right") == np.searchsorted(rows, left[1:], "right")
            hit = base_of(a) & (b >= low) & (b < high) & same
            value = (0xAC00 + ((a - 0x1100) * 21 + (b - 0x1161)) * 28) if size == 28 else (a + b - 0x11A7)
            points[left[:-1][hit]] = value[hit]
            keep[left[1:][hit]] = False
    ends = np.concatenate(([0], np.cumsum(keep)))
    return points[keep], ends[rows]


def _one_script(points: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Words that hold a letter only Cyrillic has are written in Cyrillic throughout; a function of the comparison form alone."""
    t = _tables()
    letter = t["letter"][points]
    if not letter.any():
        return points
    cut = np.zeros(len(points) + 1, bool)
    cut[rows] = True
    cut[:-1] |= ~letter
    cut[1:] |= ~letter
    word = np.cumsum(cut[:-1]) - 1
    has = np.zeros(word[-1] + 1, bool)
    has[word[t["cyrillic"][points]]] = True
    return np.where(has[word], t["back"][points], points).astype(np.uint32)


def _trim(points: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without white space at the ends of a row, which cannot be seen."""
    seen = np.flatnonzero(points != 32)
    if len(seen) == len(points):
        return points, rows
    row = np.searchsorted(rows, np.arange(len(points)), "right") - 1
    first = np.full(len(rows) - 1, len(points))
    last = np.full(len(rows) - 1, -1)
    np.minimum.at(first, row[seen], seen)
    np.maximum.at(last, row[seen], seen)
    at = np.arange(len(points))
    keep = (at >= first[row]) & (at <= last[row])
    return points[keep], np.concatenate(([0], np.cumsum(keep)))[rows]


def forms(texts: pa.Array) -> pa.Array:
    """The consistent form of each text; null stays null."""
    points, rows = code_points(texts)
    points, rows = _expand(points, rows)
    points, rows = _compose(points, rows)
    points, rows = _trim(points, rows)
    nulls = texts.is_null().to_numpy(zero_copy_only=False) if texts.null_count else None
    return from_code_points(_one_script(points, rows), rows, nulls)


def consistent_form(df: DataFrame, text: str, out: str = "form") -> DataFrame:
    """df's columns and `out`, the consistent form of column `text`.

    A column already named `out` is replaced. Repeated rows stay repeated.
    """
    kept = df.drop(out) if out != text else df.withColumn("__text", F.col(text)).drop(text)
    source = text if out != text else "__text"
    names = [c for c in kept.columns if c != "__text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, source):
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), forms(batch.column(source)).cast(pa.string())], [*names, out])

    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([*(kept.schema[n] for n in names), StructField(out, StringType())])
    return kept.mapInArrow(run, schema)


def same_looking(items: DataFrame, item_id: str, text: str, approved: DataFrame, approved_id: str, approved_text: str) -> DataFrame:
    """(item_id, approved_id) of items whose text looks the same as an approved text but is made of other characters.

    Null and empty texts match nothing; repeated rows give one row. The join is on the
    form: Spark broadcasts the approved side only below its own size threshold and
    otherwise shuffles both sides, where skewed forms are split at run time.
    """
    left = consistent_form(items.select(F.col(item_id).alias("i"), F.col(text).alias("t")), "t", "f")
    right = consistent_form(approved.select(F.col(approved_id).alias("a"), F.col(approved_text).alias("at")), "at", "f").filter(F.length("f") > 0)
    found = left.filter(F.length("f") > 0).join(right, "f").filter(F.col("t") != F.col("at"))
    return found.select(F.col("i").alias(item_id), F.col("a").alias(approved_id)).distinct()
