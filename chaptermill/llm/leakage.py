"""Evaluation items leaking into a corpus: BM25 retrieval with block-max WAND, then exact verification.

The test items are indexed in an inverted index with BM25 weights; its terms are words with
the two that follow them. Every passage of every corpus text is a query: each run of as many
words as a leak has. The threshold of a passage is what an item scores that holds each of
its terms once, so every item that shares the passage reaches it and nothing is lost to the
threshold.

Postings are in blocks of items with the maximum that a term can add in each. A bound counts
a term at one occurrence at most, for that is all the threshold asks; a block's maximum is
then 0 or the term's whole share, which is one bit, and a block can reach the threshold only
if it has the bits of all terms of the passage. So bounds are combined by AND over all
passages of a batch at once. In blocks that are left the postings of the passage's rarest
term are candidates; the other terms are looked up from rare to common, and a candidate
whose bound falls below the threshold goes at once. What reaches it is verified word by word.

A word is an unbroken run of letters or digits, compared without case. Null and empty
texts and texts without such a stretch give no row; items of fewer words than the stretch
can't leak; repeated rows give one row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .arrowtext import sliced, spread

#: Words in a row that make a leak.
STRETCH = 12
K1, B = 1.2, 0.75
#: Words of a term, and of a part of an item (parts of one item overlap by one word less than the stretch).
TERM, PART = 3, 64
#: Parts of items in a block at least, and bytes of the bits of all blocks at most.
BLOCK, BLOCK_BYTES = 16, 32 << 20
#: Characters of items in one index, which then takes about 200 MB at most; more items are more indexes, each a pass over the corpus.
CHARS_AT_ONCE = 40_000_000
#: Bytes of block bits and pairs of passage and block that one step works on.
STEP_BYTES, STEP_PAIRS = 32 << 20, 1 << 18

_WORD = re.compile(r"[^\W_]+")
_WORD_OR_END = re.compile(r"[^\W_]+|\0")


@dataclass
class Index:
    ids: list
    stretch: int
    words: dict[str, int]
    grams: list[np.ndarray]  # for each further word of a term: keys (number of the term so far * number of words + word), in order
    item: np.ndarray  # number of the item of each part
    flat: np.ndarray  # the words of all parts
    bounds: np.ndarray  # where each part begins in flat
    keys: np.ndarray  # postings: term * number of parts + part, in order
    weights: np.ndarray  # BM25 weight of each posting
    once: np.ndarray  # BM25 weight of one occurrence in each part, over the idf
    idf: np.ndarray
    holders: np.ndarray  # parts that hold each term
    block: int  # parts in a block
    bits: np.ndarray  # blocks that hold each term

    @classmethod
    def of(cls, ids: list, texts: list[str | None], stretch: int = STRETCH) -> Index:
        cut = [_WORD.findall((t or "").casefold()) for t in texts]
        kept = [(i, w) for i, w in zip(ids, cut, strict=True) if len(w) >= stretch]
        size = max(PART, 2 * stretch)
        parts = [(n, w[k : k + size]) for n, (_, w) in enumerate(kept) for k in range(0, max(1, len(w) - stretch + 1), size - stretch + 1)]
        words: dict[str, int] = {}
        flat = np.fromiter((words.setdefault(w, len(words)) for _, ws in parts for w in ws), np.int32)
        sizes = np.array([len(w) for _, w in parts], np.int64)
        part = np.repeat(np.arange(len(parts)), sizes)
        grams: list[np.ndarray] = []
        term, at = flat.astype(np.int64), np.arange(len(flat))
        for k in range(1, min(TERM, stretch)):
            here = (at + k < len(flat)) & (part[np.minimum(at + k, len(flat) - 1)] == part[at]) if len(flat) else np.zeros(0, bool)
            at, term = at[here], term[here] * len(words) + flat[at[here] + k]
            known, term = np.unique(term, return_inverse=True)
            grams.append(known)
        n, n_terms = max(1, len(parts)), len(grams[-1]) if grams else len(words)
        keys, counts = np.unique(term * n + part[at], return_counts=True)
        term, of = keys // n, keys % n
        holders = np.bincount(term, minlength=n_terms)
        idf = np.log1p((n - holders + 0.5) / (holders + 0.5))
        norm = K1 * (1 - B + B * sizes / max(1.0, sizes.mean() if len(sizes) else 1.0))
        weights = idf[term] * counts * (K1 + 1) / (counts + norm[of]) if len(keys) else np.zeros(0)
        block = BLOCK
        while n_terms * (-(-n // (8 * block))) > BLOCK_BYTES:
            block *= 2
        bits = np.zeros((n_terms, -(-n // (8 * block))), np.uint8)
        np.bitwise_or.at(bits, (term, of // block // 8), np.uint8(128) >> (of // block % 8).astype(np.uint8))
        return cls([i for i, _ in kept], stretch, words, grams, np.array([x for x, _ in parts], np.int64), flat, np.concatenate(([0], np.cumsum(sizes))), keys, weights.astype(np.float32), (K1 + 1) / (1 + norm), idf, holders, block, bits)

    def terms_of(self, words: np.ndarray) -> np.ndarray:
        """The term that begins at each word, or -1 if it stands in no item."""
        term = words.astype(np.int64)
        for k, known in enumerate(self.grams, 1):
            at = np.flatnonzero((term[: len(words) - k] >= 0) & (words[k:] >= 0))
            key = term[at] * len(self.words) + words[at + k]
            place = np.minimum(np.searchsorted(known, key), len(known) - 1)
            term = np.full(len(words), -1, np.int64)
            same = known[place] == key
            term[at[same]] = place[same]
        return term

    def retrieve(self, terms: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, part) of all parts that reach the thresholds of the passages terms[start : start + size]."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        step = max(1024, STEP_BYTES // (4 * self.bits.shape[1]))
        for low in range(0, len(starts), step):
            some = starts[low : low + step]
            bits = self._all_terms(terms, some, size)
            there = np.flatnonzero(bits.any(1))
            for k in range(0, len(there), 4096):
                row, block = np.nonzero(np.unpackbits(bits[there[k : k + 4096]], axis=1))
                for p in range(0, len(row), STEP_PAIRS):
                    found.append(self._reached(terms, some[there[k + row[p : p + STEP_PAIRS]]], block[p : p + STEP_PAIRS], size))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])

    def _all_terms(self, terms: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        """Blocks that have all terms of each passage, as bits. Passages that follow one another closely share their work."""
        first, last = starts[0], starts[-1] + size
        if len(starts) * 2 < last - first:
            bits = self.bits[terms[starts]]
            for k in range(1, size):
                bits &= self.bits[terms[starts + k]]
            return bits
        bits = self.bits[np.maximum(terms[first:last], 0)]
        width = 1
        while width * 2 <= size:
            bits = bits[:-width] & bits[width:]
            width *= 2
        rest = size - width
        return (bits[: len(bits) - rest] & bits[rest:])[starts - first]

    def _reached(self, terms: np.ndarray, start: np.ndarray, block: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The parts in blocks that reach the thresholds of passages."""
        passage = terms[start[:, None] + np.arange(size)]
        passage = np.take_along_axis(passage, np.lexsort((passage, self.holders[passage]), axis=1), 1)  # rare terms first, equal ones together
        n = max(1, len(self.item))
        low, high = np.searchsorted(self.keys, passage[:, 0] * n + block * self.block), np.searchsorted(self.keys, passage[:, 0] * n + np.minimum((block + 1) * self.block, n))
        many = high - low
        at = np.repeat(np.arange(len(start)), many)
        place = np.repeat(low, many) + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
        part, score, threshold = self.keys[place] % n, self.weights[place].astype(np.float64), self.idf[passage[at, 0]]
        for k in range(1, size):
            term, new = passage[at, k], passage[at, k] != passage[at, k - 1]  # a term that a passage has twice counts once
            key = term * n + part
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            held = self.keys[place] == key  # without it the bound is below the threshold
            score, threshold = score + self.weights[place] * new, threshold + self.idf[term] * new
            if not held.all():
                at, part, score, threshold = at[held], part[held], score[held], threshold[held]
        reached = score >= threshold * self.once[part] * (1 - 1e-5)
        return start[at[reached]], part[reached]

    def leaks(self, texts: list[str | None]) -> set[tuple[int, int]]:
        """(row, item number) of each item that has a whole stretch in the row's text."""
        joined = "\0".join(t.replace("\0", " ") if t else "" for t in texts).casefold()
        found = _WORD_OR_END.findall(joined)
        words = np.fromiter(map(self.words.get, found, repeat(-1)), np.int32, len(found))
        size = self.stretch - len(self.grams)  # terms of a passage
        if len(words) < self.stretch or not self.ids:
            return set()
        terms = self.terms_of(words)
        unknown = np.concatenate(([0], np.cumsum(terms < 0)))
        starts = np.flatnonzero(unknown[size:] == unknown[:-size])
        if not len(starts):
            return set()
        start, part = self.retrieve(terms, starts, size)
        ends = np.flatnonzero(np.fromiter(map("\0".__eq__, found), bool, len(found)))
        pair = np.searchsorted(ends, start) * len(self.ids) + self.item[part]
        order = np.argsort(pair, kind="stable")
        pairs, first = np.unique(pair[order], return_index=True)
        out = set()
        for p, a, b in zip(pairs.tolist(), first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
            for i in order[a:b]:  # the first one, as a rule
                if _holds(self.flat[self.bounds[part[i]] : self.bounds[part[i] + 1]].tobytes(), words[start[i] : start[i] + self.stretch].tobytes()):
                    out.add(divmod(p, len(self.ids)))
                    break
        return out


def _holds(words: bytes, some: bytes) -> bool:
    """Whether a sequence of 32-bit numbers holds another one."""
    at = words.find(some)
    while at >= 0 and at % 4:
        at = words.find(some, at + 1)
    return at >= 0


def leaked(corpus: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, stretch: int = STRETCH) -> DataFrame:
    """(key, item_key) of every corpus row and test item that have `stretch` words in a row in common.

    The corpus is read once for each CHARS_AT_ONCE characters of items and never shuffled; only
    results are, to drop repeated ones. An index is broadcast, of a size bounded by its characters.
    """
    own = items.select(F.col(item_key).alias("i"), F.col(item_text).alias("t")).filter("t is not null")
    parts = max(1, -(-(own.agg(F.sum(F.length("t"))).first()[0] or 0) // CHARS_AT_ONCE))
    rows = spread(corpus.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("t is not null"))
    kind, item_kind = rows.schema["k"].dataType.simpleString(), own.schema["i"].dataType.simpleString()
    item_type = to_arrow_type(own.schema["i"].dataType)
    found = None
    for part in range(parts):
        block = own if parts == 1 else own.filter(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part)
        listed = sorted(set(map(tuple, block.collect())))
        index = corpus.sparkSession.sparkContext.broadcast(Index.of([i for i, _ in listed], [t for _, t in listed], stretch))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            own = index.value
            for batch in sliced(batches, "t"):
                hits = sorted(own.leaks(batch.column("t").to_pylist()))
                if hits:
                    keys = batch.column("k").take(pa.array([r for r, _ in hits], pa.int64()))
                    yield pa.RecordBatch.from_arrays([keys, pa.array([own.ids[n] for _, n in hits], item_type)], ["k", "i"])

        one = rows.mapInArrow(run, f"k {kind}, i {item_kind}")
        found = one if found is None else found.unionByName(one)
    return found.distinct().withColumnsRenamed({"k": key, "i": item_key})
