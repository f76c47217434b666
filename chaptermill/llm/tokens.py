"""Encoding of a corpus with a public byte-level BPE vocabulary.

A sentencepiece BPE model is serialised directly from the rank file: each token becomes a
piece of byte-mapped characters (one printable character per byte) scored by its negative
rank, with identity normalisation. Texts are cut into pre-tokens by the vocabulary's
pattern, each distinct pre-token of a batch is encoded once, and decoding is the inverse
mapping of the pieces. Nothing is trained.

A null and an empty text both give the empty list; no text gives a special token.
"""

from __future__ import annotations

import base64
import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import sliced, spread

#: Folder of the vocabulary files; a parameter of every function here.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
#: Distinct pre-tokens whose ids a worker keeps.
KEPT = 150_000

# Fixed value: the pattern that cuts texts into pre-tokens before merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_EXACT = regex.compile(PATTERN)
#: The same for texts in which all numbers are decimal digits and all white space is common; the standard library is faster.
_COMMON = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Letters, digits and signs for which both patterns agree; any text with another character takes the exact one.
_UNCOMMON = re.compile("[^\t-\r -~\xa0\xa1-\xb1\xb4-\xb8\xbb\xbf-ɏͰ-ͳͶͷͻ-Ϳ΄-Ώ΢-ϿЀ-҂Ҋ-ԯ‐-‧‰-⁞₠-₿←-⇿⌀-⏿─-◿☀-❵➔-➿]")


@lru_cache(1)
def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next one from U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def _field(number: int, kind: int, payload: bytes) -> bytes:
    return _varint(number << 3 | kind) + (_varint(len(payload)) if kind == 2 else b"") + payload


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def model_proto(by_rank: list[bytes]) -> bytes:
    """A serialised sentencepiece model whose piece of id n + 1 is the token of rank n; id 0 is the unknown piece."""
    letters = byte_letters()
    piece = lambda text, score, kind: _field(1, 2, _field(1, 2, text.encode()) + _field(2, 5, struct.pack("<f", score)) + _field(3, 0, _varint(kind)))
    pieces = [piece("<unk>", 0.0, 2), *(piece("".join(letters[b] for b in token), -float(rank), 1) for rank, token in enumerate(by_rank))]
    trainer = _field(3, 0, _varint(2)) + _field(4, 0, _varint(len(pieces))) + _field(40, 0, _varint(0))
    trainer += b"".join(_field(n, 0, b"\xff" * 9 + b"\x01") for n in (41, 42, 43))  # no <s>, </s>, <pad>: ids of -1
    normalizer = _field(1, 2, b"identity") + _field(3, 0, b"\0") + _field(4, 0, b"\0") + _field(5, 0, b"\0")
    return b"".join(pieces) + _field(2, 2, trainer) + _field(3, 2, normalizer)


class Codec:
    def __init__(self, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> None:
        table = ranks(os.path.join(folder, f"{vocabulary}.tiktoken"))
        self.tokens = [token for token, _ in sorted(table.items(), key=lambda x: x[1])]
        if sorted(table.values()) != list(range(len(table))):
            raise ValueError("ranks have to run from 0 without a gap")
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(self.tokens))
        self.letters = {b: c for b, c in enumerate(byte_letters())}
        back = {c: b for b, c in self.letters.items()}
        self.pieces = [bytes(map(back.__getitem__, self.model.id_to_piece(n + 1))) for n in range(len(self.tokens))]  # the inverse mapping of the model's pieces
        self._forget()

    def _forget(self) -> None:
        self.places: dict[str, int] = {}
        self.ids, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def pre_tokens(self, text: str) -> list[str]:
        return _EXACT.findall(text) if _UNCOMMON.search(text) else _COMMON.findall(text)

    def _learn(self, pre_tokens: list[str]) -> None:
        new = list(set(pre_tokens) - self.places.keys())
        if not new:
            return
        if len(self.places) + len(new) > KEPT and self.places:
            self._forget()
            new = list(set(pre_tokens))
        mapped = [t.encode().decode("latin-1").translate(self.letters) for t in new]
        coded = self.model.encode(mapped, num_threads=1)
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        flat = np.fromiter(chain.from_iterable(coded), np.int32, int(sizes.sum())) - 1
        first = len(self.places)
        self.places.update(zip(new, range(first, first + len(new)), strict=True))
        self.starts = np.append(self.starts, len(self.ids) + np.cumsum(sizes) - sizes)
        self.sizes = np.append(self.sizes, sizes)
        self.ids = np.append(self.ids, flat)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text's ids begin (one more entry than texts)."""
        cut = [self.pre_tokens(t) if t else [] for t in texts]
        all_tokens = list(chain.from_iterable(cut))
        self._learn(all_tokens)
        place = np.fromiter(map(self.places.__getitem__, all_tokens), np.int64, len(all_tokens))
        sizes = self.sizes[place]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        where = np.arange(ends[-1]) + np.repeat(self.starts[place] - ends[:-1], sizes)
        rows = np.concatenate(([0], np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))))
        return self.ids[where], ends[rows]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, exactly; for ids of encode() a round trip."""
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(2)
def codec(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> Codec:
    return Codec(folder, vocabulary)


def encoded(df: DataFrame, key: str, text: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids) for every row of df; a narrow stage, the folder has to exist on every executor."""
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(folder, vocabulary)
        for batch in sliced(batches, "t", 1_000_000):
            ids, starts = own.encode(batch.column("t").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("k"), lists], ["k", "ids"])

    return spread(rows).mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def decoded(df: DataFrame, key: str, ids: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, text) of rows of ids; null ids give null. A narrow stage."""
    rows = df.select(F.col(key).alias("k"), F.col(ids).alias("ids"))
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(folder, vocabulary)
        for batch in batches:
            texts = [None if i is None else own.decode(i) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(texts, pa.string())], ["k", "text"])

    return rows.mapInArrow(run, f"k {kind}, text string").withColumnRenamed("k", key)
