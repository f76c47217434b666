"""Languages of documents and of their segments by hyperdimensional profiles.

Every letter has a random vector of signs; an n-gram's vector is the product of its
letters' vectors, each permuted by its place; a word's vector is the bundle (sum) of its
n-grams', a language's prototype the bundle of the words of its samples. Texts are compared
with the prototypes by cosine. Since a bundle is a sum, the product of a text's vector with
a prototype is the sum of its words' products, which are kept by word. The length of a text's
vector comes from how often each n-gram occurs in it, n-grams that words share included: the
vectors of different n-grams are orthogonal but for chance (a part of 1 / sqrt(dimensions)).

Running text is cut into sentences; code, titles, tables, captions, identifiers and markup
stand aside. Neighbouring sentences of one language make a segment. A text is written in
each language in which it has a segment of at least RUN words, or, if it has none, in the
language of what it has.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import sliced, spread

LANGUAGES = ("ru", "en", "uk", "de", "es", "pt")
DIMENSIONS, GRAMS = 2048, (2, 3, 4)
#: Words in a row that count as written in a language.
RUN = 15
#: Sample rows of known language that prototypes are built from, at most (each language's share of it).
SAMPLES = 6000
#: A sentence is sure of its nearest language if it is ahead of the second by this share of what sentences of that
#: language are ahead in the samples; others go with a sure neighbour of so many words, else with their text's main
#: language. A sentence of fewer words than the last figure takes its neighbour's language.
AHEAD, ANCHOR_WORDS, SURE_WORDS = 0.25, 6, 3
#: Words whose products a worker keeps, and units whose n-grams are counted at once.
KEPT, UNITS_AT_ONCE = 200_000, 1024

_LINE_ENDS = re.compile("\r\n|[\r\v\f\x85  ]")
#: What stands aside of running text: front matter, fenced code, tables, titles, captions, images, inline code, tags, addresses, paths.
_ASIDE = re.compile(
    r"\A\s*---\n.*?^---[ \t]*$|^[ \t]*(?:```|~~~).*?(?:^[ \t]*(?:```|~~~)[ \t]*$|\Z)|<table\b.*?(?:</table>|\Z)|<(?:pre|code|h[1-6])\b.*?(?:</(?:pre|code|h[1-6])>|\Z)"
    r"|^#{1,6}[ \t][^\n]*$|^[ \t]*\|[^\n]*$|^>[ \t]*\w+ \d+ ?[–—-] [^\n]*$|^::[^\n]*$|!\[[^\]\n]*\]\([^)\n]*\)|`[^`\n]*`|\]\([^)\n]*\)|<[^<>]+>|(?<!\w)\w+://\S+|&\w+;",
    re.M | re.S,
)
#: Identifiers and paths, looked for only in texts that hold one of their signs.
IDENTIFIER, IDENTIFIER_SIGNS = re.compile(r"[\w-]*[/_@\\][\w./@\\-]*"), "/_@\\"
_FENCED_WHOLE = re.compile(r"\A\s*```(?:markdown|md)?[ \t]*\n(.*?)(?:\n```\s*)?\Z", re.S)
#: Words (letters with digits are none), ends of sentences and lines.
_TOKEN = re.compile(r"(?<![^\W_])[^\W\d_]++(?:['’ʼ-][^\W\d_]++)*(?![\d_])|[.!?…]+(?=\s)|\n|\0")
_INVISIBLE = re.compile(r"[\s­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ\x00-\x1f\x7f-\x9f]+")
_ENDS = frozenset("\n.!?…")

# How labels spell the six languages, and labels that name none.
SPELLINGS = {
    "ru": ("ru", "rus", "russian", "русский", "russisch", "ruso", "russo"),
    "en": ("en", "eng", "english", "английский", "englisch", "inglés", "inglês"),
    "uk": ("uk", "ua", "ukr", "ukrainian", "українська", "украинский", "ukrainisch"),
    "de": ("de", "deu", "ger", "german", "deutsch", "немецкий", "alemán", "alemão"),
    "es": ("es", "spa", "spanish", "español", "castellano", "испанский", "spanisch"),
    "pt": ("pt", "por", "portuguese", "português", "portugues", "португальский", "portugiesisch"),
}
UNKNOWN = ("", "und", "unknown", "n/a", "na", "none", "null", "nan", "undefined", "undetermined", "other", "mis", "zxx", "xx", "?", "-", "--", "неизвестно", "не определён", "unbekannt", "desconocido", "desconhecido", "невідомо")


def label_language(label: Column) -> Column:
    """The language a label names, whatever its spelling, case or region: one of the six, "" if it names none, else itself in lower case."""
    plain = F.lower(F.regexp_replace(F.coalesce(label, F.lit("")), r"(?U)^[\s\p{Cf}]+|[\s\p{Cf}]+$", ""))
    known = {s: code for code, names in SPELLINGS.items() for s in names}
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in known.items()))
    main = F.regexp_extract(plain, r"^([^\s_(\-]+)", 1)
    named = F.coalesce(F.try_element_at(table, plain), F.try_element_at(table, main))
    return F.when(plain.isin(*UNKNOWN), "").otherwise(F.coalesce(named, plain))


def plain_text(text: str) -> str:
    """Running text alone: what stands aside is replaced by a space."""
    text = _LINE_ENDS.sub("\n", text)
    whole = _FENCED_WHOLE.match(text)
    text = _ASIDE.sub(" ", whole.group(1) if whole else text)
    return IDENTIFIER.sub(" ", text) if any(c in text for c in IDENTIFIER_SIGNS) else text


@dataclass
class Units:
    words: np.ndarray
    products: np.ndarray  # with each language; the largest is the nearest language, whatever the length of the unit's vector
    marks: np.ndarray  # of all words, or-ed
    place: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


class Profiles:
    """Prototypes of languages and the products of words with them."""

    def __init__(self, samples: list[tuple[str, str]], dimensions: int = DIMENSIONS, grams: tuple[int, ...] = GRAMS, marker: Callable[[str], int] | None = None) -> None:
        """marker: a number kept with each word (in lower case), for users that tell classes of words."""
        self.dimensions, self.grams, self.marker = dimensions, grams, marker
        self.languages = tuple(sorted({lang for lang, _ in samples}))
        self._letters: dict[str, np.ndarray] = {}
        bundles = np.zeros((len(self.languages), dimensions))
        for lang, text in samples:
            for word in _TOKEN.findall(plain_text(text)):
                if word[0] not in _ENDS:
                    bundles[self.languages.index(lang)] += self.vector(word.lower())
        bundles /= np.maximum(np.linalg.norm(bundles, axis=1, keepdims=True), 1e-9)
        self.prototypes = bundles  # of length 1
        self.middle = bundles.mean(0)  # what all languages have in common tells none apart
        apart = bundles - self.middle
        self.apart = (apart / np.maximum(np.linalg.norm(apart, axis=1, keepdims=True), 1e-9)).astype(np.float32)
        self._forget()
        self.lead = np.zeros((len(self.languages), len(self.languages)), np.float32)
        for k, lang in enumerate(self.languages):  # how far sentences of a language are ahead of each other one
            known = self.sentences([t for x, t in samples if x == lang])
            if len(known["words"]):
                self.lead[k] = np.average(known["cosine"][:, [k]] - known["cosine"], axis=0, weights=known["words"])
        self._letters.clear()
        self._forget()

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("dimensions", "grams", "languages", "prototypes", "middle", "apart", "lead", "marker")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._letters = {}
        self._forget()

    def _forget(self) -> None:
        self.places: dict[str, int] = {"\n": 0, "\0": 1, "": 0}
        self.scores = np.zeros((2, len(self.languages)), np.float32)
        self.marks = np.zeros(2, np.int64)
        self.is_word = np.zeros(2, bool)
        self._numbers: dict[str, int] = {}  # of n-grams
        self.of_word = np.zeros(0, np.int32)  # n-grams of all words, one after another
        self.first, self.count = np.zeros(2, np.int64), np.zeros(2, np.int64)

    def letter(self, c: str) -> np.ndarray:
        found = self._letters.get(c)
        if found is None:
            if len(self._letters) > 4000:
                self._letters.clear()
            signs = np.random.Generator(np.random.PCG64(ord(c))).integers(0, 2, self.dimensions, np.int8)
            self._letters[c] = found = signs * np.int8(2) - np.int8(1)
        return found

    def vector(self, word: str) -> np.ndarray:
        """The bundle of the n-grams of a word with its ends."""
        padded = f" {word} "
        letters = np.stack([self.letter(c) for c in padded])
        total = np.zeros(self.dimensions, np.int32)
        for n in self.grams:
            if len(padded) >= n:
                bound = np.ones((len(padded) - n + 1, self.dimensions), np.int8)
                for place in range(n):
                    bound *= np.roll(letters[place : len(padded) - n + 1 + place], n - 1 - place, axis=1)
                total += bound.sum(0, dtype=np.int32)
        return total

    def learn(self, words: list[str]) -> None:
        new = [w for w in set(words) - self.places.keys()]
        if not new:
            return
        if len(self.places) + len(new) > KEPT and len(self.places) > 3:
            self._forget()
            new = [w for w in set(words) - self.places.keys()]
        lower = ["" if w[0] in _ENDS else w.lower() for w in new]
        listed: list[int] = []
        count = np.zeros(len(new), np.int64)
        scores = []
        for begin in range(0, len(new), 256):
            part = lower[begin : begin + 256]
            vectors = np.zeros((len(part), self.dimensions), np.float32)
            for k, w in enumerate(part):
                if w:
                    vectors[k] = self.vector(w)
                    padded = f" {w} "
                    grams = [padded[i : i + n] for n in self.grams for i in range(len(padded) - n + 1)]
                    listed += [self._numbers.setdefault(g, len(self._numbers)) for g in grams]
                    count[begin + k] = len(grams)
            scores.append(np.einsum("wd,ld->wl", vectors, self.apart))  # no threads of a linear algebra library
        self.places.update(zip(new, range(len(self.is_word), len(self.is_word) + len(new)), strict=True))
        self.scores = np.concatenate((self.scores, *scores))
        self.is_word = np.append(self.is_word, [bool(w) for w in lower])
        self.marks = np.append(self.marks, [self.marker(w) if w and self.marker else 0 for w in lower])
        self.first = np.append(self.first, len(self.of_word) + np.cumsum(count) - count)
        self.count = np.append(self.count, count)
        self.of_word = np.append(self.of_word, np.array(listed, np.int32))

    def lengths(self, place: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Length of the bundle of the words place[start : end] of each unit."""
        out = np.zeros(len(starts))
        n = max(1, len(self._numbers))
        kind = np.int32 if n * UNITS_AT_ONCE < 1 << 31 else np.int64  # a key is a unit and an n-gram
        for low in range(0, len(starts), UNITS_AT_ONCE):
            begin, sizes = starts[low : low + UNITS_AT_ONCE], (ends - starts)[low : low + UNITS_AT_ONCE]
            unit = np.repeat(np.arange(len(begin)), sizes)
            word = place[np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(unit))]
            count = self.count[word]
            grams = self.of_word[np.repeat(self.first[word] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
            key = np.repeat((unit * n).astype(kind), count) + grams.astype(kind, copy=False)
            key.sort()
            if len(key):
                edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
                times = np.diff(edge)
                out[low : low + UNITS_AT_ONCE] = np.bincount(key[edge[:-1]] // n, times * times, len(begin))
        return np.sqrt(np.maximum(out * self.dimensions, 1e-9))

    def sentences(self, texts: list[str | None]) -> dict[str, np.ndarray]:
        """Of each sentence of running text: row, number of words, cosine with each language's prototype."""
        joined = "\0".join(plain_text(t.replace("\0", " ")) if t else "" for t in texts)
        tokens = _TOKEN.findall(joined + "\0")
        self.learn(tokens)
        place = np.fromiter(map(self.places.__getitem__, tokens), np.int64, len(tokens))
        word = self.is_word[place]
        row = np.cumsum(place == 1) - (place == 1)
        cut = np.cumsum(~word)
        at = np.flatnonzero(word)
        if not len(at):
            return {"row": np.zeros(0, np.int64), "words": np.zeros(0, np.int64), "cosine": np.zeros((0, len(self.languages)), np.float32)}
        starts = np.flatnonzero(np.concatenate(([True], np.diff(cut[at]) > 0)))
        words = np.diff(np.append(starts, len(at)))
        product = np.add.reduceat(self.scores[place[at]], starts, axis=0)
        length = self.lengths(place[at], starts, starts + words)
        return {"row": row[at[starts]], "words": words, "cosine": product / length[:, None]}

    def units(self, units: list[str]) -> Units:
        """The words of units of plain text without line ends, their products with the languages, and their marks."""
        tokens = _TOKEN.findall("\n".join(units) + "\n")
        self.learn(tokens)
        place = np.fromiter(map(self.places.__getitem__, tokens), np.int64, len(tokens))
        ends = np.flatnonzero(place == 0)[: len(units)]
        starts = np.concatenate(([0], ends + 1))[: len(units)]
        words = np.concatenate(([0], np.cumsum(self.is_word[place])))
        products = np.add.reduceat(self.scores[place], starts, axis=0) if len(units) else np.zeros((0, len(self.languages)))
        marks = np.bitwise_or.reduceat(self.marks[place], starts) if len(units) else np.zeros(0, np.int64)
        return Units(words[ends] - words[starts], products, marks, place, starts, ends)

    def products(self, units: list[list[str]]) -> np.ndarray:
        """Products of units, given as their words, with each language; empty words count for nothing."""
        tokens = list(chain.from_iterable(units))
        self.learn(tokens)
        place = np.fromiter(map(self.places.__getitem__, tokens), np.int64, len(tokens))
        total = np.concatenate((np.zeros((1, len(self.languages))), np.cumsum(self.scores[place], axis=0, dtype=np.float64)))
        ends = np.cumsum([len(u) for u in units])
        return total[ends] - total[ends - [len(u) for u in units]] if units else np.zeros((0, len(self.languages)))

    def segments(self, texts: list[str | None]) -> dict[str, np.ndarray]:
        """Of each segment: row, language (its number), words, confidence."""
        s = self.sentences(texts)
        row, words, cosine = s["row"], s["words"], s["cosine"]
        n = len(row)
        if not n:
            return {"row": row, "lang": np.zeros(0, np.int64), "words": words, "confidence": np.zeros(0)}
        index = np.arange(n)
        totals = np.zeros((int(row[-1]) + 1, len(self.languages)))
        np.add.at(totals, row, cosine * words[:, None])
        main = totals.argmax(1)[row]
        order = np.argsort(cosine, axis=1, kind="stable")
        nearest, second = order[:, -1], order[:, -2]
        weak = cosine[index, nearest] - cosine[index, second] < AHEAD * self.lead[nearest, second]
        home = np.where((main == nearest) | (main == second), main, nearest)
        lang = np.where(weak, home, nearest)
        # A weak sentence that isn't nearest to the main language goes with a sure neighbour of one of its two nearest languages.
        open_ = weak & (nearest != main)
        anchor = np.where(weak | (words < ANCHOR_WORDS), -1, nearest)
        together = row[1:] == row[:-1]
        for _ in range(2):
            before, after = np.full(n, -1), np.full(n, -1)
            before[1:], after[:-1] = np.where(together, anchor[:-1], -1), np.where(together, anchor[1:], -1)
            first, other = (before == nearest) | (after == nearest), (before == second) | (after == second)
            near = np.where(first & ~other, nearest, np.where(other & ~first, second, -1))
            lang = np.where(open_ & (near >= 0), near, lang)
            anchor = np.where(open_ & (near >= 0), near, anchor)
        unsure = words < SURE_WORDS
        # An unsure sentence takes the language of the sure one before it in its text, else of the one after.
        before = np.maximum.accumulate(np.where(unsure, -1, index))
        after = np.minimum.accumulate(np.where(unsure, n, index)[::-1])[::-1]
        use = np.where((before >= 0) & (row[np.maximum(before, 0)] == row), before, np.where((after < n) & (row[np.minimum(after, n - 1)] == row), after, index))
        lang = lang[np.where(unsure, use, index)]
        starts = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (lang[1:] != lang[:-1]))))
        total = np.add.reduceat(words, starts)
        weighted = np.add.reduceat(cosine * words[:, None], starts, axis=0) / total[:, None]
        return {"row": row[starts], "lang": lang[starts], "words": total, "confidence": confidence(weighted, lang[starts])}

    def of_anything(self, text: str) -> tuple[int, float] | None:
        """Language of a text without running text, by all words it has (titles, captions, code); None without a word."""
        words = [w for w in _TOKEN.findall(_INVISIBLE.sub(" ", text)) if w[0] not in "\n.!?…\0"]
        if not words:
            return None
        self.learn(words)
        place = [self.places[w] for w in words]
        cosine = self.scores[place].sum(0) / self.lengths(np.array(place), np.zeros(1, np.int64), np.array([len(place)]))[0]
        best = int(cosine.argmax())
        return best, float(confidence(cosine[None], np.array([best]))[0])


def confidence(cosine: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """Share of the language among all by its cosine: a softmax at the scale at which sentences differ."""
    scaled = np.exp((cosine - cosine.max(1, keepdims=True)) * 12)
    return scaled[np.arange(len(lang)), lang] / scaled.sum(1)


def sample_rows(samples: DataFrame, lang: str = "lang", text: str = "text", most: int = SAMPLES) -> list[tuple[str, str]]:
    """(language, text) of at most `most` sample rows, each language's share chosen by a hash of the text; a bound for what the driver fetches (`lang_samples` has 300 rows)."""
    known = samples.filter(F.col(lang).isin(*LANGUAGES) & F.col(text).isNotNull()).select(F.col(lang).alias("l"), F.col(text).alias("t"))
    place = F.row_number().over(Window.partitionBy("l").orderBy(F.xxhash64("t"), "t"))
    listed = known.withColumn("n", place).filter(F.col("n") <= -(-most // len(LANGUAGES))).orderBy("n", "l").collect()
    return [(r["l"], r["t"]) for r in listed]


def profiles_of(samples: DataFrame, lang: str = "lang", text: str = "text", most: int = SAMPLES) -> Profiles:
    """Prototypes from at most `most` sample rows; the same rows give the same prototypes, which are kept for further queries."""
    return _profiles(tuple(sample_rows(samples, lang, text, most)))


@lru_cache(2)
def _profiles(samples: tuple[tuple[str, str], ...]) -> Profiles:
    return Profiles(list(samples))


_SEGMENTS = "segment_no int, lang string, confidence double, n_words int"


def language_segments(df: DataFrame, key: str, text: str, profiles: Profiles) -> DataFrame:
    """(key, segment_no, lang, confidence, n_words) of each segment of each text in one language, in order.

    A text with words but no running text gives one segment of 0 running words. Null, empty,
    blank and invisible texts, and texts without a letter, give none. A narrow stage.
    """
    rows = spread(df.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("t is not null"))
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "t"):
            texts = batch.column("t").to_pylist()
            s = profiles.segments(texts)
            row, lang, words, sure = s["row"], s["lang"], s["words"], s["confidence"]
            without = np.setdiff1d(np.arange(len(texts)), row)
            other = [(int(i), *found) for i in without if (found := profiles.of_anything(texts[i]))]
            if other:
                row = np.append(row, [i for i, _, _ in other])
                lang = np.append(lang, [x for _, x, _ in other])
                sure = np.append(sure, [c for _, _, c in other])
                words = np.append(words, np.zeros(len(other), np.int64))
            if not len(row):
                continue
            starts = np.concatenate(([True], row[1:] != row[:-1]))
            first = np.flatnonzero(starts)
            number = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row)))) + 1
            names = np.array(profiles.languages, object)[lang]
            yield pa.RecordBatch.from_arrays(
                [batch.column("k").take(pa.array(row)), pa.array(number, pa.int32()), pa.array(names, pa.string()), pa.array(sure, pa.float64()), pa.array(words, pa.int32())],
                ["k", "segment_no", "lang", "confidence", "n_words"],
            )

    return rows.mapInArrow(run, f"k {kind}, {_SEGMENTS}").withColumnRenamed("k", key)


def document_languages(df: DataFrame, key: str, text: str, label: str, profiles: Profiles, run: int = RUN) -> DataFrame:
    """(key, label, lang, confidence, n_words, n_languages, problem) for each language a text is written in.

    problem: missing (no label), wrong (another language), mixed (several languages) or null.
    Texts without a word give no row. Segments are summed up inside the batch they come from, so
    no shuffle is needed; each input row is judged by itself, and repeated rows stay repeated.
    """
    rows = spread(df.select(F.col(key).alias("k"), F.col(text).alias("t"), label_language(F.col(label)).alias("l")).filter("t is not null"))
    kind = rows.schema["k"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_lang = len(profiles.languages)
        for batch in sliced(batches, "t"):
            texts = batch.column("t").to_pylist()
            n = len(texts)
            s = profiles.segments(texts)
            longest, total, sure = np.zeros((n, n_lang), np.int64), np.zeros((n, n_lang), np.int64), np.zeros((n, n_lang))
            np.maximum.at(longest, (s["row"], s["lang"]), s["words"])
            np.add.at(total, (s["row"], s["lang"]), s["words"])
            np.add.at(sure, (s["row"], s["lang"]), s["words"] * s["confidence"])
            sure /= np.maximum(total, 1)
            written = longest >= run
            for i in np.flatnonzero(~written.any(1)):
                if total[i].any():
                    written[i, total[i].argmax()] = True
                elif found := profiles.of_anything(texts[i]):
                    written[i, found[0]], sure[i, found[0]] = True, found[1]
            row, lang = np.nonzero(written)
            names = np.array(profiles.languages, object)[lang]
            yield pa.RecordBatch.from_arrays(
                [batch.column("k").take(pa.array(row)), batch.column("l").take(pa.array(row)), pa.array(names, pa.string()), pa.array(sure[row, lang]), pa.array(total[row, lang], pa.int32()), pa.array(written.sum(1)[row], pa.int32()), pa.array(_named(batch.column("l"), written, profiles.languages)[row])],
                ["k", "label", "lang", "confidence", "n_words", "n_languages", "right"],
            )

    found = rows.mapInArrow(work, f"k {kind}, label string, lang string, confidence double, n_words int, n_languages int, right boolean")
    problem = F.when(F.col("label") == "", "missing").when(~F.col("right"), "wrong").when(F.col("n_languages") > 1, "mixed")
    return found.select(F.col("k").alias(key), "label", "lang", "confidence", "n_words", "n_languages", problem.alias("problem"))


def _named(labels: pa.Array, written: np.ndarray, languages: tuple[str, ...]) -> np.ndarray:
    """Whether each row's label names a language its text is written in."""
    number = {lang: i for i, lang in enumerate(languages)}
    at = np.array([number.get(x, -1) for x in labels.to_pylist()], np.int64)
    return (at >= 0) & written[np.arange(len(at)), np.maximum(at, 0)]
