"""Texts cut off by field limits: censored length distributions per source, combined with how each text ends.

Candidate limits are found in the lengths themselves: lengths (in characters, in characters
with what was put after a cut, or in bytes) at which a source has clearly more values than
lie around them. Per source a log-normal distribution of lengths is fitted by maximum
likelihood, values at a candidate limit being censored with an unknown share (EM); that
gives each limit of each source a posterior that a value there was cut.

The evidence of a text's end is its construct and line, what was put after it, where its
last letters stand in the source text, and how often its last word ends a line or sentence
in the whole corpus. How often each occurs among cut and among complete texts is fitted by
EM over all texts, with the censoring posterior of each text as its prior (texts at no limit
share a fitted one). Posterior and evidence together decide.

Null, empty and unreadable texts and copies of the source's markup are no cases. A
repeated row gives one result. Texts whose key has no source are judged without it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from ..plans.lineage import kept
from ..plans.skew import split_join
from .answers import ending, is_empty, kept_part, markup_share, place_in_source
from .arrowtext import sliced

#: Block tags for each 100 characters from which an answer is a copy of markup.
COPY_MARKUP = 0.5
#: Bins of lengths for each factor of e, within which a source's values are taken to lie evenly.
BINS = 10
#: Values that a length needs at least to be a candidate limit, and the log likelihood by which it has to beat an even spread, beside the logarithm of the number of lengths.
LEAST, AHEAD = 3, 6.0
UNITS = ("kept", "whole", "bytes")
#: Steps of log odds in which priors and words are counted, and their ends.
STEP, MOST = 0.5, 8.0
_WORD = re.compile(r"[^\W_]+")
_ENDED = re.compile(r"[^\W_]+(?=[.;:!?…|]+(?:\s|\0|$)|\n)")
_LAST = re.compile(r"([^\W_]+)[\W_]*\Z")
_WORDS_HELD = 500_000


def word_key(word: str) -> int:
    """A stable 64-bit key of a word, case aside; numbers are one word."""
    raw = b"0" if word.isdigit() else word.lower().encode()
    return zlib.crc32(raw) << 31 ^ zlib.adler32(raw) ^ (len(raw) & 0xFF) << 54


class Words:
    """Counts of words that end a sentence, cell or line, and of words that go on; the last word of a text counts as neither."""

    def __init__(self) -> None:
        self.all: Counter = Counter()
        self.ended: Counter = Counter()

    def add(self, texts: list[str | None]) -> None:
        joined = "\0".join(t.replace("\0", " ").lower() for t in texts if t)
        self.all.update(_WORD.findall(joined))
        self.ended.update(_ENDED.findall(joined))
        for t in texts:
            if t and (m := _last_word(t)):
                word, has_end = m
                self.all[word] -= 1
                self.ended[word] -= has_end

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        """The counts as rows of the schema, and forgotten."""
        words = [w for w, n in self.all.items() if n > 0]
        ended = np.array([self.ended[w] for w in words], np.int64)
        counts = {"word": [word_key(w) for w in words], "ends": ended, "goes_on": np.array([self.all[w] for w in words], np.int64) - ended}
        self.__init__()
        return pa.RecordBatch.from_arrays([pa.array(counts[f.name], f.type) if f.name in counts else pa.nulls(len(words), f.type) for f in schema], schema=schema)


def _last_word(text: str) -> tuple[str, bool] | None:
    for most in (200, len(text)):
        end = text[-most:].lower()
        if m := _LAST.search(end):
            if m.start() or most >= len(text):
                return m.group(1), bool(_ENDED.match(end, m.start()))
    return None


_EVIDENCE = (
    ("readable", BooleanType()), ("copied", BooleanType()), ("kind", StringType()), ("line", StringType()), ("mark", StringType()), ("place", StringType()),
    ("n_kept", LongType()), ("n_whole", LongType()), ("n_bytes", LongType()), ("digest", LongType()), ("word", LongType()), ("ends", LongType()), ("goes_on", LongType()),
)


def evidence(df: DataFrame, text: str, source_text: str) -> DataFrame:
    """df without the two texts, with how each text ends and its lengths; and, with null in all columns of df, rows (word, ends, goes_on) of the words of each task.

    One pass over the texts gives both. word of a text: the key of its last word if it ends there bare.
    """
    names = [c for c in df.columns if c not in (text, source_text)]
    schema = StructType([*(StructField(c, df.schema[c].dataType) for c in names), *(StructField(n, t) for n, t in _EVIDENCE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, out = Words(), None
        for batch in sliced(batches, (text, source_text)):
            texts = batch.column(text).to_pylist()
            words.add(texts)
            rows = [_evidence(t, s) for t, s in zip(texts, batch.column(source_text).to_pylist(), strict=True)]
            kinds = [pa.bool_() if isinstance(t, BooleanType) else pa.int64() if isinstance(t, LongType) else pa.string() for _, t in _EVIDENCE]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            found = pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *columns], [*names, *(n for n, _ in _EVIDENCE)])
            out = found.schema
            yield found
            if len(words.all) > _WORDS_HELD:
                yield words.batch(out)
        if out is not None:
            yield words.batch(out)

    return df.mapInArrow(run, schema)


def _evidence(t: str | None, s: str | None) -> tuple:
    if is_empty(t):
        return (False, False, "none", "other", "", "unknown", 0, 0, 0, None, None, None, None)
    body = kept_part(t)
    lengths = (len(body), len(t), len(body.encode()), zlib.crc32(t.encode()) << 31 ^ len(t))
    if markup_share(t) >= COPY_MARKUP:
        return (True, True, "none", "other", "", "unknown", *lengths, None, None, None)
    e = ending(t)
    return (True, False, e.kind, e.line, e.mark, place_in_source(e.tail, s), *lengths, word_key(e.words[1]) if e.kind == "bare" else None, None, None)


# Lengths and limits.


def source_key(source: Column) -> Column:
    """A source as a key that isn't null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def lengths(values: DataFrame) -> DataFrame:
    """(s, unit, length, n, log) from rows (s, n_kept, n_whole, n_bytes, digest): distinct texts of each source at each length, and the mean logarithm of their characters.

    Lengths that say the same as the characters kept are left out. Counted before the shuffle; texts that occur again count once.
    """
    texts = values.filter("n_kept > 0").dropDuplicates(["s", "n_whole", "digest"])
    log = F.log(F.col("n_kept").cast("double"))
    own = F.array(
        F.struct(F.lit("kept").alias("unit"), F.col("n_kept").alias("length")),
        F.when(F.col("n_whole") != F.col("n_kept"), F.struct(F.lit("whole").alias("unit"), F.col("n_whole").alias("length"))),
        F.when(F.col("n_bytes") != F.col("n_kept"), F.struct(F.lit("bytes").alias("unit"), F.col("n_bytes").alias("length"))),
    )
    each = texts.select("s", log.alias("log"), F.explode(F.array_compact(own)).alias("x")).select("s", "x.unit", "x.length", "log")
    return each.groupBy("s", "unit", "length").agg(F.count(F.lit(1)).alias("n"), F.avg("log").alias("log"))


def candidate_limits(counted: DataFrame) -> DataFrame:
    """(s, unit, length, n, log) of the lengths at which a source has more values than an even spread over the lengths around explains.

    The test is a log likelihood ratio that has to exceed AHEAD and the logarithm of the source's number of lengths.
    """
    bin_ = F.floor(F.log(F.col("length").cast("double")) * BINS)
    binned = counted.withColumn("bin", bin_)
    wide = lambda k: F.ceil(F.exp((k + 1) / BINS)) - F.ceil(F.exp(k / BINS))
    sums = binned.groupBy("s", "unit", "bin").agg(F.sum("n").alias("total"))
    sizes = counted.groupBy("s", "unit").agg(F.count(F.lit(1)).alias("n_lengths"))
    joined = binned.filter(F.col("n") >= LEAST).join(sums, ["s", "unit", "bin"]).join(sizes, ["s", "unit"])
    expected = (F.col("total") - F.col("n") + 0.5) / F.greatest(F.lit(1.0), wide(F.col("bin")) - 1)
    ahead = F.col("n") * F.log(F.col("n") / expected) - (F.col("n") - expected)
    return joined.filter((F.col("n") > expected) & (ahead > F.log(F.col("n_lengths").cast("double")) + AHEAD)).select("s", "unit", "length", "n", "log")


def _survival(x: np.ndarray) -> np.ndarray:
    """1 - the standard normal distribution function (its usual rational form, to 1e-7)."""
    t = 1 / (1 + 0.2316419 * np.abs(x))
    tail = np.exp(-x * x / 2) * 0.3989422804 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(x >= 0, tail, 1 - tail)


def censoring(n: float, total: float, squares: float, logs: np.ndarray, at: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Posterior, for each candidate limit of one source, that a value standing there was cut, by EM.

    n, total, squares: number, sum and sum of squares of the log lengths of all values; logs, at: log length of the values at each limit and how many they are.
    """
    logs, at = np.asarray(logs, float), np.asarray(at, float)
    if n < 2 or not len(at):
        return np.zeros(len(at))
    mean, sd = total / n, max(0.2, np.sqrt(max(0.0, squares / n - (total / n) ** 2)))
    share, posterior = np.full(len(at), min(0.002, 0.5 / len(at))), np.zeros(len(at))
    width = np.exp(-logs)  # of one length, on the log scale
    for _ in range(rounds):
        z = (logs - mean) / sd
        natural = np.exp(-z * z / 2) * 0.3989422804 / sd * width
        beyond = np.maximum(_survival(z), 1e-12)
        cut = share * beyond
        posterior = cut / (cut + max(1e-3, 1 - share.sum()) * natural + 1e-300)
        censored = at * posterior
        share = np.clip(censored / np.maximum(n * beyond, censored + 1), 1e-6, 0.5)
        # A cut value's log length is expected above its limit: moments of the truncated normal.
        hazard = np.exp(-z * z / 2) * 0.3989422804 / beyond
        first = mean + sd * hazard
        second = mean**2 + sd**2 + sd * hazard * (logs + mean)
        new_total = total + (censored * (first - logs)).sum()
        new_squares = squares + (censored * (second - logs**2)).sum()
        mean, sd = new_total / n, max(0.2, np.sqrt(max(1e-6, new_squares / n - (new_total / n) ** 2)))
    return posterior


def limit_posteriors(counted: DataFrame) -> DataFrame:
    """(s, limits: map of "unit length" to the posterior that a value there was cut) of each source that has candidate limits."""
    log = F.col("log")
    sums = counted.filter("unit = 'kept'").groupBy("s").agg(F.sum("n").cast("double").alias("total_n"), F.sum(F.col("n") * log).alias("total"), F.sum(F.col("n") * log * log).alias("squares"))
    found = candidate_limits(counted).groupBy("s").agg(F.array_sort(F.collect_list(F.struct("unit", "length", "n", "log"))).alias("c"))  # spikes of one source, few among its lengths

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            fitted = []
            for n, t, q, c in zip(part.total_n, part.total, part.squares, part.c, strict=True):
                p = censoring(n, t, q, np.array([x["log"] for x in c]), np.array([x["n"] for x in c]))
                fitted.append({f"{x['unit']} {x['length']}": float(v) for x, v in zip(c, p, strict=True)})
            yield pd.DataFrame({"s": part.s, "limits": fitted})

    return sums.join(found, "s").mapInPandas(run, "s string, limits map<string,double>")


def _posterior(limits: Column) -> Column:
    """Posterior of a text at the limits of its source; null at no limit. A cut in bytes may have lost a part of a character."""
    at = lambda unit, length: F.try_element_at(limits, F.concat(F.lit(f"{unit} "), length.cast("string")))
    broken = [F.when(F.col("mark") == "bytes", at("bytes", F.col("n_bytes") + k)) for k in (1, 2, 3)]
    same = [at("kept", F.col("n_kept")), at("whole", F.col("n_whole")), at("bytes", F.col("n_bytes")), *broken]
    return F.array_max(F.array_compact(F.array(*same)))


# Evidence of endings.

#: Features of an ending; of each the model holds how often its values occur among cut and among complete texts.
FEATURES = ("form", "place", "words")
# How often values occur before anything is counted, as the weight of so many texts: in what way a cut at a random place ends and a complete text ends. The counts of all texts go on from there.
PRIOR_TEXTS = 100.0
START = {
    "form": (
        {"bare prose": 0.5, "bare item": 0.1, "bare heading": 0.03, "bare caption": 0.02, "open table": 0.05, "open code": 0.05, "open prose": 0.05, "bare prose dots": 0.1, "bare prose bytes": 0.05, "bare prose ellipsis": 0.05},
        {"stop prose": 0.5, "stop item": 0.2, "stop table": 0.1, "bare item": 0.05, "bare caption": 0.05, "stop code": 0.05, "bare prose ellipsis": 0.05},
    ),
    "place": ({"inside": 0.7, "unknown": 0.15, "elsewhere": 0.1, "end": 0.05}, {"end": 0.7, "unknown": 0.15, "elsewhere": 0.1, "inside": 0.05}),
    "words": ({"": 0.1, "new": 0.3, "2.0": 0.3, "1.0": 0.2, "0.0": 0.1}, {"": 0.8, "-1.0": 0.1, "0.0": 0.05, "1.0": 0.05}),
}


@dataclass(frozen=True)
class Model:
    """Log ratios of each feature's values (cut over complete), and log odds that a text at no limit was cut."""

    ratios: dict[str, dict[str, float]]
    elsewhere: float


def fitted(cells: list[tuple], rounds: int = 100) -> Model:
    """The model by EM from counted cells (form, place, words, prior log odds or None at no limit, n)."""
    values = [sorted({c[k] for c in cells} | START[f][0].keys() | START[f][1].keys()) for k, f in enumerate(FEATURES)]
    codes = [np.array([values[k].index(c[k]) for c in cells], np.int64) for k in range(len(FEATURES))]
    n = np.array([c[-1] for c in cells], float)
    free = np.array([c[-2] is None for c in cells], bool)
    given = np.array([0.0 if c[-2] is None else c[-2] for c in cells])
    start = [[np.array([START[f][z].get(v, 0.002) for v in values[k]]) for z in (0, 1)] for k, f in enumerate(FEATURES)]
    tables = [[t / t.sum() for t in pair] for pair in start]
    elsewhere = np.log(0.03 / 0.97)
    for _ in range(rounds):
        odds = np.where(free, elsewhere, np.logaddexp(given, elsewhere))
        for k, code in enumerate(codes):
            odds = odds + np.log(tables[k][0] / tables[k][1])[code]
        cut = n / (1 + np.exp(-np.clip(odds, -50, 50)))
        for k, code in enumerate(codes):
            for z, weight in ((0, cut), (1, n - cut)):
                counted = np.bincount(code, weight, len(values[k])) + PRIOR_TEXTS * start[k][z] / start[k][z].sum()
                tables[k][z] = counted / counted.sum()
        rest = n[free].sum()
        elsewhere = float(np.log((cut[free].sum() + 0.03 * PRIOR_TEXTS) / (rest - cut[free].sum() + 0.97 * PRIOR_TEXTS)))
    ratios = {f: dict(zip(values[k], np.log(tables[k][0] / tables[k][1]).tolist(), strict=True)) for k, f in enumerate(FEATURES)}
    return Model(ratios, elsewhere)


def with_sources(answers: DataFrame, answer: str, answer_source: str, sources: DataFrame, key: str, text: str) -> DataFrame:
    """answers with __source_text, the text of their source or null; answers without a source, and those of a source with very many, are spread by a hash of their own key.

    A source's repeated rows repeat its answers; callers drop repeated answers from their small results.
    """
    own = sources.select(F.col(key).alias("__key"), F.col(text).alias("__source_text")).filter(F.col("__key").isNotNull() & F.col("__source_text").isNotNull())
    return split_join(answers, own, answer_source, "__key", answer, "left", shuffled=True).drop("__key")


def _steps(odds: Column) -> Column:
    return F.round(F.greatest(F.lit(-MOST), F.least(F.lit(MOST), odds)) / STEP) * STEP


def truncated(answers: DataFrame, key: str, source: str, text: str, answer_source: str, sources: DataFrame, source_key_: str, source_text: str, use_limits: bool = True) -> DataFrame:
    """(key, source, score, is_cut) of every answer with a text; score: log odds that it was cut.

    Each table is read once: answers and source texts are shuffled on the key of the source text, one pass over the
    joined texts gives evidence and word counts as rows of a few numbers, which are written to the checkpoint folder.
    What goes through the driver are counts of kinds of endings, whose number doesn't grow with the data.
    use_limits=False leaves the posteriors out, to see what they do.
    """
    rows = answers.select(F.col(key).alias("k"), F.col(source).alias("src"), F.col(text).alias("t"), F.col(answer_source).alias("a")).filter("t is not null")
    joined = with_sources(rows, "k", "a", sources, source_key_, source_text).withColumn("row", F.lit(True))
    found = kept(evidence(joined.select("row", "k", "src", "t", "__source_text"), "t", "__source_text"))
    ends = found.filter("row").drop("ends", "goes_on", "row").dropDuplicates(["k"]).withColumn("s", source_key(F.col("src")))
    counted = lengths(ends.select("s", "n_kept", "n_whole", "n_bytes", "digest"))
    limits = limit_posteriors(counted).withColumnRenamed("s", "ls")
    last = ends.filter("word is not null").select(F.col("word").alias("w")).distinct()
    words = found.filter("row is null").join(last, F.col("word") == F.col("w"), "left_semi").groupBy(F.col("word").alias("w")).agg(F.sum("ends").alias("ends"), F.sum("goes_on").alias("goes_on"))
    ratio = F.log((F.col("goes_on") + 1.0) / (F.col("ends") + 0.5))
    known = words.select("w", F.when(F.col("ends") + F.col("goes_on") > 0, F.greatest(F.lit(-4.0), F.least(F.lit(4.0), F.round(ratio))).cast("string")).alias("known"))
    with_words = split_join(ends, known, "word", "w", "k", "left").drop("w")
    placed = split_join(with_words, limits, "s", "ls", "k", "left").drop("ls")
    p = F.coalesce(_posterior(F.col("limits")), F.lit(None).cast("double")) if use_limits else F.lit(None).cast("double")
    p = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    scored = kept(
        placed.select(
            "k", "src", "readable", "copied", _steps(F.log(p / (1 - p))).alias("prior"), F.concat_ws(" ", "kind", "line", F.nullif("mark", F.lit(""))).alias("form"), "place",
            F.when(F.col("kind") == "bare", F.coalesce("known", F.lit("new"))).otherwise("").alias("words"),
        )
    )
    judged = F.col("readable") & ~F.col("copied")
    cells = scored.filter(judged).groupBy(*FEATURES, "prior").agg(F.count(F.lit(1)).alias("n")).collect()
    model = fitted([tuple(c) for c in sorted(cells, key=lambda c: tuple(map(str, c)))])
    prior = F.coalesce(F.greatest("prior", F.lit(model.elsewhere)) + F.log1p(F.exp(-F.abs(F.col("prior") - model.elsewhere))), F.lit(model.elsewhere))
    score = prior
    for f in FEATURES:
        table = F.create_map(*(F.lit(x) for pair in model.ratios[f].items() for x in pair))
        score = score + F.coalesce(F.try_element_at(table, F.col(f)), F.lit(0.0))
    return scored.withColumn("score", score).select(F.col("k").alias(key), F.col("src").alias(source), "score", (judged & (F.col("score") > 0)).alias("is_cut"))


def length_counts(answers: DataFrame, source: str, text: str) -> DataFrame:
    """(source, length, n): how many distinct texts of each source have a length, in characters."""
    values = answers.select(F.col(source).alias(source), F.length(text).cast("long").alias("length"), F.md5(text).alias("h")).filter("length > 0").distinct()
    return values.groupBy(source, "length").agg(F.count(F.lit(1)).alias("n"))


def cut_shares(judged: DataFrame, source: str) -> DataFrame:
    """(source, n, n_cut, share) of the result of truncated()."""
    counted = judged.groupBy(source).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_cut").alias("n_cut"))
    return counted.withColumn("share", F.col("n_cut") / F.col("n"))
