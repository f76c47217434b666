"""Matching headings with titles: exact, by shared words, boosted; and looking up texts.

Pairs are found by their words, never by comparing everything with everything: a score
above zero needs a shared word. Distinct texts are matched once, whatever their number of
copies; membership is joined back. Null texts match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def prefixed(df: DataFrame, id_: list[str], words: str, known: DataFrame, above: float) -> DataFrame:
    """Rows of df once for each word w of the prefix of its array of words: so many of its rarest words that two sets alike by more than `above` have one of them in common.

    known: (w, n) how often words occur, the same for both sides of a match; words that it lacks come first. id_ tells rows apart.
    """
    each = df.select(*id_, F.size(words).alias("__size"), F.explode(words).alias("w")).join(known, "w", "left")
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "w")))
    packed = each.groupBy(*id_, "__size").agg(ordered.alias("__ws"))
    prefix = F.slice("__ws", F.lit(1), F.col("__size") - F.floor(F.col("__size") * above).cast("int"))
    return packed.select(*id_, F.transform("__ws", lambda x: x["w"]).alias(words), F.explode(F.transform(prefix, lambda x: x["w"])).alias("w"))


def word_counts(df: DataFrame, words: str) -> DataFrame:
    """(w, n): rows of df that have a word."""
    return df.select(F.explode(words).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))


def best_matches(items: DataFrame, text: str, titles: DataFrame, title: str, title_id: str, above: float = 0.5, boost: float = 0.0, candidate_above: float | None = None) -> DataFrame:
    """(text, title_id, score) of the best title of each distinct text with a score above `above`; of equals the lowest id.

    The score is the share of distinct lower-case words two texts have in common. An exact
    match has score 2, before any other (blank ones too). boost is added where the first three
    words agree; candidate_above drops pairs whose boosted score doesn't exceed it. Texts
    without a match are absent. Pairs are those with a rare word in common that any two texts
    alike enough have, so frequent words don't multiply pairs and none is lost.
    """
    left = items.select(F.col(text).alias("l")).filter("l is not null").distinct().withColumn("lw", T.word_set(F.col("l")))
    right = titles.select(F.col(title).alias("t"), F.col(title_id).alias("r")).filter("t is not null").distinct().withColumn("rw", T.word_set(F.col("t")))
    least = max(0.0, above - boost)
    known = word_counts(right, "rw")
    a, b = prefixed(left, ["l"], "lw", known, least), prefixed(right, ["t", "r"], "rw", known, least)
    score = T.jaccard(F.col("lw"), F.col("rw"))
    if boost:
        first = lambda c: F.slice(T.words(F.lower(c)), 1, 3)
        score = score + F.when(first(F.col("l")) == first(F.col("t")), boost).otherwise(0.0)
    alike = a.join(b, "w").select("l", "r", score.alias("score")).filter(F.col("score") > max(above, candidate_above or 0.0))
    same = left.join(right, F.lower("l") == F.lower("t") if boost else F.col("l") == F.col("t")).select("l", "r", F.lit(2.0).alias("score"))
    best = alike.unionByName(same).groupBy("l").agg(F.max(F.struct("score", (-F.col("r")).alias("back"))).alias("m"))
    return best.select(F.col("l").alias(text), (-F.col("m.back")).alias(title_id), F.col("m.score").alias("score"))


def numbers_of_texts(texts: DataFrame, toc: DataFrame, group: str, text: str, above: float = 0.5) -> DataFrame:
    """(group, text, number, score) of each distinct text of a group (a document) found in the group's own contents.

    toc: the result of numbering_map(). An equal title (score 2) beats those that share more than `above` of their
    words; of equals the one that stands first counts. Texts without a match, null texts and null groups are absent.
    """
    left = texts.select(F.col(group).alias("g"), F.col(text).alias("l")).filter("g is not null and l is not null").distinct().withColumn("lw", T.word_set(F.col("l")))
    right = toc.select(F.col(group).alias("g"), F.col("title").alias("t"), "number", F.col("first_pos").alias("p")).withColumn("rw", T.word_set(F.col("t")))
    known = word_counts(right, "rw")
    a, b = prefixed(left, ["g", "l"], "lw", known, above), prefixed(right, ["g", "t", "number", "p"], "rw", known, above)
    alike = a.join(b, ["g", "w"]).select("g", "l", "number", "p", T.jaccard(F.col("lw"), F.col("rw")).alias("score")).filter(F.col("score") > above)
    same = left.join(right.drop("rw"), (left["g"] == right["g"]) & (F.col("l") == F.col("t"))).select(left["g"], "l", "number", "p", F.lit(2.0).alias("score"))
    best = alike.unionByName(same).groupBy("g", "l").agg(F.max(F.struct("score", (-F.col("p")).alias("back"), "number")).alias("m"))
    return best.select(F.col("g").alias(group), F.col("l").alias(text), F.col("m.number").alias("number"), F.col("m.score").alias("score"))


def exact_numbers(headings: DataFrame, toc: DataFrame, on: list[str], number: str = "number") -> DataFrame:
    """headings with the number of the contents row of equal keys, or null."""
    return headings.join(toc.select(*on, F.col(number).alias("toc_number")), on, "left")


# Fixed value:
#: An anchor and the words right after it that look like a heading, up to a sign, an acronym, a tag, two spaces or the end.
ANCHORED = r'<a id="__RefHeading___\d+"></a>([А-ЯЁA-Z][а-яёa-z\s]+?)(?=Программный|[.!?]|[А-ЯЁA-Z]{3,}|<|\s{2,}|\z)'


def headings_from_anchors(html: Column, toc: Column) -> Column:
    """Markup in which an anchor and a heading-like text that toc knows become its heading; toc: array of (level, number, title); others stay.

    Of titles that differ in case only the last one counts.
    """
    whole, inner = (F.regexp_extract_all(html, F.lit(ANCHORED), F.lit(g)) for g in (0, 1))
    found = F.arrays_zip(whole.alias("whole"), inner.alias("inner"))

    def step(page: Column, m: Column) -> Column:
        known = F.filter(toc, lambda t: F.lower(t["title"]) == F.lower(T.strip(m["inner"])))
        t = F.try_element_at(known, F.lit(-1))
        level = t["level"].cast("string")
        heading = F.concat(F.lit("<h"), level, F.lit(">"), t["number"], F.lit(" "), t["title"], F.lit("</h"), level, F.lit(">"))
        return F.when(F.size(known) > 0, F.replace(page, m["whole"], heading)).otherwise(page)

    return F.aggregate(found, html, step)


def missing_texts(texts: Column, whole: Column) -> Column:
    """Those of an array of texts that aren't blank and don't stand in whole."""
    return F.filter(texts, lambda x: (T.strip(x) != "") & ~F.contains(whole, T.strip(x)))


def text_hits(df: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """(term, key, at, preview) of each term that stands in a text, case ignored; at counts characters from 1."""
    lower = F.lower(F.col(text))
    hits = F.filter(F.array(*(F.lit(t) for t in terms)), lambda t: F.contains(lower, F.lower(t)))
    found = df.select(F.col(key), F.col(text), F.explode(hits).alias("term"))
    return found.select("term", key, F.expr(f"locate(lower(term), lower(`{text}`))").alias("at"), T.preview(F.col(text)).alias("preview"))


def first_hits(hits: DataFrame, n: int, key: str) -> DataFrame:
    """The n hits of each term with the lowest keys; every task keeps its own n before the shuffle."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("term").orderBy(key))
    return hits.withColumn("__n", place).filter(F.col("__n") <= n).drop("__n")


def primary_or_fallback(df: DataFrame, primary: Column, fallback: Column) -> DataFrame:
    """Rows for which primary holds; if there are none at all, those for which fallback holds."""
    some = df.filter(primary).limit(1).select(F.lit(True).alias("__some"))
    first = df.filter(primary)
    rest = df.filter(fallback).withColumn("__one", F.lit(1)).join(some.withColumn("__one", F.lit(1)), "__one", "left_anti").drop("__one")
    return first.unionByName(rest)
