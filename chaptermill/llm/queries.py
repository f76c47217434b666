"""The queries of the training-data operators, each over its whole tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, leakage, lookalike, pairs, residue, split, tokens, truncation
from .arrowtext import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.same_looking(table(spark, d, "heading_structure"), "heading_id", "title", table(spark, d, "toc_titles"), "title_id", "title")


def p1_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every heading's title in the consistent form."""
    return lookalike.consistent_form(table(spark, d, "heading_structure").select("heading_id", "title"), "title").distinct()


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_oversized(table(spark, d, "chapter"), "chapter_id", "chapter_html")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).filter((F.col("piece_no") == 2) & (F.length("piece") > split.OVERLAP)).select("chapter_id")


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d)


def p2_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """Digest of each oversized chapter put together again from its pieces."""
    own = F.when(F.col("piece_no") == 1, F.col("piece")).otherwise(F.substr("piece", F.lit(split.OVERLAP + 1)))
    joined = _pieces(spark, d).groupBy("chapter_id").agg(F.array_sort(F.collect_list(F.struct("piece_no", own.alias("own")))).alias("p"))
    return joined.select("chapter_id", F.md5(F.array_join(F.transform("p", lambda x: x["own"]), "")).alias("hash"))


def p2_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Of each oversized chapter whether its pieces are within the limit and numbered in order, and whether each begins with the end of the one before it."""
    listed = _pieces(spark, d).groupBy("chapter_id").agg(F.array_sort(F.collect_list(F.struct("piece_no", "piece"))).alias("p"), F.max("n_pieces").alias("n"))
    before = lambda x, i: F.right(F.get(F.col("p"), i - 1)["piece"], F.lit(split.OVERLAP))
    repeats = F.transform("p", lambda x, i: (i == 0) | (F.left(x["piece"], F.lit(split.OVERLAP)) == before(x, i)))
    within = F.forall("p", lambda x: (F.length(x["piece"]) <= split.LIMIT) & (F.length(x["piece"]) > split.OVERLAP))
    return listed.select("chapter_id", within.alias("within"), F.forall(repeats, lambda x: x).alias("overlaps"), ((F.size("p") == F.col("n")) & (F.get("p", F.size("p") - 1)["piece_no"] == F.col("n"))).alias("numbered"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    answers = table(spark, d, "llm_response").filter("status = 200")
    return pairs.broken_pairs(answers, "response_id", "markdown", "chapter_id", table(spark, d, "chapter"), "chapter_id", "chapter_html", table(spark, d, "lang_samples"))


def p3_defect_counts(spark: SparkSession, d: str) -> DataFrame:
    return p3_found(spark, d).groupBy("defect").agg(F.count(F.lit(1)).alias("n"))


def _cut(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "llm_response"), "response_id", "source", "markdown", "chapter_id", table(spark, d, "chapter"), "chapter_id", "chapter_html")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _cut(spark, d).filter("is_cut").select("response_id")


def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    """How often each source cuts: over its responses that have a text."""
    return truncation.cut_shares(_cut(spark, d), "source")


def p4_lengths(spark: SparkSession, d: str) -> DataFrame:
    """How many different texts each source has at each length: where limits show."""
    return truncation.length_counts(table(spark, d, "llm_response"), "source", "markdown")


_MANIFEST_FIELDS = ("title", "filename", "slug")


def _residue(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "chapter_manifest"), "manifest_id", _MANIFEST_FIELDS)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _residue(spark, d).select("manifest_id", "field")


def p5_contents(spark: SparkSession, d: str) -> DataFrame:
    """The manifests fit for a table of contents: a title and a slug, and no field with residue."""
    manifests = table(spark, d, "chapter_manifest").select("manifest_id", "response_id", "title", "slug").distinct()
    named = manifests.filter((F.trim("title") != "") & (F.trim("slug") != ""))
    return named.join(_residue(spark, d).select("manifest_id").distinct(), "manifest_id", "left_anti")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encoded(table(spark, d, "documents"), "doc_id", "text")


def p6_text(spark: SparkSession, d: str) -> DataFrame:
    """Digest of each text decoded from its ids; a null text comes back empty."""
    return tokens.decoded(p6_ids(spark, d), "doc_id", "ids").select("doc_id", F.md5("text").alias("hash"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "benchmark"), "item_id", "text")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """How many documents each test item leaked into; items that didn't leak have 0."""
    counted = p7_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))
    items = table(spark, d, "benchmark").select("item_id").distinct()
    return items.join(counted, "item_id", "left").select("item_id", F.coalesce("n_documents", F.lit(0)).alias("n_documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    profiles = language.profiles_of(table(spark, d, "lang_samples"))
    return language.document_languages(table(spark, d, "documents"), "doc_id", "text", "lang", profiles).filter("problem is not null").select("doc_id", "lang")


def p8_documents(spark: SparkSession, d: str) -> DataFrame:
    profiles = language.profiles_of(table(spark, d, "lang_samples"))
    return language.document_languages(table(spark, d, "documents"), "doc_id", "text", "lang", profiles)


def p8_segments(spark: SparkSession, d: str) -> DataFrame:
    profiles = language.profiles_of(table(spark, d, "lang_samples"))
    return language.language_segments(table(spark, d, "documents"), "doc_id", "text", profiles)


def p8_labels(spark: SparkSession, d: str) -> DataFrame:
    """The language that each document's label names, empty if it names none."""
    return table(spark, d, "documents").select("doc_id", language.label_language(F.col("lang")).alias("label"))


def p8_unlabelled(spark: SparkSession, d: str) -> DataFrame:
    """Documents with words but without a label, all of which come out with a language."""
    return p8_documents(spark, d).filter("problem = 'missing'").select("doc_id").distinct()


def queries() -> dict[str, Query]:
    listed = (p1_found, p1_forms, p2_found, p2_pieces, p2_rejoined, p2_sizes, p3_found, p3_defect_counts, p4_found, p4_shares, p4_lengths, p5_found, p5_contents, p6_ids, p6_text, p7_found, p7_items, p8_found, p8_documents, p8_segments, p8_labels, p8_unlabelled)
    return {q.__name__: q for q in listed}


_SHARED_STRETCH = """
with item_words as (
    select item_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as w from benchmark
), stretches as (
    select distinct item_id, array_to_string(w[i:i + 11], ' ') as s from item_words, unnest(range(1, len(w) - 10)) as t(i)
), doc_words as (
    select doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as w from documents where text is not null
), doc_stretches as (
    select doc_id, array_to_string(w[i:i + 11], ' ') as s from doc_words, unnest(range(1, len(w) - 10)) as t(i)
)
"""


_SPELLED = ", ".join(f"({spelling!r}, {code!r})" for code, names in language.SPELLINGS.items() for spelling in names)
_UNKNOWN = ", ".join(repr(x) for x in language.UNKNOWN)
_LABELS = rf"""with s(spelling, code) as (values {_SPELLED}), d as (select doc_id, text, lower(trim(coalesce(lang, ''))) as l from documents),
named as (select doc_id, text, l, coalesce(a.code, b.code) as code from d left join s a on a.spelling = l left join s b on b.spelling = regexp_extract(l, '^([^\s_(\-]+)', 1)),
labels as (select doc_id, text, case when l in ({_UNKNOWN}) then '' else coalesce(code, l) end as label from named)
""".replace("\\\\", "\\")


def oracle_sql() -> dict[str, str]:
    return {
        "p2_rejoined": "select distinct chapter_id, md5(chapter_html) as hash from chapter where length(chapter_html) > 4000",
        "p2_sizes": "select distinct chapter_id, true as within, true as overlaps, true as numbered from chapter where length(chapter_html) > 4000",
        "p6_text": "select doc_id, md5(coalesce(text, '')) as hash from documents",
        "p8_labels": _LABELS + "select doc_id, label from labels",
        "p8_unlabelled": _LABELS + r"select doc_id from labels where label = '' and regexp_matches(text, '(?:^|[^\p{L}\p{N}])\p{L}+(?:$|[^\p{L}\p{N}_])')",
        "p4_lengths": "select source, length(markdown) as length, count(distinct md5(markdown)) as n from llm_response where markdown <> '' group by 1, 2",
        "p2_found": "select distinct chapter_id from chapter where length(chapter_html) > 4000",
        "p7_found": _SHARED_STRETCH + "select distinct d.doc_id, i.item_id from doc_stretches d join stretches i using (s)",
        "p7_items": _SHARED_STRETCH
        + ", found as (select distinct d.doc_id, i.item_id from doc_stretches d join stretches i using (s)) select b.item_id, count(f.doc_id) as n_documents from (select distinct item_id from benchmark) b left join found f using (item_id) group by b.item_id",
    }
