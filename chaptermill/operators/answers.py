"""Prompts for a model, parsing of its answers and checks of their manifests. All in the JVM.

A null content gives null results; content that can't be parsed gives an error text, never a
failed job.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import markdown as M

# The closed schema of a manifest: kinds of its fields, and what else they have to be.
TEXTS = ("title", "filename", "slug")
LINKS = ("readPrev", "readNext", "nextRead")
FIELDS = ("chapter_number", *TEXTS, *LINKS, "description", "keywords")
REQUIRED = ("chapter_number", *TEXTS)


def parsed_answer(content: Column) -> Column:
    """(manifest, markdown, way, error) of an answer's content.

    Way "json": one JSON object with a manifest and a markdown, neither empty. Way "fences":
    the first ```json and the first ```markdown block. Otherwise both are null and error says why.
    """
    fences = F.struct(M.unfenced(content, "json").alias("manifest"), M.unfenced(content, "markdown").alias("markdown"))

    def of_json(variant: Column) -> Column:
        manifest = F.try_variant_get(variant, "$.manifest", "variant")
        text = F.try_variant_get(variant, "$.markdown", "string")
        good = F.coalesce(F.schema_of_variant(manifest).startswith("OBJECT<"), F.lit(False)) & (F.to_json(manifest) != "{}") & (F.coalesce(text, F.lit("")) != "")
        return F.when(good, _parsed(F.to_json(manifest), text, "json")).otherwise(_failed("missing manifest or markdown"))

    def of_fences(f: Column) -> Column:
        good = F.try_parse_json(f["manifest"]).isNotNull() & f["markdown"].isNotNull()
        return F.when(good, _parsed(f["manifest"], f["markdown"], "fences")).otherwise(_failed("no JSON and no fenced blocks"))

    either = T.bound(F.try_parse_json(content), lambda v: F.when(v.isNotNull(), of_json(v)).otherwise(T.bound(fences, of_fences)))
    return F.when(content.isNotNull(), either).otherwise(_failed(None))


def _parsed(manifest: Column, markdown: Column, way: str) -> Column:
    return F.struct(manifest.alias("manifest"), markdown.alias("markdown"), F.lit(way).alias("way"), F.lit(None).cast("string").alias("error"))


def _failed(error: str | None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(none.alias("manifest"), none.alias("markdown"), none.alias("way"), F.lit(error).cast("string").alias("error"))


def json_markdown(content: str | None) -> str | None:
    """The Markdown that parsed_answer() finds in the way "json", row by row; null if the content has none."""
    try:
        answer = json.loads(content or "")
    except (ValueError, TypeError):
        return None
    good = isinstance(answer, dict) and isinstance(answer.get("manifest"), dict) and answer["manifest"] and isinstance(answer.get("markdown"), str)
    return answer["markdown"] or None if good else None


def manifest_violations(manifest: Column) -> Column:
    """What a manifest (JSON text) breaks of its schema, in the order of its fields; empty if it is right.

    Absent fields and explicit nulls differ: only links may be null. A number like 1.0 is an integer.
    """
    found = T.bound(F.try_parse_json(manifest), lambda variant: _violations(manifest, variant))
    return F.when(manifest.isNotNull(), found)


def _violations(manifest: Column, variant: Column) -> Column:
    def kind(path: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(variant, path, "variant"))

    def value(path: str, of: str = "string") -> Column:
        return F.try_variant_get(variant, path, of)

    checks = [F.when(variant.isNull() | ~F.schema_of_variant(variant).startswith("OBJECT<"), "not an object")]
    checks += [F.when(kind(f"$.{f}").isNull(), f"{f}: required") for f in REQUIRED]
    number = kind("$.chapter_number")
    whole = (number == "BIGINT") | number.rlike(r"^DECIMAL\(\d+,0\)$")
    checks.append(F.when(number.isNotNull(), F.when(~whole, "chapter_number: not an integer").when(value("$.chapter_number", "double") < 1, "chapter_number: below 1")))
    for f in TEXTS:
        checks.append(F.when(kind(f"$.{f}").isNotNull(), F.when(kind(f"$.{f}") != "STRING", f"{f}: not a string").when(value(f"$.{f}") == "", f"{f}: empty")))
    for f in LINKS:
        shape = kind(f"$.{f}")
        is_object = shape.startswith("OBJECT<")
        checks.append(F.when(shape.isNotNull() & (shape != "VOID") & ~is_object, f"{f}: not an object or null"))
        for part in ("to", "label"):
            inner = kind(f"$.{f}.{part}")
            checks.append(F.when(is_object, F.when(inner.isNull(), f"{f}.{part}: required").when(inner != "STRING", f"{f}.{part}: not a string").when(value(f"$.{f}.{part}") == "", f"{f}.{part}: empty")))
        extra = F.array_except(F.coalesce(F.json_object_keys(F.to_json(value(f"$.{f}", "variant"))), F.array().cast("array<string>")), F.array(F.lit("to"), F.lit("label")))
        checks.append(F.when(is_object & (F.size(extra) > 0), F.concat(F.lit(f"{f}: unknown "), F.array_join(F.array_sort(extra), ", "))))
    checks.append(F.when(kind("$.description").isNotNull() & (kind("$.description") != "STRING"), "description: not a string"))
    words = kind("$.keywords")
    listed = F.try_variant_get(variant, "$.keywords", "array<string>")
    checks.append(
        F.when(words.isNotNull(), F.when(~words.startswith("ARRAY<"), "keywords: not an array").when(~words.isin("ARRAY<STRING>", "ARRAY<VOID>") | F.exists(F.coalesce(listed, F.array().cast("array<string>")), lambda w: w.isNull()) & (words != "ARRAY<VOID>"), "keywords: not strings").when(F.exists(listed, lambda w: w == ""), "keywords: empty word"))
    )
    unknown = F.array_except(F.coalesce(F.json_object_keys(manifest), F.array().cast("array<string>")), F.array(*(F.lit(f) for f in FIELDS)))
    checks.append(F.when(F.size(unknown) > 0, F.concat(F.lit("unknown "), F.array_join(F.array_sort(unknown), ", "))))
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def system_prompt(rules: str, examples: str) -> str:
    return f"You convert chapters of HTML to Markdown.\n\nElements of class app-annotation, image-caption and component-list have to be kept as the rules say.\n\nFORMATTING RULES:\n{rules}\n\nEXAMPLES:\n{examples}"


def messages(html: Column, rules: str, examples: str) -> Column:
    """Array of (role, content): what a model is sent for a chapter; null for a null chapter."""
    user = F.concat(F.lit('Answer with one JSON object of "manifest" and "markdown".\n\nCHAPTER HTML:\n```html\n'), html, F.lit("\n```"))
    one = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.when(html.isNotNull(), F.array(one("system", F.lit(system_prompt(rules, examples))), one("user", user)))


def payload(sent: Column, model: str, provider: str) -> Column:
    """JSON of a request: temperature 0, seed 42 under the provider's name for it, a JSON object as answer."""
    seed = "random_seed" if provider == "mistral" else "seed"
    return F.to_json(
        F.struct(F.lit(model).alias("model"), sent.alias("messages"), F.lit(0.0).alias("temperature"), F.lit(42).alias(seed), F.struct(F.lit("json_object").alias("type")).alias("response_format"))
    )


def example_sample(df: DataFrame, path: str, k: int = 2, seed: int = 42, group: str | None = None, ties: list[str] | None = None) -> DataFrame:
    """k rows (of each group) chosen by a hash of path and seed: the same ones whatever the order or number of tasks.

    Without a group the k rows are a top-k; with groups each task keeps its own k of each before the shuffle. ties: columns that tell rows of one path apart.
    """
    from pyspark.sql import Window

    chance = F.md5(F.concat(F.col(path), F.lit(f"#{seed}")))
    if group is None:
        return df.withColumn("__c", chance).orderBy("__c", path, *(ties or [])).limit(k).drop("__c")
    place = F.row_number().over(Window.partitionBy(group).orderBy("__c", path, *(ties or [])))
    return df.withColumn("__c", chance).withColumn("__n", place).filter(F.col("__n") <= k).drop("__c", "__n")


def joined_examples(df: DataFrame, path: str, text: str) -> Column:
    """Aggregate: the texts of few rows in the order of their paths, a blank line between."""
    ordered = F.array_sort(F.collect_list(F.struct(path, text)))
    return F.array_join(F.transform(ordered, lambda x: x[text]), "\n\n")


def headers_of(api_key: str, referer: str | None = None, app_title: str | None = None) -> dict[str, str]:
    return {"Authorization": f"Bearer {api_key}", "Content-Type": "application/json"} | ({"HTTP-Referer": referer} if referer else {}) | ({"X-Title": app_title} if app_title else {})

