"""Text, Markdown and HTML files as rows; one row for each whole file."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import markdown as M


def whole_texts(spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = False) -> DataFrame:
    """(path, text) of files, each read whole."""
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def samples(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files under path, recursively, ordered by the parts of their paths."""
    return whole_texts(spark, path, "*.md", recursive=True).orderBy(F.split("path", "/"))


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, text, title, body) of the Markdown files in a folder, not in folders below, ordered by name in code points."""
    read = whole_texts(spark, path, "*.md")
    return read.select("path", T.file_name(F.col("path")).alias("name"), "text", M.title(F.col("text")).alias("title"), M.body(F.col("text")).alias("body")).orderBy("name")


def html_files(spark: SparkSession, path: str) -> DataFrame:
    return whole_texts(spark, path, "*.html")


@dataclass(frozen=True)
class Settings:
    """Options of a run, from the environment with defaults; keys of services are kept out of columns and plans."""

    provider: str = "openrouter"
    model: str | None = None
    endpoint: str = "https://openrouter.ai/api/v1/chat/completions"
    api_key: str = field(default="", repr=False)
    referer: str | None = None
    app_title: str | None = None
    timeout: float = 30.0
    attempts: int = 5

    @classmethod
    def from_environment(cls, env: dict[str, str] | None = None) -> Settings:
        env = dict(os.environ) if env is None else env
        provider = env.get("LLM_PROVIDER", cls.provider).lower()
        prefix = provider.upper()
        return cls(
            provider=provider,
            model=env.get(f"{prefix}_MODEL") or None,
            endpoint=env.get(f"{prefix}_ENDPOINT", ENDPOINTS.get(provider, cls.endpoint)),
            api_key=env.get(f"{prefix}_API_KEY", ""),
            referer=env.get("HTTP_REFERER"),
            app_title=env.get("APP_TITLE"),
        )


# Public addresses of chat completion services.
ENDPOINTS = {"openrouter": "https://openrouter.ai/api/v1/chat/completions", "mistral": "https://api.mistral.ai/v1/chat/completions"}
DEFAULT_MODELS = {"openrouter": "openai/gpt-4o-mini", "mistral": "mistral-large-latest"}


def checked(settings: Settings) -> Settings:
    """settings with a model, or an error before any job: unknown provider (ValueError) or missing key (RuntimeError)."""
    if settings.provider not in ENDPOINTS:
        raise ValueError(f"unknown provider: {settings.provider}")
    if not settings.api_key:
        raise RuntimeError(f"{settings.provider.upper()}_API_KEY is not set")
    from dataclasses import replace

    return settings if settings.model else replace(settings, model=DEFAULT_MODELS[settings.provider])
