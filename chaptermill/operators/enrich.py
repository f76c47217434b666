"""Asking a model for each row: retries, checks and errors as columns, over any transport.

A transport is made once for each task and is a callable from (payload, headers) to (status,
content type, body). Nothing is retried across tasks: a task that runs again asks again, so
write the result before using it twice (cached_answers() leaves out what was answered).
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from urllib.error import HTTPError
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..sources.files import Settings
from .answers import headers_of

Transport = Callable[[str, dict[str, str]], tuple[int, str, str]]
Check = Callable[[str, str], bool]

#: Seconds before the second attempt; each further wait doubles.
FIRST_WAIT = 1.0
_OUT = (("status", IntegerType()), ("attempts", IntegerType()), ("content", StringType()), ("error", StringType()))


def http_transport(settings: Settings) -> Callable[[], Transport]:
    """A factory of transports that post to the settings' endpoint."""

    def factory() -> Transport:
        def post(payload: str, headers: dict[str, str]) -> tuple[int, str, str]:
            request = Request(settings.endpoint, payload.encode(), headers, method="POST")
            try:
                with urlopen(request, timeout=settings.timeout) as answer:  # noqa: S310
                    return answer.status, answer.headers.get("Content-Type", ""), answer.read().decode("utf-8", "replace")
            except HTTPError as e:
                return e.code, e.headers.get("Content-Type", "") if e.headers else "", e.read().decode("utf-8", "replace")

        return post

    return factory


def asked(payload: str, transport: Transport, headers: dict[str, str], attempts: int = 5, complete: Callable[[str], bool] | None = None, sleep: Callable[[float], None] = time.sleep) -> tuple[int | None, int, str | None, str | None]:
    """(status, attempts, content, error) of one request.

    Status 429 and 5xx, failures to connect and incomplete answers are tried again with doubled
    waits; other statuses end at once. The last incomplete answer is accepted with a warning in error.
    """
    wait, status, error = FIRST_WAIT, None, None
    for attempt in range(1, attempts + 1):
        try:
            status, kind, body = transport(payload, headers)
        except OSError as e:
            status, kind, body, error = None, "", "", str(e)[:200]
        if status == 200:
            try:
                content = json.loads(body)["choices"][0]["message"]["content"]
            except (ValueError, KeyError, IndexError, TypeError):
                return status, attempt, None, f"not JSON ({kind}): {body[:200]}"
            if complete is None or complete(content):
                return status, attempt, content, None
            error = "incomplete answer"
            if attempt == attempts:
                return status, attempt, content, error
        elif status is not None and status != 429 and status < 500:
            return status, attempt, None, body[:200]
        elif status is not None:
            error = body[:200]
        if attempt < attempts:
            sleep(wait)
            wait *= 2
    return status, attempts, None, error


def enriched(df: DataFrame, key: str, payload: str, settings: Settings, factory: Callable[[], Transport] | None = None, check: Check | None = None, source: str | None = None, keep: list[str] | None = None, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(key, columns of keep, status, attempts, content, error) of each row; check(source text, content) tells a complete answer. Null payloads are errors."""
    keep = keep or []
    make = factory or http_transport(settings)
    headers = headers_of(settings.api_key, settings.referer, settings.app_title)
    rows = df.select(F.col(key).alias("k"), F.col(payload).alias("p"), (F.col(source) if source else F.lit(None).cast("string")).alias("s"), *keep)
    schema = StructType([rows.schema["k"], *(rows.schema[c] for c in keep), *(StructField(n, t) for n, t in _OUT)])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        transport = make()
        for part in parts:
            out = []
            for p, s in zip(part["p"], part["s"], strict=True):
                complete = (lambda content, s=s: check(s, content)) if check and s is not None else None
                out.append(((None, 0, None, "no payload") if p is None else asked(p, transport, headers, settings.attempts, complete, sleep)))
            yield pd.concat([part[["k", *keep]].reset_index(drop=True), pd.DataFrame(out, columns=[n for n, _ in _OUT]).astype(object)], axis=1)

    return rows.mapInPandas(run, schema).withColumnRenamed("k", key)


def cached_answers(df: DataFrame, payload: str, answered: DataFrame) -> DataFrame:
    """Rows of df whose payload isn't among answered ones; answered has request, the sha2 of their payloads."""
    return df.withColumn("request", F.sha2(payload, 256)).join(answered.select("request").distinct(), "request", "left_anti")


def offline(answer: Callable[[str], str]) -> Callable[[], Transport]:
    """A transport that answers by a function of the user's message, for tests and dry runs."""

    def factory() -> Transport:
        def post(payload: str, headers: dict[str, str]) -> tuple[int, str, str]:
            user = json.loads(payload)["messages"][-1]["content"]
            return 200, "application/json", json.dumps({"choices": [{"message": {"content": answer(user)}}]}, ensure_ascii=False)

        return post

    return factory
