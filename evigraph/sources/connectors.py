"""Connectors behind one seam: a callable from a query to rows, run on the executors, and a fixture for tests.

``SearchSource`` also makes such results a table: spark.read.format("search").option("query", q).option("fixture", path).load().
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from evigraph.functions.text import CONNECTION, PERMANENT, TRANSIENT  # noqa: F401  (what the fetchers' retries rest on)

RESULT = "title string, url string, body string, raw_content string"
EXTRACT_URLS = 20


class SearchReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.query, self.fixture = options.get("query", ""), options.get("fixture")

    def read(self, partition):
        with open(self.fixture, encoding="utf-8") as f:
            for line in f:
                row = json.loads(line)
                if not self.query or self.query == row.get("query"):
                    yield row.get("title"), row.get("url"), row.get("body"), row.get("raw_content")


class SearchSource(DataSource):
    """Rows of a search from a JSON-lines fixture: the place of a live service in tests and offline runs."""

    @classmethod
    def name(cls) -> str:
        return "search"

    def schema(self) -> str:
        return RESULT

    def reader(self, schema):
        return SearchReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SearchSource)


def retrying(fetch: Callable[[str], list[tuple]], tries: int = 3, transient=None, sleep=time.sleep) -> Callable[[str], list[tuple]]:
    """``fetch`` with waits of 2**n seconds and up to a tenth more between tries; errors that are not transient end it."""
    import re

    passing = re.compile(transient or TRANSIENT)
    final = re.compile(PERMANENT)

    def run(arg: str) -> list[tuple]:
        for n in range(tries):
            try:
                return fetch(arg)
            except Exception as e:
                text = str(e).lower()
                if n + 1 == tries or final.search(text) or not passing.search(text):
                    return []
                sleep(2**n * (1 + random.random() / 10))
        return []

    return run


def fetch_rows(queries: DataFrame, column: str, fetch: Callable[[str], list[tuple]], schema: str) -> DataFrame:
    """Rows of ``fetch`` for each distinct value, made on the executors; the value stands first as ``column``."""
    names = [p.strip().split(" ")[0] for p in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(q, *row) for q in f[column] for row in fetch(q)]
            yield pd.DataFrame(rows, columns=[column, *names])

    return queries.where(F.col(column).isNotNull()).select(column).distinct().mapInPandas(run, f"{column} string, {schema}")


def generated(prompts: DataFrame, prompt: str, generate: Callable[[str], str | None], cache: DataFrame | None = None) -> DataFrame:
    """Adds prompt_hash and response of a text generator; answers of ``cache`` (prompt_hash, response) are not asked again."""
    @F.pandas_udf("string")
    def ask(p: pd.Series) -> pd.Series:
        return p.map(lambda x: generate(x) if x is not None else None)

    p = prompts.withColumn("prompt_hash", F.sha2(prompt, 256))
    if cache is None:
        return p.withColumn("response", ask(F.col(prompt)))
    known = cache.dropDuplicates(["prompt_hash"]).select("prompt_hash", "response")
    return p.join(known, "prompt_hash").unionByName(p.join(known, "prompt_hash", "left_anti").withColumn("response", ask(F.col(prompt))))


def usage_from_payload(payloads: DataFrame, text: str) -> DataFrame:
    """key_usage, credits_used, credits_limit of account payloads of differing field names."""
    first = lambda *names: F.coalesce(*[F.get_json_object(text, "$." + n).try_cast("long") for n in names])
    return payloads.select("*", first("key.usage", "usage").alias("key_usage"), first("account.plan_usage", "credits_used", "used").alias("credits_used"), first("account.plan_limit", "credits_limit", "limit").alias("credits_limit"))
