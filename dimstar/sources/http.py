"""A batch data source for delimited text over HTTP, one partition per URL, with retries, typed fields, and filters sent along.

    spark.dataSource.register(HttpCsv)
    spark.read.format("http_csv").schema("id string, disposition string").option("urls", "https://a/x.csv https://a/y.csv").load()

Options: urls (space-separated), tries (8), backoff (1.5 seconds, doubled each time), pause (seconds before each request), agent,
columns (the URL parameter that gets the schema's names, comma-joined, so that only they are sent), where (the URL parameter that gets
the filters that the service can apply: comparisons of a column with a number or text, joined by "and"). `where` needs the setting
spark.sql.python.filterPushdown.enabled; Spark applies the filters again to what comes back.
"""

from __future__ import annotations

import csv
import datetime
import io
import random
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import BooleanType, DateType, DoubleType, FloatType, IntegerType, LongType, StringType, TimestampNTZType, TimestampType

from dimstar.sources.readers import exists

#: Answers that are worth another try.
RETRY_STATUS = (429, 500, 502, 503, 504)


def fetch(url: str, tries: int, backoff: float, agent: str, timeout: float = 60.0) -> str:
    """The text at a URL; errors of the network and RETRY_STATUS are tried again, the last error is raised."""
    for attempt in range(tries):
        try:
            request = urllib.request.Request(url, headers={"User-Agent": agent})
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return answer.read().decode("utf-8", "replace")
        except (urllib.error.URLError, TimeoutError, ConnectionError) as error:
            status = getattr(error, "code", None)
            if attempt + 1 == tries or (status is not None and status not in RETRY_STATUS):
                raise
            time.sleep(backoff * 2**attempt * random.uniform(0.5, 1.0))
    raise ValueError("tries has to be 1 or more")


class _Url(InputPartition):
    def __init__(self, url: str):
        super().__init__(url)
        self.url = url


class HttpCsv(DataSource):
    @classmethod
    def name(cls) -> str:
        return "http_csv"

    def schema(self) -> str:
        raise ValueError("give a schema with .schema(...)")

    def reader(self, schema) -> DataSourceReader:
        # Spark refuses readers that take filters unless its setting allows them
        return (_FilteringReader if self.options.get("where") else _Reader)(self.options, schema)


def _flag(text: str) -> bool | None:
    return {"true": True, "t": True, "1": True, "false": False, "f": False, "0": False}.get(text.strip().lower())


#: How the text of a field becomes a value; text that doesn't is NULL.
_READ: dict[type, Callable[[str], Any]] = {
    StringType: str, IntegerType: lambda x: _whole(x, 31), LongType: lambda x: _whole(x, 63), DoubleType: float, FloatType: float, BooleanType: _flag,
    DateType: lambda x: datetime.date.fromisoformat(x[:10]), TimestampType: datetime.datetime.fromisoformat, TimestampNTZType: datetime.datetime.fromisoformat,
}


def _whole(text: str, bits: int) -> int | None:
    value = int(text) if text.lstrip("+-").isdigit() else float(text)
    return int(value) if value == int(value) and abs(value) < 2**bits else None


def typed(text: str | None, read: Callable[[str], Any]) -> Any:
    """The value of a field; NULL for missing, blank and unreadable ones."""
    if text is None or not text.strip():
        return None
    try:
        return read(text if read is str else text.strip())
    except (ValueError, OverflowError):
        return None


_COMPARED = ((EqualTo, "="), (GreaterThan, ">"), (GreaterThanOrEqual, ">="), (LessThan, "<"), (LessThanOrEqual, "<="))


def condition(f: Filter) -> str | None:
    """The text of a filter that a service can apply, None for others."""
    for kind, sign in _COMPARED:
        if type(f) is kind and len(f.attribute) == 1 and isinstance(f.value, (int, float, str)) and not isinstance(f.value, bool):
            value = "'" + f.value.replace("'", "''") + "'" if isinstance(f.value, str) else repr(f.value)
            return f"{f.attribute[0]} {sign} {value}"
    return None


class _Reader(DataSourceReader):
    def __init__(self, options, schema):
        self.options, self.fields = dict(options), [(f.name, _READ.get(type(f.dataType))) for f in schema.fields]
        refused = [n for n, read in self.fields if read is None]
        if refused:
            raise ValueError(f"no text becomes a value of these columns: {refused}")
        self.conditions: list[str] = []

    def url(self, base: str) -> str:
        """A URL with the columns and filters that the service is asked for."""
        more = {}
        if self.options.get("columns"):
            more[self.options["columns"]] = ",".join(n for n, _ in self.fields)
        if self.conditions:
            more[self.options["where"]] = " and ".join(self.conditions)
        return base + ("&" if "?" in base else "?") * bool(more) + urllib.parse.urlencode(more)

    def partitions(self) -> list[InputPartition]:
        return [_Url(self.url(u)) for u in self.options["urls"].split()]

    def read(self, partition: _Url) -> Iterator[tuple]:
        o = self.options
        time.sleep(float(o.get("pause", 0)))
        text = fetch(partition.url, int(o.get("tries", 8)), float(o.get("backoff", 1.5)), o.get("agent", "dimstar"))
        for row in csv.DictReader(io.StringIO(text)):
            yield tuple(typed(row.get(n), read) for n, read in self.fields)


class _FilteringReader(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            text = condition(f)
            if text:
                self.conditions.append(text)
            yield f  # services differ in how they compare, so Spark applies it, too


def patches_until(spark: SparkSession, urls: list[str], needed: int, key: Callable[[DataFrame], DataFrame], path: str, schema: str, at_once: int = 1, **options: str) -> DataFrame:
    """(target, patch) of the searches at `urls`, asked for in order, `at_once` at a time, until they have `needed` distinct targets.

    `key` makes (target) of what a search returns. Each search is written to a folder of `path`, and one that is there isn't asked for
    again, so a run that broke off goes on. Targets go with the first search that has them.
    """
    def found() -> DataFrame:
        rows = spark.read.schema("target string, patch int").parquet(path) if exists(spark, path) else spark.createDataFrame([], "target string, patch int")
        return rows.filter("target is not null").groupBy("target").agg(F.min("patch").alias("patch"))

    for at in range(0, len(urls), at_once):
        if found().limit(needed).count() >= needed:
            break
        for i, url in list(enumerate(urls))[at : at + at_once]:
            if not exists(spark, f"{path}/search={i}/_SUCCESS"):
                rows = spark.read.format("http_csv").schema(schema).options(urls=url, **options).load()
                key(rows).select(F.col("target").cast("string").alias("target"), F.lit(i).alias("patch")).write.mode("overwrite").parquet(f"{path}/search={i}")
    return found()
