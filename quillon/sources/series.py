"""Series and places from JSON services: a Python data source with retries, and the first hit of a place lookup.

``JsonSeries`` asks one address per request row, on the executors. Responses hold parallel arrays under ``hourly``; the columns asked
for are part of the address, so the service sends no others. An attempt that fails is repeated once after a pause; Spark's own
task retries come on top.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from urllib.parse import urlencode
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

ATTEMPTS, PAUSE_SECONDS, TIMEOUT_SECONDS = 2, 0.25, 4.0


def fetch_json(address: str, attempts: int = ATTEMPTS, pause: float = PAUSE_SECONDS, timeout: float = TIMEOUT_SECONDS, open_: Callable = urlopen) -> dict:
    """The JSON at an address; any failure is tried again after the pause, and the last one is raised."""
    for attempt in range(1, attempts + 1):
        try:
            with open_(address, timeout=timeout) as answer:
                return json.load(answer)
        except Exception:
            if attempt == attempts:
                raise
            time.sleep(pause)
    raise ValueError("attempts must be positive")


def series_address(base: str, columns: list[str], **parameters: str) -> str:
    return f"{base}?{urlencode({**parameters, 'hourly': ','.join(columns)})}"


class _Request(InputPartition):
    def __init__(self, place: str, address: str):
        self.place, self.address = place, address


class JsonSeriesReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.columns = [f.name for f in schema.fields if f.name not in ("place", "pos", "time")]
        self.base, self.places = options["base"], json.loads(options["places"])

    def partitions(self) -> list[InputPartition]:
        """One per place: place -> parameters of its request."""
        return [_Request(p, series_address(self.base, self.columns, **q)) for p, q in sorted(self.places.items())]

    def read(self, partition: _Request) -> Iterator[tuple]:
        block = fetch_json(partition.address).get("hourly") or {}
        column = lambda name: block.get(name) or []
        for pos, at in enumerate(column("time")):
            rest = (column(c)[pos] if pos < len(column(c)) else None for c in self.columns)
            yield (partition.place, pos, at, *(None if x is None else float(x) for x in rest))


class JsonSeries(DataSource):
    """spark.read.format("json_series").schema("place string, pos int, time string, temperature_2m double").option("base", ...)"""

    @classmethod
    def name(cls) -> str:
        return "json_series"

    def schema(self) -> str:
        return "place string, pos int, time string, temperature_2m double"

    def reader(self, schema: StructType) -> JsonSeriesReader:
        return JsonSeriesReader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(JsonSeries)


def located(requests: DataFrame, places: DataFrame, asked: str = "q") -> DataFrame:
    """Each request with the first place of its name (``places``: name, rank and any further columns), names compared in lower case."""
    first = places.withColumn("_n", F.row_number().over(Window.partitionBy(F.lower(F.trim("name"))).orderBy("rank"))).where("_n = 1")
    key = first.select(F.lower(F.trim("name")).alias("_key"), F.struct(*(c for c in places.columns if c != "rank")).alias("location"))
    return requests.withColumn("_key", F.lower(F.trim(F.col(asked)))).join(key, "_key", "left").drop("_key")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, length and sha256 of every file under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))
