"""Readers of the store's inputs, all through Spark's own file systems."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.cluster import ship

_TILE = r"(\d+)_(\d+)_(\d+)\.png$"


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that are each one JSON array of arrays; the schema names the inner array's fields in order."""
    fields = [f.strip().split() for f in schema.split(",")]
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.explode(F.from_json("value", "array<array<string>>")).alias("r"))
    return rows.select(*(F.get("r", k).try_cast(kind).alias(name) for k, (name, kind) in enumerate(fields)))


def json_entries(spark: SparkSession, path: str, entry: str) -> DataFrame:
    """JSON documents with a type and nested entries."""
    docs = spark.read.json(path, multiLine=True, schema=f"type string, entries array<struct<{entry}>>")
    return docs.select("type", F.explode("entries").alias("e")).select("type", "e.*")


def tile_files(spark: SparkSession, path: str) -> DataFrame:
    """plane, region_x, region_y and bytes of tile files, keys from their names."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path)
    key = lambda k: F.regexp_extract("path", _TILE, k).try_cast("int")
    return files.select(key(1).alias("plane"), key(2).alias("region_x"), key(3).alias("region_y"), F.col("content").alias("image")).where("plane is not null")


def tile_archive(spark: SparkSession, path: str) -> DataFrame:
    """The same from zip archives, each opened where it lies."""
    import re

    def unzip(batches):
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = [(n, m) for n in z.namelist() if (m := re.search(_TILE, n))]
                    yield pd.DataFrame([(*map(int, m.groups()), z.read(n)) for n, m in names], columns=["plane", "region_x", "region_y", "image"])

    files = spark.read.format("binaryFile").load(path).select("content")
    ship(spark)
    return files.mapInPandas(unzip, "plane int, region_x int, region_y int, image binary")


def yaml_config(spark: SparkSession, path: str) -> dict:
    """A small configuration document, as nested Python values."""
    import yaml

    row = spark.read.text(path, wholetext=True).first()
    return yaml.safe_load(row.value) if row else {}


def freshness(cache: DataFrame, asked: DataFrame, now: str, ttl_seconds: int, revisions: DataFrame) -> DataFrame:
    """What to do for each asked page: hit (young enough), valid (stale, same revision), stale (other revision), miss."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("fetched_at")
    met = asked.join(cache, "title", "left").join(revisions.select("title", F.col("revid").alias("latest")), "title", "left")
    state = F.when(F.col("fetched_at").isNull(), "miss").when(age <= ttl_seconds, "hit").when(F.col("revid") == F.col("latest"), "valid").otherwise("stale")
    return met.select("title", state.alias("state"))


def paged(fetch, start=None):
    """Rows of a remote listing that's handed out in pages: fetch(token) gives (rows, next token or None)."""
    token = start
    while True:
        rows, token = fetch(token)
        yield from rows
        if token is None:
            return


def in_batches(keys: list, fetch, size: int = 50):
    """Rows of a remote lookup of at most `size` keys a call."""
    for at in range(0, len(keys), size):
        yield from fetch(keys[at : at + size])


def option_map(spark: SparkSession, path: str) -> DataFrame:
    """id, options of JSON definitions, one document each: the options that are there, in order."""
    docs = spark.read.json(path, multiLine=True, schema="id long, ops array<string>")
    return docs.select("id", F.filter("ops", lambda o: o.isNotNull() & (o != "null") & (o != "")).alias("options"))
