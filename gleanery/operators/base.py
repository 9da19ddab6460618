"""What the operators share: written lineage cuts, deterministic ids, tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.cluster import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the folder named in spark.checkpoint.dir; a local folder is set only where that is unset."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def all_of(predicates: list[Column]) -> Column:
    """Conjunction; true when there are none."""
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def first_per(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """First row of each key by a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def with_point(df: DataFrame, key: str, x: str = "x", y: str = "y", size: int = 1000) -> DataFrame:
    """Deterministic coordinates from an integer key."""
    return df.withColumn(x, (F.col(key) * 7919 % size).cast("long")).withColumn(y, (F.col(key) * 104729 % size).cast("long"))
