"""What the operators of this subpackage share: tables, written tables, held-out rows."""

from __future__ import annotations

import atexit
import os
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gleanery.cluster import shared_folder, ship

__all__ = ["documents", "drop_at_exit", "held_out", "shared_folder", "ship", "small_batches", "sweep_at_exit", "table", "tokenizer_path", "written", "written_and_counted"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame) -> DataFrame:
    """doc_id and text alone: other columns, whatever their names, never reach an operator."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """True for the quarter of rows that no model may learn from."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def written(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """The same rows, read back from Parquet in the shared folder: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/gleanery-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    sweep_at_exit(spark)
    return spark.read.schema(df.schema).parquet(path)


def written_and_counted(df: DataFrame, which: Column) -> tuple[DataFrame, int]:
    """written(), and how many of the rows a condition holds for, counted as they're written: no job of its own."""
    seen = Observation()
    out = written(df.observe(seen, F.count_if(which).alias("n")))
    return out, seen.get.get("n", 0)  # a plan that turns out empty has no figures


_swept: set[str] = set()


def sweep_at_exit(spark: SparkSession) -> None:
    """Remove this application's written tables when the driver ends in good order."""
    app = spark.sparkContext.applicationId
    if app in _swept:
        return
    _swept.add(app)
    folder = f"{shared_folder(spark)}/gleanery-{app}"

    def sweep() -> None:
        jvm = spark.sparkContext._jvm
        if jvm is None or spark.sparkContext._jsc is None:
            return
        try:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session may be gone already; the cluster's own clean-up of the folder then applies
            pass

    atexit.register(sweep)


def drop_at_exit(spark: SparkSession, name: str) -> None:
    """Remove a table of the warehouse when the driver ends in good order."""

    def drop() -> None:
        if spark.sparkContext._jsc is not None:
            try:
                spark.sql(f"drop table if exists {name}")
            except Exception:  # as above
                pass

    atexit.register(drop)


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file; read where it is, never copied."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what one Arrow batch holds, in rows and in bytes, where the session says nothing of it: texts can be long."""
    said = spark.conf.getAll
    for key, value in (("maxRecordsPerBatch", str(rows)), ("maxBytesPerBatch", str(8 << 20))):
        if f"spark.sql.execution.arrow.{key}" not in said:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", value)
