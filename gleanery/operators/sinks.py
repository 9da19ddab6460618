"""Writes as whole-table rewrites: each function returns the table as it is after the write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import checkpointed, first_per


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """New rows whose key isn't there; within the batch the first by order. Null keys equal one another."""
    first = first_per(new, keys, order)
    a, b = first.alias("n"), old.alias("o")
    on = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
    return old.unionByName(a.join(b, on, "left_anti"), allowMissingColumns=True)


def insert_or_replace(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key wins."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return first_per(both, keys, F.desc("_new"), F.desc(order)).drop("_new")


def insert_or_get_id(dimension: DataFrame, values: DataFrame, natural: list[str]) -> DataFrame:
    """The dimension with the new natural keys added, ids following the largest one in order of the keys. New keys are ranked inside
    ranges of them, whose sizes alone are added up in one place."""
    fresh = values.select(*natural).distinct().join(dimension, natural, "left_anti")
    fresh = checkpointed(fresh.repartitionByRange(*natural).withColumn("_range", F.spark_partition_id()))
    top = dimension.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    sizes = fresh.groupBy("_range").agg(F.count("*").alias("_n"))  # a row for each partition
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*natural))
    ranked = fresh.withColumn("_place", place).join(F.broadcast(before), "_range").crossJoin(F.broadcast(top))
    return dimension.select("id", *natural).unionByName(ranked.select((F.col("_top") + F.col("_before") + F.col("_place")).cast(dimension.schema["id"].dataType).alias("id"), *natural))


def update(old: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    new = changes.select(key, F.col(column).alias("_new"))
    return old.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).select(*old.columns)


def or_update(old: DataFrame, masks: DataFrame, key: str, column: str) -> DataFrame:
    """Bits of all masks of a key added to its column."""
    added = masks.groupBy(key).agg(F.bit_or("mask").alias("_add"))
    return old.join(added, key, "left").withColumn(column, F.col(column).bitwiseOR(F.coalesce("_add", F.lit(0)))).select(*old.columns)


def replace_scope(old: DataFrame, new: DataFrame, scope: list[str]) -> DataFrame:
    """All rows of the scopes that the new rows have are replaced by them."""
    return old.join(new.select(*scope).distinct(), scope, "left_anti").unionByName(new)


def cascade_delete(tables: dict[str, DataFrame], links: list[tuple[str, str, str, str]], root: str, doomed: DataFrame, key: str) -> dict[str, DataFrame]:
    """Tables without the doomed rows of the root and without all that refers to them. links: (child, its column, parent,
    the parent's column), parents first."""
    gone = {root: tables[root].join(doomed, key, "left_semi")}
    out = dict(tables) | {root: tables[root].join(doomed, key, "left_anti")}
    for child, column, parent, parent_key in links:
        if parent not in gone:
            continue
        dead = gone[parent].select(F.col(parent_key).alias(column)).distinct()
        hit = tables[child].join(dead, column, "left_semi")
        gone[child] = hit if child not in gone else gone[child].unionByName(hit).distinct()
        out[child] = out[child].join(dead, column, "left_anti")
    return out


def lineage(pages: DataFrame, table: str) -> DataFrame:
    """table_name, wiki_page, authors in order, from rows of (page, author)."""
    authors = F.array_join(F.array_sort(F.collect_set("author")), ", ")
    return pages.groupBy(F.col("page").alias("wiki_page")).agg(authors.alias("authors")).withColumn("table_name", F.lit(table))


def aliases(redirects: DataFrame, known: DataFrame) -> DataFrame:
    """(key, alias) of redirects to known names that aren't names themselves."""
    hit = redirects.join(known.select(F.col("name").alias("target"), F.col("id").alias("key")), "target")
    return hit.select("key", "alias").distinct().join(known.select(F.col("name").alias("alias")), "alias", "left_anti").select("key", "alias")


def insert_select(target: DataFrame, source: DataFrame, on: str, columns: dict[str, Column]) -> DataFrame:
    """The target with a row for every match of the source's key in it, made of expressions over both."""
    made = source.join(target.select(on), on, "left_semi").select(*(c.alias(n) for n, c in columns.items()))
    return target.unionByName(made)


def reloaded(path: str, df: DataFrame) -> DataFrame:
    """A table replaced as a whole: what was there goes, and doing it again changes nothing."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def evolved(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of two versions of a schema under the columns of both; what a version lacks is null."""
    return old.unionByName(new, allowMissingColumns=True)


def report(df: DataFrame, keys: list[str], line: Column, order: str, mark: str = "\n") -> DataFrame:
    """One text for each key: its lines in order."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda r: r["l"])
    return df.groupBy(*keys).agg(F.array_join(lines, mark).alias("report"))
