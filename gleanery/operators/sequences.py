"""Ordered rows: islands, entries, renumbering, fills, step functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], order: list[str], same: list[str]) -> DataFrame:
    """Maximal runs of equal values: first and last position, length, and the middle one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = F.lit(False)
    for c in same:
        changed |= ~F.col(c).eqNullSafe(F.lag(c).over(w))
    numbered = df.withColumn("pos", F.row_number().over(w) - 1).withColumn("_new", F.when((F.col("pos") == 0) | changed, 1).otherwise(0))
    numbered = numbered.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = numbered.groupBy(*keys, "island", *same).agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count("*").alias("length"))
    return out.withColumn("middle", F.floor((F.col("first_pos") + F.col("last_pos")) / 2).cast("long"))


def entries(df: DataFrame, key: str, order: str, section: Column, falls_through: Column) -> DataFrame:
    """Rows that control enters from outside: the first, those of a new section, those after a terminator."""
    w = Window.partitionBy(key).orderBy(order)
    out = df.withColumn("_s", section).withColumn("_f", falls_through)
    is_entry = F.lag("_s").over(w).isNull() | ~F.col("_s").eqNullSafe(F.lag("_s").over(w)) | ~F.coalesce(F.lag("_f").over(w), F.lit(False))
    return out.withColumn("is_entry", is_entry).drop("_s", "_f")


def renumber(df: DataFrame, key: str, order: str, dead: Column) -> DataFrame:
    """Dense addresses of live rows, and for every row the address of the next live one, itself included (null: none)."""
    w = Window.partitionBy(key).orderBy(order)
    marked = df.withColumn("_dead", dead).withColumn("new_addr", F.when(~F.col("_dead"), F.sum(F.when(~F.col("_dead"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1))
    ahead = F.first("new_addr", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return marked.withColumn("remap", ahead).drop("_dead")


def previous_and_next(df: DataFrame, key: str, order: str, column: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn(f"previous_{column}", F.lag(column).over(w)).withColumn(f"next_{column}", F.lead(column).over(w))


def parents(df: DataFrame, page: str, order: str, depth: str, deepest: int) -> DataFrame:
    """Parent of each row of a pre-order list: the last row before it one level up, unless a shallower one came between."""
    w = Window.partitionBy(page).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out, parent = df, F.lit(None).cast("long")
    for level in range(1, deepest + 1):
        last = F.max(F.when(F.col(depth) == level - 1, F.col(order))).over(w)
        broken = F.max(F.when(F.col(depth) < level - 1, F.col(order))).over(w)
        parent = F.when(F.col(depth) == level, F.when(F.coalesce(broken, F.lit(-1)) < last, last)).otherwise(parent)
    return out.withColumn("parent", parent)


def step_value(value: Column, thresholds: list) -> Column:
    """How many thresholds a value has reached."""
    return sum((F.when(value >= t, 1).otherwise(0) for t in thresholds), F.lit(0))


def nearest_equal(df: DataFrame, keys: list[str], order: str, prefer: Column) -> DataFrame:
    """For each row the nearest earlier row with equal keys, preferred rows first."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.max(F.when(prefer, F.col(order))).over(w)
    return df.withColumn("reference", F.coalesce(wanted, F.max(order).over(w)))


def round_robin(df: DataFrame, order: str, workers: int) -> DataFrame:
    """Rows dealt to workers in order of a dense integer column, without ranking all rows in one task."""
    return df.withColumn("worker", F.pmod(F.col(order), F.lit(workers)).cast("int"))


def ordered_distinct(df: DataFrame, keys: list[str], column: str, order: str) -> DataFrame:
    return df.groupBy(*keys, column).agg(F.min(order).alias("first_seen"))


def nearest_equal_either_side(df: DataFrame, keys: list[str], order: str, prefer: Column) -> DataFrame:
    """earlier and later: for each row the nearest rows with equal keys on either side, preferred rows first."""
    w = Window.partitionBy(*keys).orderBy(order)
    out = df
    for name, pick, side in (("earlier", F.max, w.rowsBetween(Window.unboundedPreceding, -1)), ("later", F.min, w.rowsBetween(1, Window.unboundedFollowing))):
        out = out.withColumn(name, F.coalesce(pick(F.when(prefer, F.col(order))).over(side), pick(order).over(side)))
    return out


def block_starts(df: DataFrame, keys: list[str], order: str, kind: str) -> DataFrame:
    """start: of each row the first row of the contiguous run of its kind among its siblings."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = F.when(F.lag(kind).over(w).eqNullSafe(F.col(kind)) & F.lag(order).over(w).isNotNull(), None).otherwise(F.col(order))
    return df.withColumn("_new", new).withColumn("start", F.last("_new", ignorenulls=True).over(w)).drop("_new")


def first_occurrences(items: Column) -> Column:
    """The distinct elements of an array, in order of their first occurrence."""
    return F.array_distinct(items)
