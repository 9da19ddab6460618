"""Exact, ordered, fuzzy and masked lookups, all as filters and projections that reach the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import all_of, first_per


def by_key(df: DataFrame, **key) -> DataFrame:
    """Rows that equal every given value; None matches null."""
    return df.where(all_of([F.col(c).eqNullSafe(F.lit(v)) for c, v in key.items()]))


def first_version(df: DataFrame, name: str, version: str) -> DataFrame:
    """One row per name: the lowest version, nulls first."""
    return first_per(df, [name], F.asc_nulls_first(version))


def optional_filters(df: DataFrame, **given) -> DataFrame:
    """Each argument that isn't None adds one equality."""
    return df.where(all_of([F.col(c) == F.lit(v) for c, v in given.items() if v is not None]))


def one_of(df: DataFrame, column: str, values: list | DataFrame) -> DataFrame:
    """Membership: of a literal list (an empty one keeps nothing) or of a one-column table (semi-join)."""
    if isinstance(values, DataFrame):
        return df.join(values.toDF(column), column, "left_semi")
    return df.where(F.col(column).isin(values)) if values else df.limit(0)


def search(df: DataFrame, column: str, text: str, wildcards: bool = True) -> DataFrame:
    """Substring search without regard to ASCII case; `%` and `_` in the text are live unless escaped."""
    pattern = text if wildcards else text.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_")
    lower = F.translate(F.col(column), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    folded = "".join(c.lower() if c.isascii() else c for c in pattern)
    return df.where(lower.like(f"%{folded}%"))


def at_most(df: DataFrame, column: str, limit) -> DataFrame:
    return df.where(F.col(column) <= F.lit(limit))


def mask_any(column: Column, mask: int) -> Column:
    return column.bitwiseAND(F.lit(mask)) != 0


def mask_all(column: Column, masks: list[int]) -> Column:
    whole = 0
    for m in masks:
        whole |= m
    return column.bitwiseAND(F.lit(whole)) == whole


def mask_members(column: Column, members: dict[str, int]) -> Column:
    """Names of the members that a mask holds, in the given order."""
    pairs = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(m).alias("mask")) for n, m in members.items()))
    return F.transform(F.filter(pairs, lambda p: column.bitwiseAND(p["mask"]) != 0), lambda p: p["name"])


def box_near(df: DataFrame, x: int, y: int, radius: int = 50) -> DataFrame:
    """Rows within a square, with their city-block distance to order by."""
    dx, dy = F.abs(F.col("x") - x), F.abs(F.col("y") - y)
    return df.where((dx <= radius) & (dy <= radius)).withColumn("distance", dx + dy)


def symmetric_pair(df: DataFrame, left: str, right: str, a, b) -> DataFrame:
    return df.where(((F.col(left) == a) & (F.col(right) == b)) | ((F.col(left) == b) & (F.col(right) == a)))


def tag_exact(tags: Column, category: str, name: str) -> Column:
    return F.array_contains(tags, f"{category}:{name}")


def tag_category(tags: Column, category: str) -> Column:
    return F.exists(tags, lambda t: F.startswith(t, F.lit(f"{category}:")))


def roots(df: DataFrame, key: str, children: DataFrame, child: str) -> DataFrame:
    """Rows that are nobody's child."""
    return df.join(children.select(F.col(child).alias(key)), key, "left_anti")


def option_list(column: Column) -> Column:
    """Comma list to trimmed array."""
    return F.filter(F.transform(F.split(column, ","), lambda s: F.trim(s)), lambda s: s != "")


def has_option(column: Column, option: str) -> Column:
    return F.array_contains(F.transform(option_list(column), lambda s: F.lower(s)), option.lower())


def tile_key(x: Column, y: Column, size: int = 64) -> tuple[Column, Column]:
    """Region of a coordinate; negative ones round down."""
    return F.floor(x / size).cast("long"), F.floor(y / size).cast("long")


def sender_matches(column: Column, pattern: str, limit: int = 200) -> Column:
    """Full match of a pattern; patterns that are too long or don't compile are taken literally."""
    import re

    try:
        if len(pattern) > limit:
            raise re.error("too long")
        re.compile(pattern)
        return column.rlike(f"^(?:{pattern})$")
    except re.error:
        return column == F.lit(pattern)


def decode(column: Column, labels: dict) -> Column:
    """Enum value to label; unknown and null stay null."""
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), column)


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row per broken constraint: the check's name and how many rows break it. A null verdict breaks nothing."""
    counts = df.agg(*(F.count_if(~c).alias(n) for n, c in checks.items()))
    cells = F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).alias("broken")) for n in checks)))
    return counts.select(cells.alias("c")).select("c.check", "c.broken")


def by_either(df: DataFrame, primary: str, alternate: str, value) -> DataFrame:
    """Rows whose primary key is the value, or, if there is none, whose alternate key is."""
    hit = df.where((F.col(primary) == F.lit(value)) | (F.col(alternate) == F.lit(value))).withColumn("_first", F.col(primary).eqNullSafe(F.lit(value)))
    best = hit.agg(F.max("_first").alias("_best"))
    return hit.crossJoin(F.broadcast(best)).where("_first = _best").drop("_first", "_best")


def region_window(df: DataFrame, x0: int, x1: int, y0: int, y1: int, size: int = 64) -> DataFrame:
    """Rows whose region lies in a window of regions, bounds included."""
    rx, ry = tile_key(F.col("x"), F.col("y"), size)
    return df.where(rx.between(x0, x1) & ry.between(y0, y1))


def same_name(column: Column, text: str) -> Column:
    """Equality without regard to case."""
    return F.lower(column) == F.lit(text.lower())


def placed(df: DataFrame, *columns: str) -> DataFrame:
    """Rows that have all of these."""
    return df.where(all_of([F.col(c).isNotNull() for c in columns]))


def root_rows(df: DataFrame, parent: str = "parent_id") -> DataFrame:
    return df.where(F.col(parent).isNull())


def named_like(name: Column, options: Column, include: list[str], exclude: list[str], known: list[str]) -> Column:
    """Whether a name holds one of some words and none of others, and its options have a known one."""
    low = F.lower(name)
    holds = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    return holds(include) & ~holds(exclude) & F.arrays_overlap(options, F.array(*map(F.lit, known)))


def widest(df: DataFrame, limit: int, order: str, **given) -> DataFrame:
    """The first rows by order that fit all criteria: an equality each, or, for `text`, a part of it without case."""
    text = given.pop("text", None)
    out = optional_filters(df, **given)
    return (out if text is None else search(out, "text", text, wildcards=False)).orderBy(order).limit(limit)
