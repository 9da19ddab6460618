"""Junction, semi, fallback, priority, nearest and distance-band joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import checkpointed, first_per


def junction(left: DataFrame, bridge: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Many-to-many through a two-column bridge."""
    return left.join(bridge, left_key).join(right, right_key)


def exists_in(left: DataFrame, right: DataFrame, on: list[str] | str) -> DataFrame:
    """Rows of the left with any match, once each."""
    return left.join(right, on, "left_semi")


def distinct_by_hidden(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """Distinct rows with the least of a column they don't show, to order by."""
    return df.groupBy(*columns).agg(F.min(order).alias(f"least_{order}"))


def first_found(left: DataFrame, steps: list[tuple[Column, DataFrame]], out: str) -> DataFrame:
    """Resolve a value by the first step that finds one. steps: an expression over the left, and a lookup of two
    columns (name, id); of several ids for a name the least counts."""
    found = []
    for k, (value, lookup) in enumerate(steps):
        name, target = lookup.columns
        one = lookup.groupBy(F.col(name).alias(f"_n{k}")).agg(F.min(target).alias(f"_v{k}"))
        left = left.withColumn(f"_k{k}", value).join(one, F.col(f"_k{k}") == F.col(f"_n{k}"), "left").drop(f"_k{k}", f"_n{k}")
        found.append(F.col(f"_v{k}"))
    return left.withColumn(out, F.coalesce(*found)).drop(*(f"_v{k}" for k in range(len(steps))))


def merged_lookup(tables: list[tuple[str, DataFrame]], last_wins: bool) -> DataFrame:
    """name, type, id: one row per lower-cased name over several (id, name) tables in order of priority. The last table
    that has the name wins, or the first; within a table the least id."""
    rows = None
    for place, (kind, t) in enumerate(tables):
        own = t.toDF("id", "name").select(F.lower("name").alias("name"), F.lit(kind).alias("type"), F.col("id").cast("long").alias("id"), F.lit(place).alias("place"))
        rows = own if rows is None else rows.unionByName(own)
    by = F.col("place") if not last_wins else -F.col("place")
    return rows.groupBy("name").agg(F.min_by(F.struct("type", "id"), F.struct(by, "id")).alias("hit")).select("name", "hit.type", "hit.id")


def complete_graph(df: DataFrame, key: str, most: int = 10_000) -> DataFrame:
    """Every ordered pair of different members, such as the stops of a transport network: as many rows as that takes. One side is
    broadcast up to `most` members."""
    other = df.select(F.col(key).alias("dst"))
    small = other.limit(most + 1).count() <= most
    return df.select(F.col(key).alias("src")).crossJoin(F.broadcast(other) if small else other).where("src != dst")


def prefix_fuzzy(left: DataFrame, right: DataFrame, keys: list[str], text: str, length: int = 30) -> DataFrame:
    """First right row (least id) with equal keys whose prefix holds the left's, or is held by it, without case."""
    a = left.withColumn("_a", F.lower(F.substring(text, 1, length)))
    b = right.select(*keys, F.col("id").alias("match_id"), F.lower(F.substring(text, 1, length)).alias("_b"))
    hit = a.join(b, keys).where(F.contains("_a", "_b") | F.contains("_b", "_a"))
    return hit.groupBy(*[c for c in left.columns]).agg(F.min("match_id").alias("match_id"))


def match_split(df: DataFrame, known: DataFrame, on: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a match, carrying its key, and rows without one."""
    both = df.join(known.select(on, key), on, "left")
    return both.where(F.col(key).isNotNull()), both.where(F.col(key).isNull()).drop(key)


def follow_redirects(pages: DataFrame, name: str, target: str) -> DataFrame:
    """Each page with what it, or the page that it redirects to, holds."""
    there = pages.select(F.col(name).alias("_t"), F.col("content").alias("_c"))
    return pages.join(there, F.col(target) == F.col("_t"), "left").withColumn("content", F.coalesce("_c", "content")).drop("_t", "_c")


def _chebyshev() -> Column:
    return F.greatest(F.abs(F.col("x") - F.col("rx")), F.abs(F.col("y") - F.col("ry")))


METRICS = {
    "chebyshev": _chebyshev,
    "manhattan": lambda: F.abs(F.col("x") - F.col("rx")) + F.abs(F.col("y") - F.col("ry")),
    "euclidean": lambda: F.sqrt((F.col("x") - F.col("rx")) ** 2 + (F.col("y") - F.col("ry")) ** 2),
}


def nearest(left: DataFrame, right: DataFrame, small: int = 256, cell: int | None = None) -> DataFrame:
    """Each left row (x, y) with the right row (rid, rx, ry) at the least Chebyshev distance, the least rid among equals.

    Left rows in one place are answered once; of right rows in one place only the least rid can be nearest. Right places, if
    they are at most `small`, are broadcast and tried whole. More are searched by rings of grid cells, by default of a size that
    spreads their middle nine tenths to about four a cell: a round of ring r settles the places whose best distance is at most r cells, as nothing
    outside the ring can be nearer; the others go on with twice the ring, and are tried on all right places once a ring has
    as many cells. The cells asked for are never broadcast: an estimate of their size leaves out the explosion. A left row
    without a place gets the least rid and no distance; right rows without one take no part.
    """
    rows = left.distinct()
    best = F.min(F.struct(_chebyshev().cast("long").alias("distance"), "rid")).alias("hit")
    right = checkpointed(right.where("rx is not null and ry is not null").groupBy("rx", "ry").agg(F.min("rid").alias("rid")))
    asked = checkpointed(rows.select("x", "y").distinct())
    middle = lambda c: F.percentile_approx(c, F.array(F.lit(0.05), F.lit(0.95)))
    count, xs, ys = right.agg(F.count("*"), middle("rx"), middle("ry")).first()
    if count <= small:
        return _answered(rows, asked.crossJoin(F.broadcast(right)).groupBy("x", "y").agg(best))
    if cell is None:
        w, h = xs[1] - xs[0] + 1, ys[1] - ys[0] + 1
        cell = max(1, math.ceil(math.sqrt(4 * w * h / count)), math.ceil(4 * max(w, h) / count))
    at = lambda c: F.floor(F.col(c) / cell).cast("long")
    grid = right.withColumn("cx", at("rx")).withColumn("cy", at("ry"))
    nowhere = asked.where("x is null or y is null")
    done = None if nowhere.isEmpty() else nowhere.crossJoin(right).groupBy("x", "y").agg(best)
    open_, r = asked.where("x is not null and y is not null"), 1
    while (2 * r + 1) ** 2 < count:
        around = F.sequence(F.lit(-r), F.lit(r))
        cells = open_.withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around))
        cells = cells.select("x", "y", (at("x") + F.col("dx")).alias("cx"), (at("y") + F.col("dy")).alias("cy"))
        met = cells.hint("merge").join(grid, ["cx", "cy"]).groupBy("x", "y").agg(best)
        settled = checkpointed(met.where(F.col("hit.distance") <= r * cell))
        done = settled if done is None else done.unionByName(settled)
        open_ = checkpointed(open_.join(settled, ["x", "y"], "left_anti"))
        if open_.isEmpty():
            return _answered(rows, done)
        r *= 2
    rest = open_.crossJoin(right).groupBy("x", "y").agg(best)
    return _answered(rows, rest if done is None else done.unionByName(rest))


def _answered(rows: DataFrame, places: DataFrame) -> DataFrame:
    """The rows with what was found for their places."""
    hits = places.select(F.col("x").alias("_x"), F.col("y").alias("_y"), "hit.rid", "hit.distance")
    return rows.join(hits, F.col("x").eqNullSafe(F.col("_x")) & F.col("y").eqNullSafe(F.col("_y"))).select(*rows.columns, "rid", "distance")


def within(left: DataFrame, right: DataFrame, limit: int, metric: str = "chebyshev") -> DataFrame:
    """Pairs within a distance: an equi-join on grid cells of that size and their neighbours, then the exact test."""
    size = max(1, limit)
    at = lambda c: F.floor(F.col(c) / size).cast("long")
    step = F.array(F.lit(-1), F.lit(0), F.lit(1))
    asked = left.withColumn("_dx", F.explode(step)).withColumn("_dy", F.explode(step))
    asked = asked.withColumn("_cx", at("x") + F.col("_dx")).withColumn("_cy", at("y") + F.col("_dy")).drop("_dx", "_dy")
    grid = right.withColumn("_cx", at("rx")).withColumn("_cy", at("ry"))
    return asked.join(grid, ["_cx", "_cy"]).withColumn("distance", METRICS[metric]()).where(F.col("distance") <= limit).drop("_cx", "_cy")


def neighbours_by_name(locations: DataFrame, edges: DataFrame) -> DataFrame:
    """Each location with a map from direction to its neighbour's id; names that resolve to nothing give null."""
    known = locations.select(F.col("name").alias("neighbor"), F.col("id").alias("to"))
    met = edges.join(known, "neighbor", "left")
    return met.groupBy("location_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("direction", "to")))).alias("neighbours"))


def ordered_candidates(df: DataFrame, names: str, known: DataFrame, on: str, key: str) -> DataFrame:
    """Each row with the key of the first of its candidate names that is known."""
    columns = [c for c in df.columns if c != names]
    met = df.select(*columns, F.posexplode(names).alias("pos", on)).join(known, on)
    return first_per(met, columns, "pos", key).select(*columns, key)


def paired_sides(df: DataFrame, keys: list[str], side: str) -> DataFrame:
    """Self-join on equal keys with different sides."""
    other = df.select(*keys, F.col(side).alias(f"other_{side}"))
    return df.join(other, keys).where(F.col(side) != F.col(f"other_{side}"))


def dictionary(df: DataFrame, name: str, known: DataFrame, most: int = 100_000) -> DataFrame:
    """Rows whose name the dictionary (name, id) has, with its id; broadcast up to a checked size."""
    words = known.toDF(name, "found")
    small = words.limit(most + 1).count() <= most
    return df.join(F.broadcast(words) if small else words, name)


def or_nearest(df: DataFrame, name: str, known: DataFrame) -> DataFrame:
    """Each row (x, y) with rid: the place of its name, else of the part before the first comma, else the nearest one. known: rid, name, rx, ry."""
    part = F.trim(F.substring_index(F.col(name), ",", 1))
    lookup = known.select("name", "rid")
    stepped = first_found(df, [(F.col(name), lookup), (part, lookup)], "hit")
    rest = nearest(stepped.where("hit is null").drop("hit"), known.select("rid", "rx", "ry"))
    return stepped.where("hit is not null").withColumnRenamed("hit", "rid").unionByName(rest.select(*df.columns, "rid"))


def expanded_lookup(df: DataFrame, name: str, known: DataFrame, categories: DataFrame) -> DataFrame:
    """Each row with id: that of its name, else of the name without case, else those of all members of the category of that name. known: name, id.
    categories: category, id."""
    lower = known.groupBy(F.lower("name").alias("name")).agg(F.min("id").alias("id"))
    stepped = first_found(df, [(F.col(name), known), (F.lower(name), lower)], "hit")
    rest = stepped.where("hit is null").drop("hit").join(categories.withColumnRenamed("category", name), name)
    return stepped.where("hit is not null").withColumnRenamed("hit", "id").unionByName(rest.select(*df.columns, "id"))


def either_target(df: DataFrame, name: str, physical: DataFrame, virtual: DataFrame, default: str) -> DataFrame:
    """Each row with kind and id of its target (the default's, where it names none): a physical one, else a virtual one."""
    df = df.withColumn(name, F.coalesce(name, F.lit(default)))
    both = df.join(physical.toDF(name, "_p"), name, "left").join(virtual.toDF(name, "_v"), name, "left")
    kind = F.when(F.col("_p").isNotNull(), "physical").when(F.col("_v").isNotNull(), "virtual")
    return both.withColumn("kind", kind).withColumn("id", F.coalesce("_p", "_v")).drop("_p", "_v")


def within_record(df: DataFrame, key: str, *lists: str) -> DataFrame:
    """Every combination of one element of each list of a row."""
    for c in lists:
        df = df.withColumn(c, F.explode(c))
    return df.select(key, *lists)


def detail_labels(df: DataFrame, details: DataFrame, on: str, labels: DataFrame, label: str) -> DataFrame:
    """Children of the rows, each with the label of what it points to."""
    return df.join(details, on).join(labels, label)
