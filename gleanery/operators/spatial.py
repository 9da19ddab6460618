"""Tiles, walls, walkable components and what borders them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import checkpointed
from .graphs import components

#: Bits of a tile's flags.
W, N, E, S, FULL, PRESENT, NW, NE, SE, SW = 0x1, 0x2, 0x4, 0x8, 0x10, 0x20, 0x100, 0x200, 0x400, 0x800
#: Steps: dx, dy (north is +1), the wall bit of each cardinal part, the corner bits at the source and the destination.
STEPS = [(-1, 0, W, 0, 0, 0), (1, 0, E, 0, 0, 0), (0, 1, 0, N, 0, 0), (0, -1, 0, S, 0, 0), (-1, 1, W, N, NW, SE), (1, 1, E, N, NE, SW), (1, -1, E, S, SE, NW), (-1, -1, W, S, SW, NE)]


def decode_flags(red_green_blue: Column, water: Column) -> Column:
    """Flags of a pixel: green above blue; what has no data, or is water, is blocked."""
    green, blue = F.shiftright(red_green_blue, 8).bitwiseAND(F.lit(255)), red_green_blue.bitwiseAND(F.lit(255))
    flags = F.shiftleft(green, 8).bitwiseOR(blue)
    blocked = (flags.bitwiseAND(F.lit(PRESENT)) == 0) | water
    return F.when(blocked, flags.bitwiseOR(F.lit(FULL))).otherwise(flags)


def moves(tiles: DataFrame, corners: bool = True) -> DataFrame:
    """src and dst (x, y) of every allowed step between tiles (x, y, flags); corners: diagonal wall pieces count too.

    Each tile looks at its target and, for a diagonal step, at the two tiles beside it: three equi-joins on coordinates.
    """
    has = lambda flags, bits: flags.bitwiseAND(bits) != 0
    steps = F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("dx", "dy", "h", "v", "cs", "cd"), s))) for s in STEPS)))
    asked = tiles.select("x", "y", "flags", steps.alias("s")).select("x", "y", "flags", "s.*")
    asked = asked.where(~has(F.col("flags"), F.col("h").bitwiseOR(F.col("v"))))
    at = lambda name: tiles.select(F.col("x").alias(f"{name}x"), F.col("y").alias(f"{name}y"), F.col("flags").alias(name))
    to = asked.withColumn("tx", F.col("x") + F.col("dx")).withColumn("ty", F.col("y") + F.col("dy"))
    to = to.join(at("t"), ["tx", "ty"]).where(~has(F.col("t"), F.lit(FULL)))
    if corners:
        to = to.where(~has(F.col("flags"), F.col("cs")) & ~has(F.col("t"), F.col("cd")))
    out = lambda d: d.select("x", "y", "tx", "ty")
    diagonal = to.where("dx != 0 and dy != 0")
    diagonal = diagonal.join(at("a").withColumnsRenamed({"ax": "tx", "ay": "y"}), ["tx", "y"]).where(~has(F.col("a"), F.col("v").bitwiseOR(F.lit(FULL))))
    diagonal = diagonal.join(at("b").withColumnsRenamed({"bx": "x", "by": "ty"}), ["x", "ty"]).where(~has(F.col("b"), F.col("h").bitwiseOR(F.lit(FULL))))
    return out(to.where("dx = 0 or dy = 0")).unionByName(out(diagonal))


def _number(x: str, y: str) -> Column:
    return (F.col(x).cast("long") * (1 << 20)) + F.col(y)


def walkable_components(tiles: DataFrame, corners: bool = False) -> DataFrame:
    """x, y, component of every tile that isn't blocked; steps join their ends whichever way they go."""
    free = tiles.where(F.col("flags").bitwiseAND(F.lit(FULL)) == 0).select("x", "y", _number("x", "y").alias("node"))
    edges = moves(tiles, corners).select(_number("x", "y").alias("src"), _number("tx", "ty").alias("dst"))
    found = components(edges.join(free.select(F.col("node").alias("src")), "src", "left_semi"))
    return free.join(found, "node", "left").select("x", "y", F.coalesce("component", "node").alias("component"))


def component_borders(cells: DataFrame) -> DataFrame:
    """Unordered pairs of components that touch across an edge."""
    side = F.explode(F.array(F.struct(F.lit(1).alias("dx"), F.lit(0).alias("dy")), F.struct(F.lit(0).alias("dx"), F.lit(1).alias("dy"))))
    asked = cells.select("component", (F.col("x")).alias("x"), "y", side.alias("s")).select("component", (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"))
    met = asked.join(cells.select("x", "y", F.col("component").alias("other")), ["x", "y"]).where("component != other")
    return met.select(F.least("component", "other").alias("a"), F.greatest("component", "other").alias("b")).distinct()


def colours(borders: pd.DataFrame) -> dict[int, int]:
    """Greedy colouring, most neighbours first; for drawing one map."""
    near: dict[int, set[int]] = {}
    for a, b in zip(borders["a"], borders["b"]):
        near.setdefault(int(a), set()).add(int(b))
        near.setdefault(int(b), set()).add(int(a))
    out: dict[int, int] = {}
    for node in sorted(near, key=lambda n: (-len(near[n]), n)):
        taken = {out[n] for n in near[node] if n in out}
        out[node] = next(c for c in range(len(near) + 1) if c not in taken)
    return out


def nearest_free(points: DataFrame, cells: DataFrame, reach: int = 8) -> DataFrame:
    """Each point (id, x, y) with the component of the first free tile by (ring, dy, dx), within a reach. Points in one place
    are answered once. The places' surroundings are never broadcast: an estimate of their size leaves out the explosion."""
    wide = 2 * reach + 1
    span = F.sequence(F.lit(-reach), F.lit(reach))
    asked = points.select("x", "y").distinct().withColumn("dx", F.explode(span)).withColumn("dy", F.explode(span))
    order = (F.greatest(F.abs("dx"), F.abs("dy")).cast("long") * wide + F.col("dy") + reach) * wide + F.col("dx") + reach
    asked = asked.select(F.col("x").alias("px"), F.col("y").alias("py"), order.alias("order"), (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"))
    met = asked.hint("merge").join(cells, ["x", "y"]).groupBy("px", "py").agg(F.min("order").alias("order"), F.min_by("component", "order").alias("component"))
    return points.join(met.withColumnsRenamed({"px": "x", "py": "y"}), ["x", "y"]).groupBy("id").agg(F.min_by("component", "order").alias("component"))


def gates(walls: DataFrame, cells: DataFrame) -> DataFrame:
    """Links through wall objects (id, x, y, orientation 0 west, 1 north, 2 east, 3 south) that part two components, both ways."""
    off = F.create_map(*(F.lit(v) for v in (0, -1, 1, 0, 2, 1, 3, 0))), F.create_map(*(F.lit(v) for v in (0, 0, 1, 1, 2, 0, 3, -1)))
    there = walls.withColumn("tx", F.col("x") + F.try_element_at(off[0], "orientation")).withColumn("ty", F.col("y") + F.try_element_at(off[1], "orientation"))
    here = there.join(cells.withColumnRenamed("component", "from"), ["x", "y"])
    both = here.join(cells.toDF("tx", "ty", "to"), ["tx", "ty"]).where("`from` != `to`")
    return both.select("id", F.col("from").alias("src"), F.col("to").alias("dst")).unionByName(both.select("id", F.col("to").alias("src"), F.col("from").alias("dst")))


def ports(cells: DataFrame, owned: DataFrame) -> DataFrame:
    """Crossings between the areas of two owners: maximal straight runs of neighbouring free tiles of one component on either
    side, with their middle tile. cells: x, y, component; owned: x, y, owner."""
    here = cells.join(owned, ["x", "y"])
    out = None
    for dx, dy, along, across in ((1, 0, "y", "x"), (0, 1, "x", "y")):
        there = here.select((F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), F.col("component").alias("to"), F.col("owner").alias("other"))
        met = here.join(there, ["x", "y"]).where("owner != other")
        line = [F.least("owner", "other").alias("a"), F.greatest("owner", "other").alias("b")]
        met = met.select(*line, "component", "to", "owner", F.col(across).alias("across"), F.col(along).alias("along"))
        keys = ["a", "b", "owner", "component", "to", "across"]
        w = Window.partitionBy(*keys).orderBy("along")
        runs = met.withColumn("run", F.col("along") - F.row_number().over(w)).groupBy(*keys, "run").agg(F.min("along").alias("first"), F.max("along").alias("last"))
        middle = F.floor((F.col("first") + F.col("last")) / 2).cast("int")
        at = (F.col("across"), middle) if dx else (middle, F.col("across"))
        found = runs.select("a", "b", "owner", "component", "to", at[0].alias("x"), at[1].alias("y"), (F.col("last") - F.col("first") + 1).alias("width"))
        out = found if out is None else out.unionByName(found)
    return out


def tile_runs(cells: DataFrame, size: int = 64) -> DataFrame:
    """Tiles of a region as one array row, empty regions left out."""
    region = [F.floor(F.col("x") / size).cast("long").alias("rx"), F.floor(F.col("y") / size).cast("long").alias("ry")]
    place = (F.pmod("y", F.lit(size)) * size + F.pmod("x", F.lit(size))).cast("int")
    return cells.groupBy(*region).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(place.alias("place"), F.col("component"))))).alias("cells"))


def owners(tiles: DataFrame, points: DataFrame, small: int = 1000, cell: int = 64) -> DataFrame:
    """Nearest point by Euclidean distance for every tile; ties to the smaller id. Of points in one place only the smallest id
    can own a tile. Up to `small` places are broadcast; more are searched by rings of grid cells, as in joins.nearest."""
    points = points.toDF("owner", "px", "py").groupBy("px", "py").agg(F.min("owner").alias("owner"))
    square = (F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2
    best = F.min(F.struct(square.alias("square"), "owner")).alias("hit")
    if points.limit(small + 1).count() <= small:
        return tiles.crossJoin(F.broadcast(points)).groupBy("x", "y").agg(best).select("x", "y", "hit.owner")
    at = lambda c: F.floor(F.col(c) / cell).cast("long")
    points = checkpointed(points)
    grid = points.withColumn("cx", at("px")).withColumn("cy", at("py"))
    span = points.agg(F.min("px"), F.max("px"), F.min("py"), F.max("py")).crossJoin(tiles.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"))).first()
    if span[4] is None:
        return tiles.select("x", "y", F.lit(None).cast(points.schema["owner"].dataType).alias("owner"))
    widest = int(max(max(span[1], span[5]) - min(span[0], span[4]), max(span[3], span[7]) - min(span[2], span[6])) // cell + 2)
    open_, done, ring = checkpointed(tiles.select("x", "y").distinct()), None, 1
    while True:
        r = min(ring, widest)
        around = F.sequence(F.lit(-r), F.lit(r))
        asked = open_.withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around))
        asked = asked.withColumn("cx", at("x") + F.col("dx")).withColumn("cy", at("y") + F.col("dy"))
        met = asked.join(grid, ["cx", "cy"]).groupBy("x", "y").agg(best)
        settled = checkpointed(met.where((F.col("hit.square") <= (r * cell) ** 2) | F.lit(r >= widest)).select("x", "y", "hit.owner"))
        done = settled if done is None else done.unionByName(settled)
        open_ = checkpointed(open_.join(settled, ["x", "y"], "left_anti"))
        if r >= widest or open_.isEmpty():
            return done
        ring *= 2


def cell_at(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Points (x, y) with the component of their tile; 0 where there's none."""
    return points.join(cells, ["x", "y"], "left").withColumn("component", F.coalesce("component", F.lit(0)))


def crossings(pairs: DataFrame, steps: DataFrame, limit: int = 20) -> DataFrame:
    """The pairs (a, b, of tile numbers) whose tiles lie within a number of steps (src, dst) of one another, with that number."""
    from .graphs import distances

    far = distances(steps, pairs.select(F.col("a").alias("node")).distinct(), limit)
    return pairs.join(far.select(F.col("source").alias("a"), F.col("node").alias("b"), "hops"), ["a", "b"])


def closest_reachable(tiles: DataFrame, start: tuple[int, int], goal: tuple[int, int], corners: bool = True) -> DataFrame:
    """x, y, hops of the tile that a walk from start ends on: the goal, or, if it can't be reached, of the tiles that can the one nearest to it
    (most straight steps, then fewest hops, then y, x). All steps cost the same, so it's a spread over the moves."""
    from .graphs import reachable

    number = lambda x, y: _number(x, y)
    steps = moves(tiles, corners).select(number("x", "y").alias("src"), number("tx", "ty").alias("dst"))
    first = tiles.where((F.col("x") == start[0]) & (F.col("y") == start[1])).select(number("x", "y").alias("node"))
    met = reachable(steps, first).select(F.shiftright("node", 20).alias("x"), F.col("node").bitwiseAND(F.lit((1 << 20) - 1)).alias("y"), "hops")
    away = F.greatest(F.abs(F.col("x") - goal[0]), F.abs(F.col("y") - goal[1]))
    best = met.agg(F.min(F.struct(away.alias("away"), "hops", "y", "x")).alias("b"))
    return best.where("b is not null").select("b.x", "b.y", "b.hops")


#: Bits that a wall sets, by type (0 straight, 1 and 3 corner, 2 both sides) and orientation (west, north, east, south first).
SIDES, CORNERS = (W, N, E, S), (NW, NE, SE, SW)
TOWARDS = {W: (-1, 0, E), N: (0, 1, S), E: (1, 0, W), S: (0, -1, N), NW: (-1, 1, SE), NE: (1, 1, SW), SE: (1, -1, NW), SW: (-1, -1, NE)}


def stamps() -> list[tuple[int, int, int, int, int]]:
    """type, orientation, dx, dy, bits: what a wall sets on its own tile and on those beyond its sides."""
    out = []
    for kind in range(4):
        for k in range(4):
            own = {0: [SIDES[k]], 2: [SIDES[k], SIDES[(k + 1) % 4]]}.get(kind, [CORNERS[k]])
            out += [(kind, k, 0, 0, b) for b in own] + [(kind, k, *TOWARDS[b]) for b in own]
    return out


def stamped(walls: DataFrame) -> DataFrame:
    """x, y, flags of all tiles that walls (x, y, type, orientation) touch."""
    marks = F.broadcast(walls.sparkSession.createDataFrame(stamps(), "type int, orientation int, dx int, dy int, bits int"))
    put = walls.join(marks, ["type", "orientation"])
    return put.groupBy((F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y")).agg(F.bit_or("bits").alias("flags"))
