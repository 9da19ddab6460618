"""Typed links between places, and routes over walks and links.

A place's ways on are walks between ports of one blob (walkable component) or across a border, and links (portals, transports).
Nodes of the route graph are ports and both ends of links; they're numbered so that the graph is plain (src, dst, weight).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graphs
from .base import checkpointed

#: A link that starts wherever one stands, and the kinds that cost no steps.
ANYWHERE = "ANYWHERE"
FREE = ("entrance", "exit", "fairy_ring", "charter_ship", "spirit_tree", "gnome_glider", "canoe", "teleport", "minecart", "ship", "quetzal", "npc_transport")
#: Node numbers: four times a port's, a link's or nothing's number, and one of these.
PORT, ENTER, LEAVE, END = range(4)
START, GOAL = END, 4 + END


def departing(links: DataFrame, place: str, kind: str | None = None) -> DataFrame:
    return _of_kind(links.where(F.col("src_place") == place), kind)


def arriving(links: DataFrame, place: str, kind: str | None = None) -> DataFrame:
    return _of_kind(links.where(F.col("dst_place") == place), kind)


def between(links: DataFrame, a: str, b: str, kind: str | None = None) -> DataFrame:
    """Links either way."""
    one = (F.col("src_place") == a) & (F.col("dst_place") == b)
    return _of_kind(links.where(one | (F.col("src_place") == b) & (F.col("dst_place") == a)), kind)


def reachable_from(links: DataFrame, place: str) -> DataFrame:
    """dst_place, links: the numbers of the links that lead there, in order."""
    return departing(links, place).groupBy("dst_place").agg(F.array_sort(F.collect_list("link")).alias("links"))


def _of_kind(links: DataFrame, kind: str | None) -> DataFrame:
    return links if kind is None else links.where(F.col("kind") == kind)


def _steps(x: Column, y: Column, tx: Column, ty: Column) -> Column:
    return F.greatest(F.abs(x - tx), F.abs(y - ty)).cast("long")


def _node(number: Column | str, part: int) -> Column:
    return (F.col(number) if isinstance(number, str) else number).cast("long") * 4 + part


def route_graph(ports: DataFrame, walks: DataFrame, links: DataFrame, here: tuple, there: tuple, kinds: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges (src, dst, weight) and nodes (node, x, y, link). ports: port, blob, x, y. walks: src, dst (ports), weight. links: link, kind, src_place,
    src_x, src_y, src_blob, dst_x, dst_y, dst_blob. here, there: x, y, blob. kinds: those allowed; None means all."""
    spark = ports.sparkSession
    usable = links.where("dst_x is not null and dst_y is not null")
    usable = usable if kinds is None else usable.where(F.col("kind").isin(kinds)) if kinds else usable.limit(0)
    anywhere = F.col("src_place") == ANYWHERE
    held, jumps = usable.where(~anywhere & F.col("src_x").isNotNull() & F.col("src_y").isNotNull()), usable.where(anywhere & (F.col("kind") == "teleport"))
    c = F.col
    places = ports.select(_node("port", PORT).alias("node"), "blob", "x", "y").unionByName(
        spark.createDataFrame([(START, here[2], here[0], here[1]), (GOAL, there[2], there[0], there[1])], "node long, blob long, x long, y long")
    )
    enters = held.select(_node("link", ENTER).alias("to"), c("src_blob").alias("blob"), c("src_x").alias("tx"), c("src_y").alias("ty"))
    leaves = held.unionByName(jumps).select(_node("link", LEAVE).alias("from"), c("dst_blob").alias("blob"), c("dst_x").alias("fx"), c("dst_y").alias("fy"))
    walk = _steps(c("x"), c("y"), c("tx"), c("ty"))
    to_link = places.where(c("node") != GOAL).join(enters, "blob").select(c("node").alias("src"), c("to").alias("dst"), walk.alias("weight"))
    from_link = leaves.join(places.where(c("node") != START), "blob").select(c("from").alias("src"), c("node").alias("dst"), _steps(c("fx"), c("fy"), c("x"), c("y")).alias("weight"))
    price = F.when(c("kind").isin(*FREE), F.lit(0)).otherwise(_steps(c("src_x"), c("src_y"), c("dst_x"), c("dst_y"))).cast("long")
    through = held.select(_node("link", ENTER).alias("src"), _node("link", LEAVE).alias("dst"), price.alias("weight"))
    away = jumps.select(F.lit(START).cast("long").alias("src"), _node("link", LEAVE).alias("dst"), F.lit(0).cast("long").alias("weight"))
    own = ports.select(_node("port", PORT).alias("node"), "blob", "x", "y")
    at = lambda p: (F.lit(p[0]), F.lit(p[1]))
    out = own.where(c("blob") == here[2]).select(F.lit(START).cast("long").alias("src"), c("node").alias("dst"), _steps(*at(here), c("x"), c("y")).alias("weight"))
    in_ = own.where(c("blob") == there[2]).select(c("node").alias("src"), F.lit(GOAL).cast("long").alias("dst"), _steps(c("x"), c("y"), *at(there)).alias("weight"))
    walked = walks.select(_node("src", PORT).alias("src"), _node("dst", PORT).alias("dst"), c("weight").cast("long").alias("weight"))
    edges = walked
    for e in (to_link, from_link, through, away, out, in_):
        edges = edges.unionByName(e)
    nodes = places.select("node", "x", "y", F.lit(None).cast("long").alias("link"))
    nodes = nodes.unionByName(held.select(_node("link", ENTER).alias("node"), c("src_x").alias("x"), c("src_y").alias("y"), F.lit(None).cast("long").alias("link")))
    nodes = nodes.unionByName(held.unionByName(jumps).select(_node("link", LEAVE).alias("node"), c("dst_x").alias("x"), c("dst_y").alias("y"), c("link").cast("long").alias("link")))
    return edges, nodes


def route(ports: DataFrame, walks: DataFrame, links: DataFrame, here: tuple, there: tuple, kinds: list[str] | None = None) -> DataFrame:
    """The cheapest way: step, x, y, link (null: walked), cost so far, of every place on it. Walks of no length are left out; no rows if there's no
    way; one walk if both ends are in one blob (0: none)."""
    spark = ports.sparkSession
    schema = "step long, x long, y long, link long, cost long"
    if not here[2] or not there[2]:
        return spark.createDataFrame([], schema)
    if here[2] == there[2]:
        cost = max(abs(here[0] - there[0]), abs(here[1] - there[1]))
        return spark.createDataFrame([(0, here[0], here[1], None, 0), (1, there[0], there[1], None, cost)], schema)
    edges, nodes = route_graph(ports, walks, links, here, there, kinds)
    best = graphs.shortest_paths(edges, spark.range(START, START + 1))
    way = checkpointed(graphs.path_steps(best, GOAL).join(nodes, "node"))
    same = way.select((F.col("step") + 1).alias("step"), F.col("x").alias("px"), F.col("y").alias("py"))
    kept = way.join(same, "step", "left").where("px is null or link is not null or px <> x or py <> y")
    return kept.select("step", "x", "y", "link", "cost")


def bipartite(ports: DataFrame, ends: DataFrame) -> DataFrame:
    """port, end, weight: ports and link ends (end, blob, x, y) of one blob, by the steps between them."""
    met = ports.join(ends.select("end", "blob", F.col("x").alias("tx"), F.col("y").alias("ty")), "blob")
    return met.select("port", "end", _steps(F.col("x"), F.col("y"), F.col("tx"), F.col("ty")).alias("weight"))
