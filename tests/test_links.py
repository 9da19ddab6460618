"""Routes over walks and links against plain Dijkstra; watchdogs by a plain fold."""

import heapq
import random

import pytest

from gleanery.functions import markup
from gleanery.operators import links
from gleanery.streaming import events


def steps(a, b):
    return max(abs(a[0] - b[0]), abs(a[1] - b[1]))


def dijkstra(ports, walks, ways, here, there, kinds):
    near = {}
    add = lambda a, b, w: near.setdefault(a, []).append((b, w))
    for s, d, w in walks:
        add(("p", s), ("p", d), w)
    spots = [(("p", p), blob, (x, y)) for p, blob, x, y in ports] + [("here", here[2], here[:2])]
    for p, blob, x, y in ports:
        if blob == here[2]:
            add("here", ("p", p), steps(here, (x, y)))
        if blob == there[2]:
            add(("p", p), "there", steps((x, y), there))
    for link, kind, src, sx, sy, sb, dx, dy, db in ways:
        if dx is None or (kinds is not None and kind not in kinds):
            continue
        if src == links.ANYWHERE:
            if kind != "teleport":
                continue
            add("here", ("b", link), 0)
        else:
            add(("a", link), ("b", link), 0 if kind in links.FREE else steps((sx, sy), (dx, dy)))
            for node, blob, at in spots:
                if blob == sb:
                    add(node, ("a", link), steps(at, (sx, sy)))
        for p, blob, x, y in ports:
            if blob == db:
                add(("b", link), ("p", p), steps((dx, dy), (x, y)))
        if db == there[2]:
            add(("b", link), "there", steps((dx, dy), there))
    best, heap = {}, [(0, 0, "here")]
    while heap:
        cost, _, node = heapq.heappop(heap)
        if node not in best:
            best[node] = cost
            for k, (to, w) in enumerate(near.get(node, [])):
                heapq.heappush(heap, (cost + w, id(to) + k, to))
    return best.get("there")


@pytest.mark.parametrize("seed,kinds", [(1, None), (2, ["canoe", "shortcut"]), (3, [])])
def test_routes_cost_what_dijkstra_says(spark, seed, kinds):
    rng = random.Random(seed)
    xy = lambda: (rng.randrange(60), rng.randrange(60))
    ports = [(p, rng.randrange(1, 6), *xy()) for p in range(14)]
    walks = [(rng.randrange(14), rng.randrange(14), rng.randrange(1, 30)) for _ in range(10)]
    ways = []
    for link in range(9):
        kind, anywhere = rng.choice(["canoe", "shortcut", "teleport", "walkable"]), rng.random() < 0.2
        a, b = xy(), xy()
        ways.append((link, kind, links.ANYWHERE if anywhere else "P", *((None, None, None) if anywhere else (*a, rng.randrange(1, 6))), *b, rng.randrange(1, 6)))
    here, there = (*xy(), 1), (*xy(), 4)
    made = (
        spark.createDataFrame(ports, "port long, blob long, x long, y long"),
        spark.createDataFrame(walks, "src long, dst long, weight long"),
        spark.createDataFrame(ways, "link long, kind string, src_place string, src_x long, src_y long, src_blob long, dst_x long, dst_y long, dst_blob long"),
    )
    got = links.route(*made, here, there, kinds).orderBy("step").collect()
    want = dijkstra(ports, walks, ways, here, there, kinds)
    assert (got[-1].cost if got else None) == want
    if got:
        assert (got[0].x, got[0].y, got[0].cost) == (*here[:2], 0) and (got[-1].x, got[-1].y) == there[:2]
        assert all(a.cost <= b.cost for a, b in zip(got, got[1:]))


def test_one_blob_is_one_walk_and_none_is_no_way(spark):
    ports = spark.createDataFrame([], "port long, blob long, x long, y long")
    assert [tuple(r) for r in links.route(ports, None, None, (1, 2, 7), (5, 4, 7)).collect()] == [(0, 1, 2, None, 0), (1, 5, 4, None, 4)]
    assert links.route(ports, None, None, (1, 2, 0), (5, 4, 7)).count() == 0


def test_watchdog(spark):
    crashes = [(1, t) for t in (0, 5, 20, 40, 60, 80, 100, 400)] + [(2, t) for t in (0, 200, 400)]
    got = sorted(tuple(r) for r in events.watchdog(spark.createDataFrame(crashes, "actor long, tick long")).collect())
    assert got == [(1, 10, 1), (1, 30, 2), (1, 50, 3), (1, 70, 4), (1, 90, 5)] + [(2, 10, 1), (2, 210, 1), (2, 410, 1)]


def test_tables():
    assert markup.wiki_table('{| class="x"\n! a\n|-\n| 1 || 2\n| 3\n|-\n|}\n| no') == [["1", "2", "3"]]
    assert markup.wiki_table("none") == [] and markup.html_table("") == []
    assert markup.html_table("<table><tr><th>x</th><td> a <i>b</i></td><td></td></tr></table><p>c") == [["a b", ""]]
    assert markup.section_of("{{A|items=x {{b|c}} [[d|e]]|z=1}}", "items") == "x {{b|c}} [[d|e]]" and markup.section_of("{{A}}", "items") is None
