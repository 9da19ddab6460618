"""Queries against their SQL on made tables that hold what the supplied ones don't."""

import random

import duckdb

from gleanery.functions import conditions
from gleanery.operators import graphs, joins, spatial
from gleanery.plans import catalogue


def agrees(spark, folder, name, **tables):
    """Runs a query and its SQL over tables (rows and a schema each); the rows, sorted, once they are equal."""
    con = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    df = catalogue.queries()[name](spark, str(folder))
    cursor = con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    got, want = (sorted(map(tuple, rows), key=repr) for rows in (df.select(*names).collect(), cursor.fetchall()))
    assert got == want
    return got


def broadcasts(df, node):
    """Whether the plan, before it runs, broadcasts what a node of this kind makes."""
    lines = [(len(x) - len(x.lstrip(" :+-*")), x) for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if x.strip()]
    for k, (depth, line) in enumerate(lines):
        if "BroadcastExchange" in line:
            below = [x for d, x in lines[k + 1 : next((i for i in range(k + 1, len(lines)) if lines[i][0] <= depth), len(lines))]]
            if any(node in x for x in below):
                return True
    return False


def test_conditions_agree_with_the_player(spark, tmp_path):
    parts = [(k, "red ring" if k % 2 else "blue bolt", k) for k in range(8)] + [(8, "green orb", 4)]
    got = agrees(spark, tmp_path, "condition_slots", part=(parts, "p_partkey long, p_name string, p_size int"))
    assert len(got) == 8 and (4, "the player does not have {item}") in got
    said = {"You haven't a key": "the player has not a key", "They don't know": "they do not know", "Don't go": "do not go", "If you  aren't in": "if the player is not in"}
    assert {t: conditions.normalise(t, {}, agree=True) for t in said} == said
    assert conditions.normalise("you don't have", {}) == "the player do not have"


def test_conditions_without_text_or_key(spark, tmp_path):
    parts = [(2**60 + 1, "red ring", 2), (None, "red ring", 1), (3, "blue bolt", None), (4, None, 4)]
    got = agrees(spark, tmp_path, "condition_slots", part=(parts, "p_partkey long, p_name string, p_size int"))
    assert (3, None) in got and (2**60 + 1, "the player cannot see {item}") in got


def test_plans_of_deep_subtrees_stay_short(spark, tmp_path, monkeypatch):
    plans, cut = [], graphs.checkpointed
    monkeypatch.setattr(graphs, "checkpointed", lambda df: plans.append(len(df._jdf.queryExecution().optimizedPlan().toString())) or cut(df))
    parts = [(5 << k,) for k in range(11)] + [(n,) for n in range(24)] + [(None,)]
    got = agrees(spark, tmp_path, "subtree", part=(parts[:11] + [p for p in parts[11:] if p[0] not in (5, 10, 20)], "p_partkey long"))
    assert (5 << 10, 10) in got and (23, 2) in got
    assert max(plans) < 10_000


def test_free_tiles_of_many_points_in_few_places(spark, tmp_path):
    suppliers = [(k,) for k in range(120)] + [(None,)]
    customers = [(c,) for c in [*range(90, 200), *range(1599, 5000), None]]
    got = agrees(spark, tmp_path, "nearest_free_tile", supplier=(suppliers, "s_suppkey long"), customer=(customers, "c_custkey long"))
    assert 0 < len(got) < 120
    assert not broadcasts(catalogue.queries()["nearest_free_tile"](spark, str(tmp_path)), "Generate")


def test_free_tiles_by_ring_then_dy_then_dx(spark):
    points = [(k, k * 5 % 60, k * 11 % 50) for k in range(40)] + [(99, 5, 11), (100, 500, 500)]
    cells = [(x, y, x * 100 + y) for x in range(60) for y in range(50) if (x * 7 + y * 3) % 29 == 0]
    want = {}
    for k, px, py in points:
        near = [((max(abs(x - px), abs(y - py)), y - py, x - px), c) for x, y, c in cells if max(abs(x - px), abs(y - py)) <= 3]
        if near:
            want[k] = min(near)[1]
    found = spatial.nearest_free(spark.createDataFrame(points, "id int, x int, y int"), spark.createDataFrame(cells, "x long, y long, component long"), 3)
    assert {r.id: r.component for r in found.collect()} == want and want


def test_nearest_of_many_rows_in_few_places(spark, tmp_path, monkeypatch):
    written, cut = [], joins.checkpointed
    monkeypatch.setattr(joins, "checkpointed", lambda df: written.append(out := cut(df)) or out)
    suppliers = [(k,) for k in [*range(3, 3000, 10), *range(100_003, 101_003, 10), None]]
    customers = [(c,) for c in [*range(0, 9000, 17), *range(500_000, 509_000, 17), None]]
    tables = {"supplier": (suppliers, "s_suppkey long"), "customer": (customers, "c_custkey long")}
    for name in ("nearest_join", "nearest_join_rings"):
        (tmp_path / name).mkdir()
        got = agrees(spark, tmp_path / name, name, **tables)
        assert len(got) == len(customers) and (None, 3, None) in got
    assert max(df.count() for df in written) <= 1001  # places, of which these keys have 1000 and none


def test_nearest_of_scattered_places(spark):
    rng = random.Random(5)
    spots = lambda n, wide: [(rng.randrange(-wide, wide), rng.randrange(-wide, wide)) for _ in range(n)]
    for places in (spots(300, 200) + spots(5, 10**9), [(x, 7) for x, _ in spots(300, 5000)], spots(280, 10) + [(4, 4)] * 20):
        right = [(k, *p) for k, p in enumerate(places)]
        left = [(k, *p) for k, p in enumerate(spots(60, 300) + spots(5, 10**8) + [places[0]] * 3)]
        want = {k: min((max(abs(x - rx), abs(y - ry)), rid) for rid, rx, ry in right) for k, x, y in left}
        made = spark.createDataFrame(left, "k long, x long, y long"), spark.createDataFrame(right, "rid long, rx long, ry long")
        for small in (0, 1000):
            assert {r.k: (r.distance, r.rid) for r in joins.nearest(*made, small=small).collect()} == want
