"""Queries over whole tables against brute force."""

import pyarrow.parquet as pq

from gleanery.operators import spatial
from gleanery.plans import catalogue


def rows(sf_dir, name, *columns):
    t = pq.read_table(f"{sf_dir}/{name}.parquet", columns=list(columns))
    return list(zip(*(t[c].to_pylist() for c in columns)))


def run(spark, sf_dir, name, *columns):
    return sorted(tuple(r[c] for c in columns) for r in catalogue.queries()[name](spark, sf_dir).collect())


def test_quests_and_points_of_every_account(spark, sf_dir):
    done = {}
    for seq, account in rows(sf_dir, "orders", "o_orderkey", "o_custkey"):
        quest = seq % 500
        while quest:
            done[account, quest] = min(seq, done.get((account, quest), seq))
            quest //= 2
    assert max(a for a, _ in done) >= 40
    assert run(spark, sf_dir, "account_quests", "account", "quest", "at") == sorted((a, q, s) for (a, q), s in done.items())
    points = {}
    for a, q in done:
        points[a] = points.get(a, 0) + q % 5
    assert run(spark, sf_dir, "account_points", "account", "points") == sorted(points.items())


def test_components_over_every_edge(spark, sf_dir):
    top = {}

    def find(n):
        while top.setdefault(n, n) != n:
            n = top[n]
        return n

    for s, p in rows(sf_dir, "lineitem", "l_suppkey", "l_partkey"):
        a, b = find(s), find(p + 1000000)
        top[max(a, b)] = min(a, b)
    assert run(spark, sf_dir, "components", "node", "component") == sorted((n, find(n)) for n in top)


def test_components_that_few_edges_join(spark, tmp_path):
    lines = [(1, 1, 1), (2, 2, 1), (3, 2, 2), (97, 3, 3), (98, 4, 3), (99, 5, 4)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    want = [(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (1000001, 1), (1000002, 1), (1000003, 3), (1000004, 5)]
    assert run(spark, tmp_path, "components", "node", "component") == want


def owned(tiles, points):
    return {(x, y): min(((x - px) ** 2 + (y - py) ** 2, k) for k, px, py in points)[1] for x, y in tiles}


def borders(owner):
    met = [(k, owner.get(n)) for (x, y), k in owner.items() for n in ((x + 1, y), (x, y + 1))]
    return sorted({(min(p), max(p)) for p in met if p[1] is not None and p[0] != p[1]})


def test_tiles_of_all_suppliers(spark, tmp_path):
    spark.range(60).select("id").withColumnRenamed("id", "s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    owner = owned([(n % 40, n // 40) for n in range(1600)], [(k, k * 7 % 40, k * 11 % 40) for k in range(60)])
    assert max(owner.values()) >= 30
    assert run(spark, tmp_path, "tile_owners", "x", "y", "owner") == sorted((*t, k) for t, k in owner.items())
    assert run(spark, tmp_path, "component_borders", "a", "b") == borders(owner)
    ports = run(spark, tmp_path, "area_ports", "a", "b", "width")
    assert sorted({p[:2] for p in ports}) == borders(owner)


def test_owners_beyond_the_broadcast_size(spark):
    points = [(k, k * 37 % 211, k * 53 % 97) for k in range(50)] + [(90, 37, 53)]
    tiles = [(x, y) for x in range(-30, 300, 7) for y in range(0, 120, 11)]
    made = spark.createDataFrame(tiles, "x long, y long"), spark.createDataFrame(points, "k long, x long, y long")
    for options in ({}, {"small": 5, "cell": 8}):
        got = {(r.x, r.y): r.owner for r in spatial.owners(*made, **options).collect()}
        assert got == owned(tiles, points)


def test_coordinates_of_every_part(spark, tmp_path):
    keys = [0, 1, 2, 89_999, 90_000, 90_001, 90_002, 1_000_001]
    spark.createDataFrame([(k, 7) for k in keys], "p_partkey long, p_size long").write.parquet(str(tmp_path / "part.parquet"))
    want = {k: [f"{k}:7", f"{k}:7;7:{k}", f"{k % 90000 + 1000}:1007"][k % 3] for k in keys}
    assert run(spark, tmp_path, "coordinates", "p_partkey", "pairs") == sorted(want.items())


def test_pairs_of_all_lines(spark, sf_dir):
    groups = {}
    for order, flag, status, line in rows(sf_dir, "lineitem", "l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber"):
        groups.setdefault((order, flag, status), []).append(line)
    want = sorted((k[0], a, b) for k, lines in groups.items() for a in lines for b in lines if a != b)
    assert run(spark, sf_dir, "self_pair_residual", "l_orderkey", "line", "other_line") == want
