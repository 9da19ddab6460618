import random
import re
from itertools import combinations
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import graph, jaccard


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows, similarity=75):
    ids = sorted({d for d, _ in rows if d is not None})
    up = {d: d for d in ids}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    for (d, a), (e, b) in combinations([s for s in sets if s[1]], 2):
        if 100 * len(a & b) >= similarity * len(a | b):
            x, y = sorted((root(d), root(e)))
            up[y] = x
    return sorted(((d is None, d or 0, len(shingles(t)), None if d is None else root(d)) for d, t in rows), key=repr)


def corpus(seed, groups, size):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    hot = text(30)
    rows, number = [], 0
    for _ in range(groups):
        base = text(rng.choice([1, 4, 6, 20, 60, 150]))
        if rng.random() < 0.4:
            base = base + hot
        for _ in range(rng.randint(1, size)):
            w = list(base)
            for _ in range(rng.randint(0, 1 + len(w) // 30)):
                at = rng.randint(0, len(w))
                w[at : at + rng.randint(0, 2)] = text(rng.randint(0, 2))
            rows.append((number * 7919 % 10007, rng.choice([" ", "\n", "\t "]).join(w).upper()))
            number += 1
    rng.shuffle(rows)
    return rows + [(20000, None), (20001, ""), (20002, " \n"), (20003, "a"), (20004, "A"), (20005, "a"), (None, "a"), (None, rows[0][1]), rows[1], rows[1], (20006, "é É"), (20007, "É é")]


def check(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("x")).withColumn("component_id", F.lit(1))
    got = [(r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df, **kw).collect()]
    assert sorted(got, key=repr) == brute(rows, kw.get("similarity", 75))


def test_matches_brute_force(spark):
    check(spark, corpus(1, 60, 8))


def test_crowded_cells_match_brute_force(spark):
    check(spark, corpus(2, 40, 12), cell_rows=4)


@pytest.mark.parametrize("similarity,exact", [(50, False), (50, True), (75, True), (30, True)])
def test_other_similarities_match_brute_force(spark, similarity, exact):
    check(spark, corpus(3, 40, 8), similarity=similarity, exact=exact, cell_rows=20)


def test_needed_cells_lose_no_more_than_said():
    for similarity in (50, 60, 75, 90):
        n, s = jaccard.needed(similarity), similarity / 100
        tail = lambda n: sum(comb(jaccard.KEYS, k) * s**k * (1 - s) ** (jaccard.KEYS - k) for k in range(n))
        assert tail(n) <= jaccard.LOSS < tail(n + 1)


def test_very_long_texts(spark):
    rng = random.Random(8)
    long = [f"w{rng.randrange(5000)}" for _ in range(150_000)]
    other = [w if rng.random() < 0.97 else "x" for w in long]
    rows = [(5, " ".join(long)), (9, " ".join(other)), (3, " ".join(long[:70_000])), (4, " ".join(long[:100]))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: (len(shingles(t)), 5 if d == 9 else d) for d, t in rows}


def test_empty_table(spark):
    assert jaccard.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sets_are_those_of_the_words():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice(["a", "B", "b", " ", "\n", "é", "\x0b", "\x1c", "  "]) for _ in range(rng.randint(0, 40)))
        assert len(jaccard.shingle_set(text)) == len(shingles(text))
    assert np.array_equal(jaccard.shingle_set("A b c d e F"), jaccard.shingle_set(" a\tB c\nd e f "))


def test_trees_pass_over_nothing_that_may_link():
    rng = np.random.default_rng(0)
    points = rng.poisson(rng.choice([0.2, 1, 3], 300)[:, None] * np.ones(jaccard.GROUPS)).astype(np.uint32)
    points[::7] = points[0] + rng.integers(0, 2, (len(points[::7]), jaccard.GROUPS))
    tree = jaccard.RTree(points, 75)
    total = points.sum(axis=1)
    for p in points[:40]:
        want = np.flatnonzero(np.minimum(points, p).sum(axis=1) >= 3 / 7 * (total + p.sum()) - 1e-9)
        assert sorted(tree.search(p)) == list(want)


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1100)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up if any(x in e and e[0] != e[1] for e in edges)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("at_once", [0, 1, 40, graph.AT_ONCE])
def test_components_by_rounds_and_in_one_task(spark, at_once):
    rng = random.Random(at_once)
    chain = [(k, k + 1) for k in rng.sample(range(1000, 1200), 180)]
    star = [(9000, k) for k in range(8000, 8030)]
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(170)] + chain + star + [(2**62, -(2**62)), (-5, 2**62)]
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for x in sorted(near):
        todo = [] if x in want else [x]
        while todo:
            y = todo.pop()
            if y not in want:
                want[y] = x
                todo += near[y]
    got = graph.components(spark.createDataFrame(edges, "a long, b long"), at_once).collect()
    assert len(got) == len(want) and {r.node: r.component for r in got} == want


def jobs_of(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_small_graphs_take_few_jobs(spark):
    rng = random.Random(2)
    edges = spark.createDataFrame([(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(300)], "a long, b long")
    got = jobs_of(spark, "components", lambda: graph.components(edges).collect())
    assert 0 < got <= 6, got  # 43 by rounds
    rows = spark.createDataFrame(corpus(1, 60, 8), "doc_id long, text string")
    got = jobs_of(spark, "near", lambda: jaccard.near_duplicates(rows).collect())
    assert 0 < got <= 90, got  # 120 by rounds
