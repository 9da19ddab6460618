import numpy as np

from gleanery.llm import permutation


def brute(rows, queries, k=20):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for i, q in ok:
        if queries(i):
            found = {}
            for j, x in ok:
                if j != i:
                    found[j] = max(found.get(j, -1e300), (x * q).sum())
            out[i] = sorted(((-s, j) for j, s in found.items()))[:k]
    return out


def test_footrule_matches_its_definition():
    rng = np.random.default_rng(0)
    lists = np.array([rng.permutation(12)[:5] for _ in range(40)], np.int32)
    files = permutation.Files(lists, 12)
    place = lambda x, p: list(x).index(p) if p in x else 5
    for q in lists[:8]:
        assert files.footrule(q).tolist() == [sum(abs(place(q, p) - place(x, p)) for p in range(12)) for x in lists]


def test_defined_cases_and_exactness_when_all_is_reranked(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(v) for v in rng.integers(-3, 4, 6)]) for k in range(70)]
    rows += [(100 + k, rows[3][1]) for k in range(40)] + [(200, None), (201, []), (202, [0.0] * 6), (203, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (204, [float("nan")] * 6), (205, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (206, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, perm string")
    index, pivots = permutation.build(df, pivots=16, length=16)
    got = {}
    for r in permutation.search(index, pivots, index.where("vec_id % 20 = 0"), part=1.0, block_rows=30, query_rows=2).collect():
        got.setdefault(r.query_id, []).append((r.rank, -r.score, r.vec_id))
    want = brute([r for r in rows if r[0] != 206], lambda i: i % 20 == 0)
    assert {q: [(s, v) for _, s, v in sorted(g)] for q, g in got.items()} == want
    assert all([r for r, _, _ in sorted(g)] == list(range(1, len(g) + 1)) for g in got.values())


def test_empty(spark):
    index, pivots = permutation.build(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert permutation.search(index, pivots, index).count() == 0


def test_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows, lambda i: i % 20 == 0)
    got = {}
    for r in permutation.op5_permutation_index(spark, sf).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    assert set(got) == set(want)
    hits = [len(set(got[q]) & {j for _, j in w}) / len(w) for q, w in want.items()]
    assert np.mean(hits) >= 0.95, np.mean(hits)
    vectors = {i: np.array(v, float) for i, v in rows}
    assert all(abs(s - vectors[q] @ vectors[v]) < 1e-12 for q, g in got.items() for v, s in g.items())
