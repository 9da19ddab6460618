import hashlib
import random

import numpy as np
import pytest

from gleanery.llm import suffixes


def plain(docs, window):
    """Removed spans of each (doc_id, text), by a dictionary of all strings."""
    first = {}
    for i, t in docs:
        s = (t or "").encode()
        for p in range(len(s) - window + 1):
            key = s[p : p + window]
            if i is not None:
                first[key] = min(i, first.get(key, i))
    out = []
    for i, t in docs:
        s = (t or "").encode()
        hit = [False] * len(s)
        for p in range(len(s) - window + 1):
            if i is not None and first[s[p : p + window]] < i:
                hit[p : p + window] = [True] * window
        spans, p = [], 0
        while p < len(s):
            if hit[p]:
                e = p
                while e < len(s) and hit[e]:
                    e += 1
                spans.append((p, e))
                p = e
            else:
                p += 1
        out.append((i, t or "", spans))
    return out


def check(spark, docs, **kw):
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("part", __import__("pyspark").sql.functions.lit("x"))
    got = [(r.doc_id, r.text, [(x.start, x.end) for x in r.removed]) for r in suffixes.repeated_spans(df, **kw).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(got, key=key) == sorted(plain(docs, kw.get("window", 50)), key=key)


def corpus(seed, n, alphabet):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    shared = [word(rng.randint(5, 90)) for _ in range(6)]
    docs = []
    for i in range(n):
        t = "".join(rng.choice([word(rng.randint(0, 30)), rng.choice(shared), rng.choice(shared)[rng.randint(0, 9) :]]) for _ in range(rng.randint(0, 6)))
        docs.append((i if rng.random() < 0.9 else rng.randint(0, n), t))
        if rng.random() < 0.3:
            docs.append((rng.randint(n, 3 * n), t[: rng.randint(0, len(t))] + word(1) + t[rng.randint(0, len(t)) :]))
    return docs + [(None, docs[0][1]), (None, shared[0] * 2), (-5, None), (7, ""), docs[1], docs[1]]


@pytest.mark.parametrize("seed,alphabet,window,gram", [(1, "abcdefgé", 12, 8), (2, "ab", 16, 10), (3, "a", 12, 8), (4, "xyz \n", 50, 26)])
def test_matches_brute_force(spark, seed, alphabet, window, gram):
    check(spark, corpus(seed, 60, alphabet), window=window, gram=gram, part_bytes=1500)


@pytest.mark.parametrize("seed,alphabet,window,gram", [(1, "abcdefgé", 12, 8), (2, "ab", 16, 10), (4, "xyz \n", 50, 26)])
def test_crowded_landmarks_match_brute_force(spark, seed, alphabet, window, gram):
    check(spark, corpus(seed, 60, alphabet), window=window, gram=gram, part_bytes=1500, hot=3, pass_contexts=5)


@pytest.mark.parametrize("hot", [100, 20_000])
def test_one_landmark_in_thousands_of_contexts(spark, hot):
    rng = random.Random(5)
    word = lambda k: "".join(rng.choice("abcdefghijklm") for _ in range(k))
    core = word(30)
    docs = [(k, word(rng.randint(0, 40)) + word(1) * rng.randint(0, 2) + core + word(rng.randint(0, 2)) + "tail of the passage" * rng.randint(0, 1) + word(20)) for k in range(3000)]
    check(spark, docs, part_bytes=20_000, hot=hot, pass_contexts=100)


def test_long_texts_are_read_whole(spark):
    rng = random.Random(9)
    big = "".join(rng.choice("abcdefghij ") for _ in range(2_300_000))
    tail = big[-80:]
    docs = [(1, big), (2, "q" * 30 + big[262_100:262_300] + "q"), (0, tail), (3, big[:60] + "zz")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: [(x.start, x.end) for x in r.removed] for r in suffixes.repeated_spans(df).collect()}
    assert got == {0: [], 1: [(2_299_920, 2_300_000)], 2: [(30, 230)], 3: [(0, 60)]}


def test_order_sorts_suffixes():
    rng = np.random.default_rng(2)
    for alphabet, length, shallow in ((2, 20, 8), (3, 50, 16), (2, 7, 16), (1, 20, 8)):
        raw = bytes(rng.integers(97, 97 + alphabet, 400, dtype=np.uint8))
        starts = rng.integers(0, 400 - length, 300)
        numbers, run = suffixes.order(raw, starts, length, shallow)
        strings = [raw[s : s + length] for s in starts[numbers]]
        assert strings == sorted(strings) and sorted(numbers) == list(range(300))
        assert [a == b for a, b in zip(strings, strings[1:])] == list(run[1:] == run[:-1])


def test_digest_and_empty_table(spark):
    df = spark.createDataFrame([(1, "é" * 40), (2, "x" + "é" * 40)], "doc_id long, text string")
    rows = {r.doc_id: r for r in suffixes.digest(suffixes.repeated_spans(df)).collect()}
    assert (rows[2].n_bytes, rows[2].n_removed, rows[2].n_spans) == (81, 80, 1)
    assert rows[2].kept_sha256 == hashlib.sha256(b"x").hexdigest() and rows[1].n_removed == 0
    assert suffixes.digest(suffixes.repeated_spans(df.limit(0))).count() == 0


def test_repeats_are_cut_out_where_they_are_found(spark):
    docs = [(k, f"{'é' * 30}{k}{'xyz' * 20}") for k in (1, 2, 3)] + [(4, None), (5, "é" * 30), (None, "xyz" * 20)]
    want = []
    for k, t, spans in plain(docs, 50):
        raw = t.encode()
        edges = [0, *(x for span in spans for x in span), len(raw)]
        want.append((k, b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])).decode("utf-8", "ignore")))
    out = suffixes.without_repeats(spark.createDataFrame([(k, t, 0, "en") for k, t in docs], "doc_id long, text string, n_chars long, lang string"))
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(want, key=repr)
    assert all(r.n_chars == len(r.text) and r.lang == "en" for r in out.collect())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "MapInArrow" not in plan  # one worker a task
