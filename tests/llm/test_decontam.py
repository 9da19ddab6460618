import random
import re
from collections import Counter

from pyspark.sql import functions as F

from gleanery.llm import decontam


def bags(text, width):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return [tuple(w[k : k + width]) for k in range(len(w) - width + 1)]


def brute(docs, items, similarity=0.75):
    """Best similarity of any item-sized window, all windows tried."""
    out = {}
    for d, text in docs:
        for i, item in items:
            n = len(re.findall(r"[^\W_]+", (item or "").lower()))
            width = min(5, n)
            if not n:
                continue
            own, all_ = Counter(bags(item, width)), bags(text, width)
            for s in range(len(all_)):
                here = Counter(all_[s : s + n - width + 1])
                value = sum((own & here).values()) / sum((own | here).values())
                if value >= similarity:
                    out[d, i] = max(out.get((d, i), 0), value)
    return out


def test_matches_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(30)] + ["é", "x"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.choice([1, 3, 5, 8, 20, 40, 41]))) for k in range(25)] + [(99, None), (98, ""), (97, "..."), (3, text(20))]
    docs = [(k, text(rng.randint(0, 120))) for k in range(40)]
    for k in range(120):
        w = rng.choice(items[:25])[1].split()
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(w))
            w[at : at + rng.randint(0, 1)] = rng.choice([[], [rng.choice(vocabulary)]])
        docs.append((100 + k, f"{text(rng.randint(0, 30))}, {' '.join(w).upper()}. {text(rng.randint(0, 30))}"))
    docs += [(None, items[5][1]), (500, None), (501, ""), docs[60], (502, items[9][1] * 2)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("x")).withColumn("width", F.lit(0))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("x"))
    want = brute(docs, items)
    for broadcast_items in (1000, 0):
        rows = decontam.leaks(d, b, broadcast_items=broadcast_items).collect()
        got = {}
        for r in rows:
            got[r.doc_id, r.item_id] = max(r.similarity, got.get((r.doc_id, r.item_id), 0))
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_simhash_is_the_majority_of_bits(spark):
    rng = random.Random(1)
    bag = [rng.getrandbits(64) - (1 << 63) for _ in range(75)]
    got = spark.createDataFrame([(bag,)], "bag array<long>").select(decontam.simhash(F.col("bag"))).first()[0]
    assert got & (2**64 - 1) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in bag) > len(bag))


def test_empty_tables(spark):
    d, b = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontam.leaks(d.limit(0), b).count() == decontam.leaks(d, b.limit(0)).count() == 0
    assert [(r.doc_id, r.item_id, r.similarity) for r in decontam.leaks(d, b).collect()] == [(1, 1, 1.0)]


def test_unbroadcast_plan_moves_places_not_arrays(spark):
    d, b = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    plan = decontam.leaks(d, b, broadcast_items=0)._jdf.queryExecution().optimizedPlan().toString()
    arrays = [line for line in plan.splitlines() if "Join" in line and "shingle" in line]
    assert arrays
    at = plan.splitlines().index(arrays[0])
    depth = len(arrays[0]) - len(arrays[0].lstrip(" :+-"))
    left = next(line for line in plan.splitlines()[at + 1 :] if len(line) - len(line.lstrip(" :+-")) > depth)
    assert "all" not in left.replace("shingle", "")


def test_radius_keeps_pairs_at_the_edge(spark):
    """Fingerprints of bags of similarity 0.75 to 0.8 lie within the default radius."""
    rng = random.Random(4)
    rows = []
    for _ in range(3000):
        n = rng.choice([30, 60, 120])
        bag = [rng.getrandbits(64) - (1 << 63) for _ in range(n)]
        gone = round(n * rng.uniform(0.2, 0.25) / 1.75)  # of the smaller over the larger counts, 0.75 and more stays
        rows.append((bag, bag[gone:] + [rng.getrandbits(64) - (1 << 63) for _ in range(gone)]))
    apart = F.bit_count(decontam.simhash(F.col("a")).bitwiseXOR(decontam.simhash(F.col("b"))))
    got = [r[0] for r in spark.createDataFrame(rows, "a array<long>, b array<long>").select(apart).collect()]
    assert sum(x <= 23 for x in got) >= 0.999 * len(got)


def test_very_long_text(spark):
    rng = random.Random(2)
    item = " ".join(f"v{rng.randrange(400)}" for _ in range(30))
    text = " ".join(f"w{rng.randrange(4000)}" for _ in range(120_000))
    docs = spark.createDataFrame([(1, f"{text} {item} {text}"), (2, text)], "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.window_start, r.similarity) for r in decontam.leaks(docs, items).collect()] == [(1, 7, 120_000, 1.0)]
