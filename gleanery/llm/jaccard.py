"""Near-duplicate classes by exact Jaccard similarity of word shingles, over count-vector R-trees.

A document is the set of its five-word shingles. Hashed into GROUPS groups, a set becomes a point: how many of its shingles
each group has. Two sets share at most the sum over the groups of the smaller count, so a point, and likewise a box of
points by its upper corner and its smallest size, is passed over where that sum is below what the similarity asks for
(3/7 of both sizes together, at 0.75). What survives is verified on the sets themselves.

1. Documents of equal sets become one representative, by a digest of the set.
2. Representatives are dealt to cells, one for each of KEYS independent minimum hashes of their shingles. A pair of similarity s
   shares each cell with probability s, so a link shares fewer than needed(s) (14 at 0.75) with a probability below LOSS; pairs that
   share so few, such as texts with one passage in common, go no further. With `exact`, cells are the smallest shingles of a set, as
   many as leave fewer than a link must share: links then share a cell for certain, and no number of cells is asked for.
3. In each of ROUNDS rounds each representative is verified against one partner of another class: of its cells' first members (by
   class, then by document or, later, by a hash that changes with the round) the one that it shares the most cells with.
   That joins most copies of a text to one class.
4. In cells with members of different classes, R-trees give all pairs of different classes whose bound holds; those that
   share enough cells, counted in the first cell that they share, are verified. Within a class nothing can change the classes, so
   nothing is tried: the join gives classes only, neither links nor their number.

Scale: texts are read where they lie; only representatives with enough shared cells have theirs moved, once. A cell with more
members than `cell_rows` (a passage in a third of all documents) is dealt by bands of size, of which only neighbours can
link, and within bands by blocks, so no task has more than two blocks. No group's pairs are written out: pairs leave a task only past the
bound, between classes. Classes are joined by distributed rounds.

Defined cases: null texts and texts without words have no shingles and link with nothing; a text of fewer than five words has all of
them as its one shingle; rows of one doc_id are one document (linked by either's text); rows with a null doc_id have a null
class; repeated rows stay rows; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .graph import components
from .suffixes import _mix, prefix_sums, span_hash

U = np.uint64
SHINGLE = 5
GROUPS = 64
KEYS = 40
#: The probability with which a link may share too few cells.
LOSS = 2e-8
#: Rows of small cells that one task takes.
TASK_ROWS = 8000
#: Rounds of one partner each before the trees.
ROUNDS = 4
FANOUT = 16
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(77)
_PLACE = _rng.integers(1, 2**63, SHINGLE, dtype=np.uint64) | U(1)
_SEEDS = _rng.integers(1, 2**63, KEYS, dtype=np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """Hashes of the distinct shingles, sorted. The hash of a word is of its bytes, A-Z lower-cased."""
    raw = (text or "").encode().translate(_LOWER)
    if not raw:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(raw, np.uint8)
    space = np.ones(len(data) + 2, bool)
    space[1:-1] = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    word = span_hash(prefix_sums(data), start, end) + (end - start).astype(np.uint64)
    n = min(SHINGLE, len(word))
    out = np.full(len(word) - n + 1, n, np.uint64)
    for j in range(n):
        out += _mix(word[j : j + len(out)] * _PLACE[j])
    return np.unique(_mix(out))


def linked(a: np.ndarray, b: np.ndarray, similarity: int = 75) -> bool:
    """Whether two sorted sets have this similarity, in hundredths."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= similarity * (len(a) + len(b) - both)


def point(shingles: np.ndarray) -> np.ndarray:
    """How many shingles each group has."""
    return np.bincount((shingles >> U(40)) % U(GROUPS), minlength=GROUPS).astype("<u4")


def keys(shingles: np.ndarray) -> list[int]:
    """The cells of a set: its minimum under each of the hashes."""
    return [int((_mix(shingles ^ seed).min() + U(k)).astype(np.int64)) for k, seed in enumerate(_SEEDS)]


def needed(similarity: int) -> int:
    """How many cells a pair must share: the most that all links but a part of LOSS do."""
    s, lost = similarity / 100, 0.0
    for n in range(KEYS):
        lost += comb(KEYS, n) * s**n * (1 - s) ** (KEYS - n)
        if lost > LOSS:
            return max(1, n)
    return KEYS


def prefix(shingles: np.ndarray, similarity: int) -> list[int]:
    """The smallest shingles of a set: one at least is also among those of any set that it's linked with."""
    least = -(-similarity * len(shingles) // 100)
    return shingles[: len(shingles) - least + 1].astype(np.int64).tolist()


class RTree:
    """Points packed by size, then by their fullest group, FANOUT to a box; each box has its upper corner and smallest size."""

    def __init__(self, points: np.ndarray, similarity: int) -> None:
        self.need = similarity / (100 + similarity)
        size = points.sum(axis=1)
        self.order = np.lexsort((points.argmax(axis=1), size))
        corner, least = points[self.order].astype(np.int64), size[self.order]
        self.levels = [(corner, least)]
        while len(corner) > FANOUT:
            at = np.arange(0, len(corner), FANOUT)
            corner, least = np.maximum.reduceat(corner, at, axis=0), np.minimum.reduceat(least, at)
            self.levels.append((corner, least))

    def search(self, p: np.ndarray) -> np.ndarray:
        """Numbers of the points whose bound allows the similarity with p."""
        n, p = int(p.sum()), p.astype(np.int64)
        at = np.arange(len(self.levels[-1][0]))
        for height in range(len(self.levels) - 1, -1, -1):
            corner, least = self.levels[height]
            if height < len(self.levels) - 1:
                at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                at = at[at < len(corner)]
            bound = np.minimum(corner[at], p).sum(axis=1)
            at = at[bound >= self.need * (n + least[at]) - 1e-9]
            if not at.size:
                break
        return self.order[at]


def survivors(cell: np.ndarray, label: np.ndarray, side: np.ndarray, points: np.ndarray, similarity: int, two: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of row numbers in one cell, of different labels (and of different sides, if there are two), that the
    bound allows. cell is sorted."""
    edge = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
    size = np.diff(np.append(edge, len(cell)))
    total, need = points.sum(axis=1, dtype=np.int64), similarity / (100 + similarity)
    a_out, b_out = [], []
    # Small cells are a single box each: all of one size are bounded together.
    for n in range(2, FANOUT + 1):
        first = edge[size == n]
        i, j = np.triu_indices(n, 1)
        step = max(1, 200_000 // len(i))
        for k in range(0, len(first), step):
            a, b = (first[k : k + step, None] + i).ravel(), (first[k : k + step, None] + j).ravel()
            apart = label[a] != label[b]
            if two:
                apart &= side[a] != side[b]
            a, b = a[apart], b[apart]
            both = np.minimum(points[a], points[b]).sum(axis=1, dtype=np.int64)
            fits = both >= need * (total[a] + total[b]) - 1e-9
            a_out.append(a[fits])
            b_out.append(b[fits])
    for start, n in zip(edge[size > FANOUT].tolist(), size[size > FANOUT].tolist()):
        rows = np.arange(start, start + n)
        left, right = rows[side[rows] == 0], rows[side[rows] == 1]
        if two and not (len(left) and len(right)):
            continue
        tree, asked = (RTree(points[right], similarity), left) if len(right) else (RTree(points[left], similarity), left)
        held = right if len(right) else left
        for row in asked.tolist():
            met = held[tree.search(points[row])]
            met = met[label[met] != label[row]]
            if not len(right):
                met = met[met > row]
            a_out.append(np.full(len(met), row))
            b_out.append(met)
    if not a_out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(a_out), np.concatenate(b_out)


def verified(pairs: DataFrame, texts: DataFrame, similarity: int) -> DataFrame:
    """Those of the pairs a, b whose texts (node, text) have the similarity."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, known, keep = None, None, []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if y != last:
                    last, known = y, shingle_set(y)
                keep.append(linked(shingle_set(x), known, similarity))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(check, "a long, b long")


def near_duplicates(docs: DataFrame, similarity: int = 75, cell_rows: int = 2000, exact: bool = False) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id: the smallest doc_id that links lead to, itself included.
    exact: no link is left to chance, for a quarter of all shingles (at 75) as cells."""
    spark = docs.sparkSession
    need = 1 if exact else needed(similarity)
    common.ship(spark)
    common.small_batches(spark)
    source = common.documents(docs)
    schema = "doc_id long, n_shingles long, set_a long, set_b long, keys array<long>, point binary"
    names = ["doc_id", "n_shingles", "set_a", "set_b", "keys", "point"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in names[1:]]
            for text in batch.column(1).to_pylist():
                s = shingle_set(text)
                if len(s):
                    one, two = (int(np.add.reduce(_mix(s * f), dtype=np.uint64).astype(np.int64)) for f in (_PLACE[0], _PLACE[1]))
                    row = (len(s), one, two, prefix(s, similarity) if exact else keys(s), point(s).tobytes())
                else:
                    row = (0, 0, 0, [], b"")
                for c, v in zip(columns, row):
                    c.append(v)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=names)

    signed = common.written(source.mapInArrow(sign, schema))
    full = signed.where("n_shingles > 0 and doc_id is not null")
    same = full.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("node"), F.any_value("keys").alias("keys"), F.any_value("point").alias("point"))
    nodes = common.written(same)

    postings = nodes.select("node", F.explode("keys").alias("key"))
    shared = postings.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    postings = common.written(postings.join(shared, "key"))
    rich = postings.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") >= need).select("node")
    postings, placed_rows = common.written_and_counted(postings.join(rich, "node", "left_semi"), F.lit(True))

    members = postings.select("node").distinct()
    texts = source.join(members.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi")
    texts = common.written(texts.select(F.col("doc_id").alias("node"), F.coalesce("text", F.lit("")).alias("text")))

    links, tried, classes = None, None, None
    for number in range(ROUNDS):
        labelled = postings
        if classes is None:
            labelled = labelled.withColumn("label", F.col("node"))
        else:
            labelled = labelled.join(classes, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
        labelled = common.written(labelled)
        by = F.struct("label", F.xxhash64("node", F.lit(number)) if number else F.col("node"))
        first = labelled.groupBy("key").agg(F.min_by(F.struct("node", "label"), by).alias("first")).select("key", F.col("first.node").alias("b"), F.col("first.label").alias("other"))
        partner = labelled.join(first, "key").where("label != other").groupBy("node", "b").agg(F.count("*").alias("n")).where(F.col("n") >= need)
        partner = partner.select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b"), "node", "n")
        if tried is not None:
            partner = partner.join(tried, ["a", "b"], "left_anti")
        best = partner.groupBy("node").agg(F.max_by(F.struct("a", "b"), F.struct("n", -F.col("a"), -F.col("b"))).alias("p"))
        now = common.written(best.select("p.a", "p.b").distinct())
        tried = now if tried is None else tried.unionByName(now)
        found, number_found = common.written_and_counted(verified(now, texts, similarity), F.lit(True))
        links = found if links is None else links.unionByName(found)
        if not number_found:
            break
        classes = common.written(components(links))

    labelled = postings
    labelled = labelled.join(classes, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component") if classes is not None else labelled.withColumn("label", F.col("node"))
    labelled = common.written(labelled)
    mixed = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    cells = labelled.join(mixed, "key").join(nodes.select("node", "point", "keys", "n_shingles"), "node")
    tasks = placed_rows // TASK_ROWS + 1
    calm = cells.where(F.col("members") <= cell_rows).select(F.pmod(F.xxhash64("key"), F.lit(tasks)).alias("task"), "key", "node", "label", F.lit(0).alias("side"), F.lit(False).alias("two"), "point", "keys")

    # Crowded cells: bands of size (neighbours alone can link), cut into blocks; each pair of blocks is a task.
    crowd = cells.where(F.col("members") > cell_rows).withColumn("band", F.floor(F.log(F.col("n_shingles").cast("double")) / F.log(F.lit(100.0 / similarity))).cast("int"))
    blocks = crowd.groupBy("key", "band").agg((F.floor(F.count("*") / cell_rows) + 1).cast("int").alias("blocks"))
    crowd = crowd.join(blocks, ["key", "band"]).join(blocks.select("key", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above")), ["key", "band"], "left")
    crowd = crowd.join(blocks.select("key", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below")), ["key", "band"], "left")
    crowd = crowd.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    up_to = lambda n: F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    place = lambda band, i, other, j, side, two: F.struct(F.xxhash64("key", band, i, other, j).alias("task"), side.cast("int").alias("side"), two.alias("two"))
    inside = F.transform(up_to(F.col("blocks")), lambda j: place(F.col("band"), F.least("own", j), F.col("band"), F.greatest("own", j), F.col("own") > j, F.col("own") != j))
    higher = F.transform(up_to(F.col("above")), lambda j: place(F.col("band"), F.col("own"), F.col("band") + 1, j, F.lit(0), F.lit(True)))
    lower = F.transform(up_to(F.col("below")), lambda j: place(F.col("band") - 1, j, F.col("band"), F.col("own"), F.lit(1), F.lit(True)))
    crowd = crowd.withColumn("place", F.explode(F.concat(inside, higher, lower))).select("place.task", "key", "node", "label", "place.side", "place.two", "point", "keys")

    def pair_up(table: pa.Table) -> pa.Table:
        key = table.column("key").to_numpy()
        by = np.lexsort((table.column("node").to_numpy(), key))
        node, label, side = (table.column(c).to_numpy()[by] for c in ("node", "label", "side"))
        points = np.frombuffer(b"".join(table.column("point").to_pylist()), "<u4").reshape(-1, GROUPS)[by]
        key = key[by]
        a, b = survivors(key, label, side, points, similarity, table.column("two")[0].as_py())
        if not exact:
            # A pair comes up in every cell that it shares; it's taken in the first of them, if they are enough.
            all_keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(-1, KEYS)[by]
            keep = np.zeros(len(a), bool)
            for at in range(0, len(a), 100_000):
                i, j = a[at : at + 100_000], b[at : at + 100_000]
                both = all_keys[i] == all_keys[j]
                keep[at : at + 100_000] = (both.sum(axis=1) >= need) & (all_keys[i, both.argmax(axis=1)] == key[i])
            a, b = a[keep], b[keep]
        return pa.table({"a": pa.array(np.maximum(node[a], node[b]), pa.int64()), "b": pa.array(np.minimum(node[a], node[b]), pa.int64())})

    pairs = calm.unionByName(crowd).groupBy("task").applyInArrow(pair_up, "a long, b long").distinct()
    pairs = common.written(pairs.join(tried, ["a", "b"], "left_anti"))
    links = links.unionByName(verified(pairs, texts, similarity))
    classes = components(links).withColumnRenamed("node", "of")

    # Documents to representatives, representatives to classes.
    least = nodes.select("set_a", "set_b", "n_shingles", "node")
    placed = signed.select("doc_id", "n_shingles", "set_a", "set_b").join(least, ["set_a", "set_b", "n_shingles"], "left")
    placed = placed.join(classes, F.col("node") == F.col("of"), "left")
    own = F.coalesce("component", "node", "doc_id")
    return placed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))


def op2_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
