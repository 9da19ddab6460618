"""Removal of long repeated byte strings across documents, by sorting suffixes.

Every string of `window` bytes that also starts in a document with a smaller doc_id is removed, overlaps included, all
judged on the input. The rows come from sorted suffixes (`order`): multikey quicksort, eight bytes a step, to a shallow depth;
groups that still agree there are ordered in blind tries, which compare one byte a node on the way down and one suffix in full.

Not all suffixes travel. Every string of `window` bytes has a landmark: its `gram`-byte piece of smallest hash. Equal
strings have equal landmarks, so a string can only repeat around a landmark that does:

1. Each part of the documents lists its landmarks' hashes; those in one document only are dropped for good.
2. Around the others, each part lists the hash of the context (all bytes of the strings that the landmark can be in) and
   its smallest document. A context that a smaller document has whole is covered whole, and is decided.
3. Of the rest, only contexts that share a landmark with different contexts can hold a repeat. One copy of each has the
   suffixes of its strings sorted with theirs; runs that agree for `window` bytes give the smallest document.
4. A landmark of more than about `hot` places doesn't stay whole: its contexts are dealt by their own hashes, and their strings, each
   sent once by a part, by theirs, so that only equal strings meet.

Scale: the text is written once, bucketed by part, and then read in place; what is shuffled is arrays of
hashes, one row for each pair of part and hash range (so raise part_bytes with the executors' memory on very large inputs). A part sends
each landmark, context and hot string once, however often it holds them, so a passage in a third of all documents reaches its reducer once
for each part, and no landmark is one task's. Nothing is held in the driver.

Defined cases: null texts are empty; empty and short texts lose nothing; documents of equal or null doc_id never cover one
another; repeated rows stay rows; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from . import common

U = np.uint64
#: Bytes of text in one numeric pass.
PASS = 1 << 18
NULL_ID = np.iinfo(np.int64).max

_rng = np.random.default_rng(20_240_501)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**i for i below n, modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, PASS + 1024), base, dtype=np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(31))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(29)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(32))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _power(_BASE, len(data)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span alone, wherever it lies."""
    return _mix((sums[end] - sums[start]) * _power(_INVERSE, len(sums))[start])


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    step = 1
    while 2 * step <= width:
        x = op(x[:-step], x[step:])
        step *= 2
    return op(x[: len(x) - (width - step)], x[width - step :]) if step < width else x


def landmarks(data: np.ndarray, sums: np.ndarray, limit: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the landmarks of every string of `window` bytes that ends within its text, and their grams' hashes.
    limit: for each byte, where its text ends."""
    if len(data) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts = len(data) - gram + 1
    h = _mix((sums[gram:] - sums[:starts]) * _power(_INVERSE, starts)) | U(1)
    width = window - gram + 1
    least = _sliding(h, width, np.minimum)
    least[np.arange(len(least)) + window > limit[: len(least)]] = 0
    pad = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate([pad, least, pad]), width, np.maximum) == h)
    return at, h[at]


def views(column: pa.ChunkedArray) -> list[memoryview]:
    """The bytes of each string, where Arrow holds them. The column has no nulls."""
    out: list[memoryview] = []
    for chunk in column.chunks:
        if len(chunk):
            _, offsets, data = chunk.buffers()
            edges = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(chunk.type) else np.int32)
            edges = edges[chunk.offset : chunk.offset + len(chunk) + 1].tolist()
            held = memoryview(data or b"")
            out += [held[a:b] for a, b in zip(edges, edges[1:])]
    return out


def scan(texts: list, window: int, gram: int) -> Iterator[tuple]:
    """For bounded passes over the texts (bytes or views of them): text number, place in it, gram hash, context start and end in it,
    context hash, and the pass's bytes with where in them each context starts, and their prefix sums."""
    margin = 2 * window
    group: list[tuple[int, int, memoryview, int, int]] = []
    held = 0
    for k, text in enumerate(texts):
        if len(text) < window:
            continue
        if len(text) <= PASS:
            parts = [(k, 0, text, 0, len(text))]
        else:
            parts = [(k, max(0, s - margin), text[max(0, s - margin) : s + PASS + margin], s, s + PASS) for s in range(0, len(text), PASS)]
        for part in parts:
            group.append(part)
            held += len(part[2])
            if held >= PASS:
                yield _pass(group, window, gram)
                group, held = [], 0
    if group:
        yield _pass(group, window, gram)


def _pass(group: list[tuple[int, int, memoryview, int, int]], window: int, gram: int) -> tuple:
    raw = b"".join(g[2] for g in group)
    data = np.frombuffer(raw, np.uint8)
    size = np.array([len(g[2]) for g in group])
    end = np.cumsum(size)
    begin = end - size
    sums = prefix_sums(data)
    at, h = landmarks(data, sums, np.repeat(end, size), window, gram)
    own = np.searchsorted(end, at, side="right")
    offset, core, core_end = (np.array([g[j] for g in group])[own] for j in (1, 3, 4))
    shift = offset - begin[own]
    keep = (at + shift >= core) & (at + shift < core_end)
    at, h, own, shift = at[keep], h[keep], own[keep], shift[keep]
    lo, hi = np.maximum(begin[own], at - (window - gram)), np.minimum(end[own], at + window)
    context = _mix(span_hash(sums, lo, hi) + ((at - lo) << 8 | (hi - at)).astype(np.uint64))
    return np.array([g[0] for g in group])[own], at + shift, h, lo + shift, hi + shift, context, data, lo, sums


def strings_of(lo: np.ndarray, at: np.ndarray, hi: np.ndarray, sums: np.ndarray, window: int, gram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each place that a landmark can have in a string: that place, which contexts have such a string, and the strings' hashes.
    lo, at, hi: a context's start, landmark and end among the bytes that sums is of."""
    for back in range(window - gram + 1):
        some = np.flatnonzero((at - back >= lo) & (at - back + window <= hi))
        if some.size:
            start = at[some] - back
            yield back, some, _mix(span_hash(sums, start, start + window) + U(window))


# --- sorted suffixes -------------------------------------------------------------------------------------------------


class _BlindTrie:
    """Order of byte strings that share a long prefix. A node branches on one byte position; below it only that byte
    was looked at, so a string is compared in full with one leaf, and then put where the two first differ."""

    __slots__ = ("root", "strings")

    def __init__(self) -> None:
        self.root, self.strings = None, []

    def insert(self, s: bytes, number: int) -> None:
        strings, node = self.strings, self.root
        if node is None:
            self.root = (s, [number])
            return
        while len(node) == 3:  # an inner node: position, children by byte, any leaf's string
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        other = node[0]
        if other == s:
            node[1].append(number)
            return
        split = next(i for i, (a, b) in enumerate(zip(s, other)) if a != b)
        parent, node = None, self.root
        while len(node) == 3 and node[0] < split:
            parent, node = node, node[1][s[node[0]]]
        if len(node) == 3 and node[0] == split:
            node[1][s[split]] = (s, [number])
            return
        fresh = (split, {other[split]: node, s[split]: (s, [number])}, None)
        if parent is None:
            self.root = fresh
        else:
            parent[1][s[parent[0]]] = fresh

    def ordered(self) -> list[list[int]]:
        """Groups of equal strings, in order."""
        out, stack = [], [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if len(node) == 3:
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                out.append(node[1])
        return out


def order(raw: bytes, starts: np.ndarray, length: int, shallow: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of raw at these starts, each with `length` bytes at least, sorted by their first `length` bytes: their
    numbers in order, and for each the number of its run of equal ones."""
    n = len(starts)
    data = np.frombuffer(raw + bytes(8), np.uint8)
    numbers, group = np.arange(n), np.zeros(n, np.int64)
    depth = 0
    while depth < shallow and n:
        # One step of multikey quicksort: the next eight bytes split every group of more than one.
        size = np.bincount(group)
        many = np.flatnonzero(size[group] > 1)
        if not many.size:
            break
        word = np.zeros(len(many), np.uint64)
        at = starts[numbers[many]] + depth
        for j in range(8):
            word = word << U(8)
            if depth + j < length:
                word |= data[at + j].astype(np.uint64)
        by = np.lexsort((word, group[many]))
        numbers[many] = numbers[many][by]
        word = word[by]
        new = np.ones(n, bool)
        new[1:] = group[1:] != group[:-1]
        inside = np.zeros(n, bool)
        inside[many[1:]] = (many[1:] == many[:-1] + 1) & (word[1:] != word[:-1])
        group = np.cumsum(new | inside) - 1
        depth += 8
    if depth < length and n:
        # Groups of a long common prefix: blind tries.
        size = np.bincount(group)
        first = np.cumsum(size) - size
        run = np.zeros(n, bool)
        run[first] = True
        for g in np.flatnonzero(size > 1):
            trie = _BlindTrie()
            a, b = int(first[g]), int(first[g] + size[g])
            for number in numbers[a:b].tolist():
                s = int(starts[number])
                trie.insert(raw[s + depth : s + length], number)
            at = a
            for equal in trie.ordered():
                numbers[at : at + len(equal)] = equal
                run[at] = True
                at += len(equal)
        group = np.cumsum(run) - 1
    return numbers, group


def first_documents(raw: bytes, size: np.ndarray, left: np.ndarray, owner: np.ndarray, mark: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each context, the span around its landmark (start <= 0 and end, relative; 0, 0 if none) that strings of smaller
    owners cover, and the smallest owner that a string of it has. raw: the contexts, one after another; left: bytes before the landmark;
    mark: the landmark's hash, which contexts share."""
    base = np.cumsum(size) - size
    strings = np.clip(np.minimum(size - window + 1, left + 1), 0, None)  # those that begin at or before the landmark and end within the context
    of = np.repeat(np.arange(len(size)), strings)
    back = left[of] - (np.arange(len(of)) - np.repeat(np.cumsum(strings) - strings, strings))
    keep = back <= window - gram
    of, back = of[keep], back[keep]
    starts = base[of] + left[of] - back
    # Strings whose hash is met once among those of this landmark repeat nowhere; the others are sorted as suffixes.
    sums = prefix_sums(np.frombuffer(raw, np.uint8))
    h = _mix(span_hash(sums, starts, starts + window) + mark[of])
    _, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
    more = np.flatnonzero(count[inverse] > 1)
    of, back, starts = of[more], back[more], starts[more]
    lo, ends, first = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64), owner.copy()
    if not len(of):
        return lo, ends, first
    numbers, run = order(raw, starts, window)
    least = np.minimum.reduceat(owner[of[numbers]], np.flatnonzero(np.diff(run, prepend=-1)))
    np.minimum.at(first, of[numbers], least[run])
    covered = np.zeros(len(of), bool)
    covered[numbers] = least[run] < owner[of[numbers]]
    of, back = of[covered], back[covered]
    np.minimum.at(lo, of, -back)
    np.maximum.at(ends, of, window - back)
    return lo, ends, first


# --- parts and hash ranges -------------------------------------------------------------------------------------------


def _blob(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def _arrays(table: pa.Table, column: str, dtype) -> list[np.ndarray]:
    return [np.frombuffer(b, dtype) for b in table.column(column).to_pylist()]


def _joined(parts: list[np.ndarray], dtype) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def _ranges(h: np.ndarray, ranges: int) -> np.ndarray:
    """Of each hash; mixed again, as landmarks are small hashes."""
    return ((_mix(h) >> U(32)) * U(ranges) >> U(32)).astype(np.int64)


def _table(schema: pa.Schema, columns: list) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The spans of data that begin at start, one after another."""
    return data[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


def _first_of(keys: list[np.ndarray], value: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct keys in order, each with its smallest value."""
    return _first_rows(keys, value)[:2]


def _schema(*binary: str) -> pa.Schema:
    return pa.schema([("part", pa.int32()), ("range", pa.int32()), *((n, pa.binary()) for n in binary)])


#: Arrays of equal length in each row. places: how many (see _places). many: in several documents of the part. state: 0, OPEN or HOT.
_HASHES = _schema("marks", "places")
_ENTRIES = _schema("marks", "contexts", "owners", "many", "state")
_SENT = _schema("marks", "contexts", "owners", "left", "size", "hot", "raw")
_SPANS = _schema("contexts", "lo", "hi", "strings", "least")
OPEN, HOT = 1, 2
#: In a byte: whether several documents have a mark, and the power of two that bounds the number of its places.
_SEVERAL = 128


def _first_rows(keys: list[np.ndarray], value: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct keys in order, each with its smallest value, and the row that has it."""
    by = np.lexsort((value, *keys[::-1]))
    new = np.ones(len(by), bool)
    if len(by):
        new[1:] = np.any([k[by][1:] != k[by][:-1] for k in keys], axis=0)
    by = by[new]
    return [k[by] for k in keys], value[by], by


_DDL = {"int32": "int", "binary": "binary", "int64": "long", "string": "string"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"`{f.name}` {_DDL[str(f.type)]}" for f in schema)


def repeated_spans(docs: DataFrame, window: int = 50, gram: int = 26, part_bytes: int = 8 << 20, carry: list[str] | None = None, hot: int = 8000, pass_contexts: int = 8000, cut_out: bool = False) -> DataFrame:
    """One row per document: doc_id, text, rest (a struct of the columns named in carry), and removed: the start and end, in UTF-8 bytes, of its maximal runs of bytes
    that strings of `window` bytes cover which also start in a document with a smaller doc_id. cut_out: text is what they leave of it, and there's no removed;
    that's done where the runs are found, as a further Python step would keep two workers for each task."""
    if not 8 <= gram <= window:
        raise ValueError("a gram has 8 to `window` bytes")
    spark = docs.sparkSession
    common.ship(spark)
    common.small_batches(spark)
    rest = F.struct(*(F.col(c) for c in carry)) if carry else F.lit(None).cast("boolean")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), rest.alias("rest"))
    total = source.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(int(total // part_bytes) + 1, 16)
    ranges = max(parts, 64)
    name = f"gleanery_{uuid.uuid4().hex}"
    source = source.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int"))
    source.repartition(parts, "part").write.bucketBy(parts, "part").option("compression", "zstd").saveAsTable(name, format="parquet")
    common.drop_at_exit(spark, name)
    stored = spark.table(name)
    texts = stored.select("doc_id", "text", "part")

    def read(table: pa.Table) -> tuple[np.ndarray, list[memoryview]]:
        ids = table.column("doc_id").to_pylist()
        return np.array([NULL_ID if i is None else i for i in ids], np.int64), views(table.column("text"))

    def ranged(part: int, schema: pa.Schema, sort_by: np.ndarray, columns: list[np.ndarray], blob: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> pa.Table:
        """A row for each range. blob: data, starts and sizes of spans, the last column."""
        at = _ranges(sort_by, ranges)
        by = np.argsort(at, kind="stable")
        edges = np.searchsorted(at[by], np.arange(ranges + 1))
        full = np.flatnonzero(edges[1:] > edges[:-1])
        rows = [by[edges[r] : edges[r + 1]] for r in full]
        out = [[_blob(c[x]) for x in rows] for c in columns]
        if blob:
            out.append([_blob(_gather(blob[0], blob[1][x], blob[2][x])) for x in rows])
        return _table(schema, [[part] * len(full), full, *out])

    def list_marks(table: pa.Table) -> pa.Table:
        ids, raw = read(table)
        marks, own, count = [], [], []
        for number, _, h, *_ in scan(raw, window, gram):
            by = np.lexsort((ids[number], h))
            h, o = h[by], ids[number][by]
            new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])])) if len(h) else np.zeros(0, np.int64)
            marks.append(h[new])
            own.append(o[new])
            count.append(np.diff(np.append(new, len(h))))
        h, own, count = _joined(marks, np.uint64), _joined(own, np.int64), _joined(count, np.int64)
        kept, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        several = np.zeros(len(kept), bool)
        several[inverse[own != own[first][inverse]]] = True
        places = np.bincount(inverse, count, len(kept))
        return ranged(table.column("part")[0].as_py(), _HASHES, kept, [kept, (np.ceil(np.log2(np.maximum(places, 1))) + _SEVERAL * several).astype(np.uint8)])

    def keep_repeated(table: pa.Table) -> pa.Table:
        marks = _arrays(table, "marks", np.uint64)
        h, places = _joined(marks, np.uint64), _joined(_arrays(table, "places", np.uint8), np.uint8)
        kept, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
        here = count > 1
        here[inverse[places >= _SEVERAL]] = True
        crowded = np.bincount(inverse, np.exp2(places % _SEVERAL), len(kept)) > hot
        sizes = np.cumsum([len(m) for m in marks])[:-1]
        out, state = np.split(here[inverse], sizes), np.split(np.where(crowded, HOT, 0).astype(np.uint8)[inverse], sizes)
        rows = [(p, r, _blob(m[o]), _blob(x[o])) for p, r, m, o, x in zip(table.column("part").to_pylist(), table.column("range").to_pylist(), marks, out, state) if o.any()]
        return _table(_HASHES, list(zip(*rows)) if rows else [[]] * 4)

    def list_contexts(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return _table(_ENTRIES, [[]] * 7)
        ids, raw = read(left)
        repeated, state = _joined(_arrays(right, "marks", np.uint64), np.uint64), _joined(_arrays(right, "places", np.uint8), np.uint8)
        by = np.argsort(repeated)
        repeated, state = repeated[by], state[by]
        marks, contexts, own, crowd = [], [], [], []
        for number, _, h, _, _, c, *_ in scan(raw, window, gram):
            k, keep = _find(repeated, h)
            marks.append(h[keep])
            contexts.append(c[keep])
            own.append(ids[number[keep]])
            crowd.append(state[k[keep]])
        h, c, own, crowd = _joined(marks, np.uint64), _joined(contexts, np.uint64), _joined(own, np.int64), _joined(crowd, np.uint8)
        by = np.lexsort((own, c, h))
        h, c, own, crowd = h[by], c[by], own[by], crowd[by]
        new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])) if len(h) else np.zeros(0, np.int64)
        many = own[new] != own[np.append(new[1:], len(h)) - 1] if len(h) else np.zeros(0, bool)
        h, c, own, crowd = h[new], c[new], own[new], crowd[new]
        return ranged(left.column("part")[0].as_py(), _ENTRIES, np.where(crowd == HOT, c, h), [h, c, own, many, crowd])

    def find_owners(table: pa.Table) -> pa.Table:
        kinds = (("marks", np.uint64), ("contexts", np.uint64), ("owners", np.int64), ("many", bool), ("state", np.uint8))
        columns = [_arrays(table, n, t) for n, t in kinds]
        h, c, own, many, state = (_joined(x, t) for x, (_, t) in zip(columns, kinds))
        (uh, uc), least = _first_of([h, c], own)
        _, inverse, count = np.unique(uh, return_inverse=True, return_counts=True)
        at = _pair_index(uh, uc, h, c)
        least, others = least[at], (count[inverse] > 1)[at]
        state = np.where(own == least, np.where(state == HOT, HOT, np.where(others, OPEN, 0)), 0).astype(np.uint8)
        # Only what a part can use returns to it: an owner that covers something of it, or its own context that isn't decided.
        useful = (least < own) | many | (state > 0)
        sizes = np.cumsum([len(x) for x in columns[0]])[:-1]
        rows = []
        for p, r, keep, *x in zip(table.column("part").to_pylist(), table.column("range").to_pylist(), *(np.split(a, sizes) for a in (useful, h, c, least, many, state))):
            if keep.any():
                rows.append((p, r, *(_blob(a[keep]) for a in x)))
        return _table(_ENTRIES, list(zip(*rows)) if rows else [[]] * 7)

    def send_open(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return _table(_SENT, [[]] * 9)
        ids, raw = read(left)
        c, own, state = _replies(right)
        sent: list[list[np.ndarray]] = [[] for _ in range(7)]

        def send(marks, keys, owner, before, size, crowd, data, start) -> None:
            (keys, crowd), owner, first = _first_rows([keys, crowd], owner)
            for held, x in zip(sent, (marks[first], keys, owner, before[first], size[first], crowd, _gather(data, start[first], size[first]))):
                held.append(x)

        for number, at, h, lo, hi, context, data, start, sums in scan(raw, window, gram):
            k, found = _find(c, context)
            mine = found & (state[k] > 0) & (own[k] == ids[number])
            some = np.flatnonzero(mine & (state[k] == OPEN))
            if some.size:
                send(h[some], context[some], ids[number[some]], (at - lo)[some], (hi - lo)[some], np.zeros(len(some), bool), data, start[some])
            some = np.flatnonzero(mine & (state[k] == HOT))
            if some.size:
                a, z = start[some], (start + hi - lo)[some]
                for back, which, strings in strings_of(a, a + (at - lo)[some], z, sums, window, gram):
                    n = np.full(len(which), window)
                    send(strings, strings, ids[number[some[which]]], np.full(len(which), back), n, np.ones(len(which), bool), data, a[which] + (at - lo)[some[which]] - back)
        marks, keys, owner, before, size, crowd, held = (_joined(x, t) for x, t in zip(sent, (np.uint64, np.uint64, np.int64, np.int64, np.int64, bool, np.uint8)))
        base = np.cumsum(size) - size
        (keys, crowd), owner, first = _first_rows([keys, crowd], owner)
        return ranged(left.column("part")[0].as_py(), _SENT, marks[first], [marks[first], keys, owner, before[first], size[first], crowd], (held, base[first], size[first]))

    def sort_open(table: pa.Table) -> pa.Table:
        kinds = (("marks", np.uint64), ("contexts", np.uint64), ("owners", np.int64), ("left", np.int64), ("size", np.int64), ("hot", bool))
        h, c, owners, before, size, crowd = (_joined(_arrays(table, n, t), t) for n, t in kinds)
        raw = np.frombuffer(b"".join(table.column("raw").to_pylist()), np.uint8)
        base = np.cumsum(size) - size
        lo, hi, least = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64), owners.copy()
        by = np.argsort(h, kind="stable")
        h_sorted, at = h[by], 0
        while at < len(by):  # whole landmarks, in passes of bounded size: a landmark has `hot` places at most
            to = min(len(by), at + pass_contexts)
            if to < len(by):
                to = int(np.searchsorted(h_sorted, h_sorted[to - 1], side="right"))
            some = by[at:to]
            held = _gather(raw, base[some], size[some]).tobytes()
            lo[some], hi[some], least[some] = first_documents(held, size[some], before[some], owners[some], h[some], window, gram)
            at = to
        part = np.repeat(np.array(table.column("part").to_pylist()), [len(x) for x in _arrays(table, "marks", np.uint64)])
        rows = []
        for p in np.unique(part).tolist():
            mine, strings = (part == p) & ~crowd & (hi > lo), (part == p) & crowd
            if mine.any() or strings.any():
                rows.append((p, 0, _blob(c[mine]), _blob(lo[mine]), _blob(hi[mine]), _blob(c[strings]), _blob(least[strings])))
        return _table(_SPANS, list(zip(*rows)) if rows else [[]] * 7)

    result = StructType(
        [stored.schema["doc_id"], stored.schema["text"], stored.schema["rest"]]
        + [StructField("removed", ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())])))]
    )
    if cut_out:
        result = StructType(result.fields[:3])
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, raw = read(left)
        runs: list[list[tuple[int, int]]] = [[] for _ in raw]
        if len(right):
            c, own, state = _replies(right)
            closed = right.filter(pc.is_valid(right.column("lo")))
            sc, s_lo, s_hi, strings, least = (_joined(_arrays(closed, n, t), t) for n, t in (("contexts", np.uint64), ("lo", np.int64), ("hi", np.int64), ("strings", np.uint64), ("least", np.int64)))
            by, of = np.argsort(sc), np.argsort(strings)
            sc, s_lo, s_hi, strings, least = sc[by], s_lo[by], s_hi[by], strings[of], least[of]
            numbers, starts, ends = [], [], []
            for number, at, _, lo, hi, context, _, start, sums in scan(raw, window, gram):
                named = ids[number] != NULL_ID
                k, found = _find(c, context)
                whole = found & (own[k] < ids[number]) & named
                j, some = _find(sc, context)
                some &= ~whole & found & named
                a, b = np.where(whole, lo, 0), np.where(whole, hi, 0)
                if some.any():
                    a[some], b[some] = at[some] + s_lo[j[some]], at[some] + s_hi[j[some]]
                hit = whole | some
                numbers.append(number[hit])
                starts.append(a[hit])
                ends.append(b[hit])
                crowd = np.flatnonzero(found & ~whole & named & (state[k] == HOT))
                if crowd.size:
                    a = start[crowd]
                    for back, which, keys in strings_of(a, a + (at - lo)[crowd], a + (hi - lo)[crowd], sums, window, gram):
                        j, met = _find(strings, keys)
                        which = crowd[which[met & (least[j] < ids[number[crowd[which]]])]]
                        numbers.append(number[which])
                        starts.append(at[which] - back)
                        ends.append(at[which] - back + window)
            n, a, b = (_joined(x, np.int64) for x in (numbers, starts, ends))
            by = np.lexsort((a, n))
            for number, start, end in zip(n[by].tolist(), a[by].tolist(), b[by].tolist()):
                own_runs = runs[number]
                if own_runs and start <= own_runs[-1][1]:
                    own_runs[-1] = (own_runs[-1][0], max(end, own_runs[-1][1]))
                else:
                    own_runs.append((start, end))
        removed = [[{"start": a, "end": b} for a, b in r] for r in runs]
        if cut_out:
            texts = pa.array([_outside(t, r).decode("utf-8", "ignore" if r else "strict") for t, r in zip(raw, removed)], pa.string())
            return pa.table({"doc_id": left.column("doc_id"), "text": texts, "rest": left.column("rest")})
        return pa.table({"doc_id": left.column("doc_id"), "text": left.column("text"), "rest": left.column("rest"), "removed": pa.array(removed, spans_type)})

    def _replies(right: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        entries = right.filter(pc.is_valid(right.column("owners"))) if "lo" in right.column_names else right
        c, own, state = (_joined(_arrays(entries, n, t), t) for n, t in (("contexts", np.uint64), ("owners", np.int64), ("state", np.uint8)))
        by = np.argsort(c)
        return c[by], own[by], state[by]

    by_part = lambda df: df.groupBy("part")
    listed = by_part(texts).applyInArrow(list_marks, _ddl(_HASHES))
    repeated = common.written(listed.groupBy("range").applyInArrow(keep_repeated, _ddl(_HASHES)).select("part", "marks", "places"))
    entries = by_part(texts).cogroup(by_part(repeated)).applyInArrow(list_contexts, _ddl(_ENTRIES))
    owners = common.written(entries.groupBy("range").applyInArrow(find_owners, _ddl(_ENTRIES)).select("part", "contexts", "owners", "state"))
    opened = by_part(texts).cogroup(by_part(owners)).applyInArrow(send_open, _ddl(_SENT))
    spans = common.written(opened.groupBy("range").applyInArrow(sort_open, _ddl(_SPANS)).drop("range"))
    replies = owners.unionByName(spans, allowMissingColumns=True)
    return by_part(stored).cogroup(by_part(replies)).applyInArrow(apply, result)


def _find(sorted_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of x would be, kept inside the array, and whether it's there."""
    if not len(sorted_):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return at, sorted_[at] == x


def _pair_index(uh: np.ndarray, uc: np.ndarray, h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Place of each pair (h, c) among the sorted distinct pairs (uh, uc)."""
    whole = np.lexsort((np.concatenate([np.zeros(len(uh), np.int8), np.ones(len(h), np.int8)]), np.concatenate([uc, c]), np.concatenate([uh, h])))
    rank = np.cumsum(whole < len(uh)) - 1
    out = np.empty(len(h), np.int64)
    mine = whole >= len(uh)
    out[whole[mine] - len(uh)] = rank[mine]
    return out


def kept(text: str, removed: list) -> bytes:
    """What remains of a text, in bytes."""
    return _outside(text.encode(), removed)


def _outside(raw: bytes | memoryview, removed: list) -> bytes:
    out, at = [], 0
    for run in removed:
        out.append(raw[at : run["start"]])
        at = run["end"]
    return b"".join([*out, raw[at:]])


def digest(spans: DataFrame) -> DataFrame:
    common.small_batches(spans.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, runs = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            left = [kept(t, r) for t, r in zip(texts, runs)]
            size = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array([n - len(x) for n, x in zip(size, left)], pa.int64()), pa.array([len(r) for r in runs], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return spans.select("doc_id", "text", "removed").mapInArrow(rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents, repeated strings taken out of their texts; of a character that loses some of its bytes, the others go too.
    n_chars, where there is one, follows. A document with nothing left stays, with an empty text."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = repeated_spans(docs, carry=others, cut_out=True)
    columns = {"doc_id": F.col("doc_id"), "text": F.col("text")} | {c: F.col("rest").getField(c) for c in others}
    if "n_chars" in columns:
        columns["n_chars"] = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*(columns[c].alias(c) for c in docs.columns))


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return digest(repeated_spans(common.table(spark, sf_dir, "documents")))
