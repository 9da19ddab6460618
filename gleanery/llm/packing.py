"""Best-fit packing of documents into fixed-length training sequences.

A document becomes its token ids and an end mark. Only documents longer than a sequence are cut: into whole
sequences, the first piece taking what is over. Pieces meet sequences as vectors of three demands (tokens,
documents, attention cost, the last the square of the length); a sequence has a residual capacity in each. Pieces go
longest first into the open sequence whose residual after placing has the smallest weighted norm among those that
hold the piece under every constraint ("norm"), or whose residual has the largest weighted dot-product with the
demand ("dot"); if none holds it, a new one opens.

Scale: a task packs its own partition as a stream, in blocks of bounded size; sequences that a block leaves
unfilled stay open for the next. What the partitions leave unfilled at their ends is packed again in a second pass over
those few pieces, in tasks of `pass_tokens` each, so waste doesn't grow with the number of partitions. No task keeps more than `max_open`
sequences open: beyond that the fullest go to the second pass, and there are closed. There's no shuffle of documents and none by key:
a hot source or group of copies changes nothing.

Defined cases: a null text is empty and has the end mark alone; empty tables give no rows; equal documents are packed
one by one; other columns are ignored; null doc_ids are packed like others.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

END_ID = 0

#: A run of white space: only there does the pre-tokenizer's look-ahead matter.
_RUN = re.compile(r"\s\s")

#: Encoded by both libraries when a task begins; they must agree on it.
_PROBE = "A probe,  of 12 words;\n\n it's half-done?\u00e9\u4e2d\U0001f600 <|endoftext|> end\n"


class Encoder:
    """Token ids of texts as the tokenizers library gives them, special tokens in a text included.

    The merges run over the ranks file, which holds the same vocabulary as the tokenizer file at a fifth of the time; a
    probe text must come out alike in both. Texts without a run of white space take a pattern without look-ahead.
    """

    def __init__(self, path: str, ranks: str) -> None:
        import base64
        import json

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(path) as f:
            special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        full = public_tokenizers.PATTERN
        self.full, self.plain = (
            tiktoken.Encoding("ranks", pat_str=p, mergeable_ranks=table, special_tokens={}).encode_ordinary
            for p in (full, full.replace(r"\s+(?!\S)|", ""))
        )
        # Special tokens are looked for before the text is split; few texts have one.
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)").search
        marked = tiktoken.Encoding("marked", pat_str=full, mergeable_ranks=table, special_tokens=special)
        self.marked = lambda text: marked.encode(text, allowed_special="all")
        tokenizer = Tokenizer.from_file(path)
        if tokenizer.encode(_PROBE, add_special_tokens=False).ids != self.marked(_PROBE):
            raise ValueError(f"{ranks} is not the vocabulary of {path}")

    def __call__(self, text: str) -> bytes:
        """Unsigned 32-bit ids, little-endian."""
        ids = array("I", (self.marked if self.special(text) else self.full if _RUN.search(text) else self.plain)(text))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, ranks: str) -> Encoder:
    if (path, ranks) not in _encoders:
        _encoders[path, ranks] = Encoder(path, ranks)
    return _encoders[path, ranks]


def cut(length: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of each piece; the first is the one that may be shorter."""
    if length <= limit:
        return [(0, length)]
    first = length % limit
    edges = ([0] if first else []) + list(range(first, length + 1, limit))
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


class Packer:
    """Vector best-fit over open sequences; one per task."""

    def __init__(self, capacity: tuple[float, float, float], weights: tuple[float, float, float], rule: str) -> None:
        self.capacity = np.array(capacity, dtype=np.float64)
        self.weights = np.array(weights, dtype=np.float64)
        if rule not in ("norm", "dot"):
            raise ValueError(f"unknown rule {rule!r}")
        self.rule = rule
        self.bins: list[list] = []
        self.residual = np.zeros((0, 3))

    def demands(self, lengths: np.ndarray) -> np.ndarray:
        return np.stack([lengths, np.ones_like(lengths), lengths * lengths], axis=1)

    def add(self, pieces: list) -> None:
        """Place pieces, each a tuple that begins with its length. A piece beyond a capacity even alone gets its own."""
        pieces = sorted(pieces, key=lambda p: -p[0])
        demand = self.demands(np.array([p[0] for p in pieces], dtype=np.float64)) if pieces else np.zeros((0, 3))
        room = np.zeros((len(self.bins) + len(pieces), 3))
        room[: len(self.bins)] = self.residual
        count, scale = len(self.bins), self.weights / self.capacity**2
        for piece, need in zip(pieces, demand):
            fits = np.flatnonzero((room[:count, 0] >= need[0]) & (room[:count, 1] >= need[1]) & (room[:count, 2] >= need[2]))
            if fits.size:
                if self.rule == "norm":
                    best = fits[np.argmin(((room[fits] - need) ** 2) @ scale)]
                else:
                    best = fits[np.argmax(room[fits] @ (scale * need))]
                self.bins[best].append(piece)
                room[best] -= need
            else:
                self.bins.append([piece])
                room[count] = self.capacity - need
                count += 1
        self.residual = room[:count]

    def take(self, fill: float) -> list[list]:
        """Remove and return the sequences filled to this part of their tokens."""
        return self._remove(self.residual[:, 0] <= (1 - fill) * self.capacity[0])

    def fullest(self, most: int) -> list[list]:
        """Remove and return the fullest sequences beyond `most`."""
        full = np.zeros(len(self.bins), bool)
        full[np.argsort(self.residual[:, 0], kind="stable")[: max(0, len(self.bins) - most)]] = True
        return self._remove(full)

    def _remove(self, full: np.ndarray) -> list[list]:
        out = [b for b, f in zip(self.bins, full) if f]
        self.bins = [b for b, f in zip(self.bins, full) if not f]
        self.residual = self.residual[~full]
        return out


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    ranks: str | None = None,
    length: int = 2048,
    max_documents: int | None = None,
    max_attention: float | None = None,
    rule: str = "norm",
    weights: tuple[float, float, float] = (1.0, 1e-4, 1e-4),
    block_tokens: int = 3 << 20,
    pass_tokens: int = 16 << 20,
    max_open: int = 4096,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and the ids themselves.

    length, max_documents and max_attention (sum of squared lengths) are what a sequence holds; the defaults of the
    last two bind nothing. block_tokens bounds what a task holds before it packs, max_open the sequences that it then keeps open, and
    pass_tokens what a task of the second pass reads.
    """
    spark = docs.sparkSession
    common.ship(spark)
    common.small_batches(spark)
    tokenizer = tokenizer or common.tokenizer_path("byte_bpe_50k.json")
    ranks = ranks or common.tokenizer_path("byte_bpe_50k.tiktoken")
    capacity = (float(length), float(max_documents or length), float(max_attention or length * length))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, `offset` long" + (", ids binary" if with_ids else "")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + (["ids"] if with_ids else [])
    arrow = pa.schema([pa.field(n, pa.binary() if n == "ids" else pa.int32() if n == "piece" else pa.int64()) for n in names])

    def emit(bins: list[list], number) -> Iterator[pa.RecordBatch]:
        """number: gives the next sequence id, or None for what is packed later."""
        rows: list[tuple] = []
        for b in bins:
            sequence, at = number(), 0
            for piece in b:
                n, doc, k, start, crc, *ids = piece
                rows.append((doc, k, start, n, crc, sequence, at, *ids))
                at += n
            if len(rows) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    def counter(stage: int):
        state = [(stage << 62) + (TaskContext.get().partitionId() << 36)]

        def following() -> int:
            state[0] += 1
            return state[0]

        return following

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, following = encoder(tokenizer, ranks), Packer(capacity, weights, rule), counter(0)
        pending, held = [], 0
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            whole: list[list] = []
            for doc, text in zip(doc_ids, texts):
                ids = encode(text) + b"\0\0\0\0"
                for k, (start, n) in enumerate(cut(len(ids) // 4, length)):
                    part = ids[4 * start : 4 * (start + n)]
                    piece = (n, doc, k, start, zlib.crc32(part), part) if with_ids else (n, doc, k, start, zlib.crc32(part))
                    if n == length and n * n <= capacity[2]:
                        whole.append([piece])
                    else:
                        pending.append(piece)
                        held += n
            yield from emit(whole, following)
            if held >= block_tokens:
                packer.add(pending)
                yield from emit(packer.take(0.95), following)
                yield from emit(packer.fullest(max_open), lambda: None)
                pending, held = [], sum(p[0] for b in packer.bins for p in b) // 2
        packer.add(pending)
        yield from emit(packer.take(0.99), following)
        yield from emit(packer.bins, lambda: None)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, following = Packer(capacity, weights, rule), counter(1)
        pending, held = [], 0
        for batch in batches:
            cols = batch.to_pydict()
            for row in zip(*(cols[n] for n in ["length", "doc_id", "piece", "start", "ids_crc32"] + (["ids"] if with_ids else []))):
                pending.append(row)
                held += row[0]
            if held >= block_tokens:
                packer.add(pending)
                yield from emit(packer.take(0.95) + packer.fullest(max_open), following)
                pending, held = [], sum(p[0] for b in packer.bins for p in b) // 2
        packer.add(pending)
        yield from emit(packer.bins, following)

    source = common.documents(docs)
    once = common.written(source.mapInArrow(first, schema))
    done = once.where("sequence_id is not null")
    rest = once.where("sequence_id is null")
    tasks = int((rest.agg(F.sum("length")).first()[0] or 0) // pass_tokens) + 1
    rest = rest.repartition(tasks).mapInArrow(second, schema)
    return done.unionByName(rest)


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"), with_ids=False)
