"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as the embedding of itself and the embeddings of its character 3- to 5-grams (with marks at its ends), both
hashed. Gated recurrent units read a window of words in either direction; attention weighs their states into one
vector, and a logistic unit scores it. Every overlapping window of a text is scored, and the text has the largest score.

Training knows documents' labels, not which window earns them: it starts from embeddings whose first component is
the log-odds of documents that hold the feature, and in each round takes from every toxic document its best-scored
windows, and from every other document its best-scored and some further ones, all by the model so far.

Scale: training uses a bounded sample of labelled rows (`sample` toxic ones and twice as many others, the first by a hash
of doc_id, of at most `sample_letters` letters a class: a text that doesn't fit what is left is passed over), in one
executor task, and gives a model of fixed size, which is broadcast. Scoring is one pass with no shuffle; a very long text goes through in
pieces of PIECE letters whose windows are those of the whole text, so memory is bounded whatever its length. What a word adds to the gates
depends on its letters alone, so a task computes it once for each word while it keeps the word (KEPT words at most, then it begins anew).

Defined cases: null texts are empty; a text without words is harmless, score 0 and no windows; without a learnable row of both classes
every score is 0; a null doc_id isn't learned from; of several learnable rows of one doc_id the largest text is learned from, with the
largest label; a word of more than LONGEST_WORD letters is several words; repeated rows are scored alike; empty tables give no rows;
other columns are ignored.
"""

from __future__ import annotations

import io
import re
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WORDS, GRAMS = 1 << 16, 1 << 17
DIM, HIDDEN, ATTEND = 8, 10, 10
#: Words of a window, and between the starts of neighbours.
WINDOW, STRIDE = 48, 24
THRESHOLD = 0.3
#: Letters of a text that are read at once, and letters of a word; a piece holds a window at least.
PIECE, LONGEST_WORD = 1 << 17, 1 << 11
#: Words that a task keeps, and letters of them together; one group of texts may go beyond.
KEPT, KEPT_LETTERS = 1 << 16, 1 << 20
_BETWEEN = re.compile(r"[\W_]{2,}")
#: What _word_letters() marks: \w is isalnum() or "_".
_RUN = re.compile(r"[^\W_]+")

_in_word: np.ndarray | None = None


def _word_letters() -> np.ndarray:
    global _in_word
    if _in_word is None:
        _in_word = np.fromiter((chr(c).isalnum() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _in_word


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def _features(lowered: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """features() of a text in lower case, and where each of its letters is."""
    code = np.frombuffer((" " + lowered + "    ").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _word_letters()[code]
    code = np.where(letter, code, 0).astype(np.uint32)
    at = np.flatnonzero(letter)
    if not at.size:
        return np.zeros(0, np.int32), np.zeros((0, 3), np.int32), np.zeros(0, np.int64), at
    start = np.flatnonzero(~letter[at - 1])
    place = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))
    start = np.flatnonzero(place % LONGEST_WORD == 0)
    place %= LONGEST_WORD
    h = code[at - 1] * np.uint32(0x9E3779B1) + code[at] * np.uint32(0x85EBCA77) + code[at + 1] * np.uint32(0xC2B2AE3D)
    grams = np.full((len(at), 3), GRAMS, np.int32)
    grams[:, 0] = _mix(h) % np.uint32(GRAMS)
    h = h * np.uint32(31) + code[at + 2] * np.uint32(0x27D4EB2F) + np.uint32(1)
    more = letter[at + 1]
    grams[more, 1] = (_mix(h) % np.uint32(GRAMS))[more]
    h = h * np.uint32(31) + code[at + 3] * np.uint32(0x165667B1) + np.uint32(1)
    more &= letter[at + 2]
    grams[more, 2] = (_mix(h) % np.uint32(GRAMS))[more]
    words = np.add.reduceat(_mix(code[at] + place.astype(np.uint32) * np.uint32(0x9E3779B1)), start, dtype=np.uint32)
    return (_mix(words) % np.uint32(WORDS)).astype(np.int32), grams, start, at - 1


def features(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each word, classes of the grams around each letter (letters x 3; GRAMS: none), and where each word's letters begin."""
    return _features(text.lower())[:3]


def _read_features(lowered: str) -> tuple[tuple, int, Callable[[int], int]]:
    words, grams, start, place = _features(lowered)
    return (words, grams, start), len(words), lambda k: int(place[start[k]])


def pieces(text: str, read: Callable = _read_features) -> Iterator[tuple[tuple, np.ndarray]]:
    """Features of a text's pieces, and where in each its windows start: together the windows of the whole text. None without words.
    read: gives what is yielded of a piece in lower case, its number of words, and where the k-th of them begins."""
    text = text.lower()
    if len(text) > PIECE:
        text = _BETWEEN.sub(" ", text)
    at = 0
    while True:
        last = at + PIECE >= len(text)
        what, n, begins = read(text[at : at + PIECE])
        if last:
            # What is left after the first piece is covered already up to the overlap.
            starts = np.arange(0, n - STRIDE, STRIDE) if at else windows(n)
            if n and len(starts):
                yield what, starts
            return
        starts = np.arange(0, n - WINDOW, STRIDE)  # the last word may go on in the next piece
        yield what, starts
        at += begins(int(starts[-1]) + STRIDE)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def new_model(seed: int = 11, dtype=np.float32) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    put = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(dtype)
    m = {"word": 0.1 * put(WORDS, DIM) * np.sqrt(WORDS), "gram": 0.1 * put(GRAMS + 1, DIM) * np.sqrt(GRAMS)}
    for side in ("f", "b"):
        m |= {f"x{side}": put(2 * DIM, 3 * HIDDEN), f"u{side}": put(HIDDEN, 3 * HIDDEN), f"c{side}": np.zeros(3 * HIDDEN)}
    m |= {"wa": put(2 * HIDDEN, ATTEND), "ba": np.zeros(ATTEND), "va": put(ATTEND, 1)[:, 0], "wo": put(2 * HIDDEN, 1)[:, 0], "bo": np.zeros(1)}
    m = {k: np.ascontiguousarray(v, dtype) for k, v in m.items()}
    m["gram"][GRAMS] = 0
    return m


def inputs(m: dict, words: np.ndarray, grams: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The vector of each word."""
    if not len(words):
        return np.zeros((0, 2 * DIM), m["word"].dtype)
    size = np.diff(np.append(start, len(grams)))
    letters = m["gram"][grams[:, 0]]
    for k in range(1, grams.shape[1]):
        letters += m["gram"][grams[:, k]]
    chars = np.add.reduceat(letters, start, axis=0) / np.sqrt(size)[:, None].astype(m["word"].dtype)
    return np.concatenate([m["word"][words], chars], axis=1)


def _read(a: np.ndarray, mask: np.ndarray, u: np.ndarray, back: bool, keep: bool) -> tuple[np.ndarray, list]:
    """States of one direction. a: windows x steps x gates; keep: what the way back needs is kept."""
    n, steps = mask.shape
    h = np.zeros((n, HIDDEN), a.dtype)
    out = np.zeros((n, steps, HIDDEN), a.dtype)
    kept = []
    for t in range(steps - 1, -1, -1) if back else range(steps):
        s = h @ u
        gates = _sigmoid(a[:, t, : 2 * HIDDEN] + s[:, : 2 * HIDDEN])
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        c = np.tanh(a[:, t, 2 * HIDDEN :] + r * s[:, 2 * HIDDEN :])
        on = mask[:, t, None]
        if keep:
            kept.append((t, h, z, r, c, s[:, 2 * HIDDEN :]))
        h = h + on * (1 - z) * (c - h)
        out[:, t] = h
    return out, kept


def forward(m: dict, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
    """Logits of windows. x: windows x steps x inputs; mask: 1 where there's a word."""
    f, kf = _read(x @ m["xf"] + m["cf"], mask, m["uf"], False, keep)
    b, kb = _read(x @ m["xb"] + m["cb"], mask, m["ub"], True, keep)
    return _pool(m, f, b, mask, (x, kf, kb))


def _pool(m: dict, f: np.ndarray, b: np.ndarray, mask: np.ndarray, kept: tuple) -> tuple[np.ndarray, tuple]:
    h = np.concatenate([f, b], axis=2)
    t = np.tanh(h @ m["wa"] + m["ba"])
    e = np.where(mask > 0, t @ m["va"], -1e9).astype(h.dtype)
    w = np.exp(e - e.max(axis=1, keepdims=True)) * mask
    w /= np.maximum(w.sum(axis=1, keepdims=True), 1e-9)
    pooled = (w[:, :, None] * h).sum(axis=1)
    return pooled @ m["wo"] + m["bo"][0], (*kept, h, t, w, pooled)


def backward(m: dict, mask: np.ndarray, kept: tuple, d: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the model but its embeddings, and of x. d: gradient of the logits."""
    x, kf, kb, h, t, w, pooled = kept
    g = {"wo": pooled.T @ d, "bo": np.array([d.sum()])}
    dp = d[:, None] * m["wo"]
    dh = w[:, :, None] * dp[:, None, :]
    dw = (h * dp[:, None, :]).sum(axis=2)
    de = w * (dw - (w * dw).sum(axis=1, keepdims=True))
    dt = de[:, :, None] * m["va"] * (1 - t * t)
    g["va"] = np.einsum("nt,nta->a", de, t)
    g["wa"], g["ba"] = np.einsum("nth,nta->ha", h, dt), dt.sum(axis=(0, 1))
    dh = dh + dt @ m["wa"].T
    dx = np.zeros_like(x)
    for side, steps, own in (("f", kf, dh[:, :, :HIDDEN]), ("b", kb, dh[:, :, HIDDEN:])):
        u = m[f"u{side}"]
        da, du = np.zeros((*mask.shape, 3 * HIDDEN), x.dtype), np.zeros_like(u)
        later = np.zeros((len(x), HIDDEN), x.dtype)
        for step, before, z, r, c, s in reversed(steps):
            later = later + own[:, step]
            on = mask[:, step, None]
            dc = later * on * (1 - z) * (1 - c * c)
            dz = -later * on * (c - before) * z * (1 - z)
            dr = dc * s * r * (1 - r)
            ds = np.concatenate([dz, dr, dc * r], axis=1)
            da[:, step] = np.concatenate([dz, dr, dc], axis=1)
            du += before.T @ ds
            later = later * (1 - on * (1 - z)) + ds @ u.T
        g[f"u{side}"], g[f"c{side}"] = du, da.sum(axis=(0, 1))
        g[f"x{side}"] = np.einsum("nti,ntg->ig", x, da)
        dx += da @ m[f"x{side}"].T
    return g, dx


def windows(n: int) -> np.ndarray:
    """Where the overlapping windows of n words start."""
    return np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE) if n > WINDOW else np.zeros(1, np.int64)


def text_logits(m: dict, data: list[tuple], batch: int = 1024, starts: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """Logits of windows of each text, given its features; what neighbours share is computed once. starts: of the windows; all of the
    text's overlapping ones, if not given."""
    parts = [inputs(m, *d) for d in data]
    size = np.array([len(x) for x in parts])
    x = np.concatenate([*parts, np.zeros((1, 2 * DIM), np.float32)])
    return _gated_logits(m, *_gates(m, x), np.arange(len(x)), size, starts or [windows(n) for n in size], batch)


def _gates(m: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the vectors of words add to the gates, of either direction."""
    return x @ m["xf"] + m["cf"], x @ m["xb"] + m["cb"]


def _gated_logits(m: dict, af: np.ndarray, ab: np.ndarray, rows: np.ndarray, size: np.ndarray, starts: list[np.ndarray], batch: int = 1024) -> list[np.ndarray]:
    """Logits of windows of each text. af, ab: gates; rows: those of the words of all texts in order, and one of no word; size: words of each text."""
    base = np.cumsum(size) - size
    count = np.array([len(s) for s in starts])
    begin, end = np.concatenate([s + b for s, b in zip(starts, base)]), np.repeat(base + size, count)
    out = np.zeros(len(begin), np.float32)
    steps = np.arange(WINDOW)
    for k in range(0, len(begin), batch):
        at = begin[k : k + batch, None] + steps
        mask = (at < end[k : k + batch, None]).astype(np.float32)
        at = rows[np.where(mask > 0, at, len(rows) - 1)]
        f, _ = _read(af[at], mask, m["uf"], False, False)
        b, _ = _read(ab[at], mask, m["ub"], True, False)
        out[k : k + batch] = _pool(m, f, b, mask, ())[0]
    return np.split(out, np.cumsum(count)[:-1])


def _log_odds(seen: list[np.ndarray], toxic: np.ndarray, classes: int) -> np.ndarray:
    """By documents that hold a class; drawn towards 0 where few do."""
    n = [np.full(classes, 0.5), np.full(classes, 0.5)]
    for own, y in zip(seen, toxic):
        n[int(y)][np.unique(own)] += 1
    total = [max(1, int((toxic == y).sum())) for y in (0, 1)]
    odds = np.log(n[1] / (total[1] + 1)) - np.log(n[0] / (total[0] + 1))
    held = n[0] + n[1] - 1
    return np.clip(odds * held / (held + 4), -3, 3) * (held > 0)


def gathered(texts: list[str]) -> list[tuple]:
    """Features of texts, as views of three arrays."""
    texts = [t.lower() for t in texts]
    room = sum(map(len, texts))
    words, grams, start = np.empty(room, np.int32), np.empty((room, 3), np.int32), np.empty(room, np.int32)
    out, w, g = [], 0, 0
    for k, t in enumerate(texts):
        own = _features(t)
        n, letters = len(own[0]), len(own[1])
        words[w : w + n], grams[g : g + letters], start[w : w + n] = own[:3]
        out.append((words[w : w + n], grams[g : g + letters], start[w : w + n]))
        w, g, texts[k] = w + n, g + letters, ""
    return out


def train(texts: list[str], toxic: np.ndarray, rounds: int | None = None, batch: int = 128, rate: float = 6e-3, seed: int = 11) -> dict[str, np.ndarray]:
    """The model learned from texts and their labels; rounds over few texts are more."""
    rounds = rounds or int(np.clip(12_000 // max(1, len(texts)), 6, 16))
    rng = np.random.default_rng(seed)
    m = new_model(seed)
    data = gathered(texts)
    m["word"][:, 0] = _log_odds([d[0] for d in data], toxic, WORDS)
    m["gram"][:GRAMS, 0] = _log_odds([d[1][d[1] < GRAMS] for d in data], toxic, GRAMS)
    m["xf"][0] = np.abs(m["xf"][0])
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in m.items()}
    step = 0
    for number in range(rounds):
        if number % 2:  # scores serve two rounds
            scores = [x for a in range(0, len(data), 50) for x in text_logits(m, data[a : a + 50])]
        # Windows of this round: (document, start, label).
        chosen: list[tuple[int, int, float]] = []
        for k, (words, grams, start) in enumerate(data):
            at = windows(len(words))
            if number == 0:
                odds = m["word"][words, 0] if len(words) else np.zeros(1)
                score = np.array([np.sort(odds[s : s + WINDOW])[-3:].sum() for s in at])
            else:
                score = scores[k]
            by = np.argsort(-score, kind="stable")
            if toxic[k]:
                chosen += [(k, int(at[j]), 1.0) for j in by[: 1 + (len(at) > 4)]]
            else:
                chosen += [(k, int(at[j]), 0.0) for j in {int(by[0]), int(by[min(1, len(by) - 1)]), int(rng.integers(len(at)))}]
        order = rng.permutation(len(chosen))
        for a in range(0, len(order), batch):
            some = [chosen[j] for j in order[a : a + batch]]
            step += 1
            _update(m, state, data, some, rate * (0.5 if number >= rounds - 2 else 1.0), step)
    return m


def _slice(data: tuple, a: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words, grams, start = data
    b = min(len(words), a + WINDOW)
    if a >= b:
        return words[:0], grams[:0], start[:0]
    lo, hi = start[a], start[b] if b < len(words) else len(grams)
    return words[a:b], grams[lo:hi], start[a:b] - lo


def _update(m: dict, state: dict, data: list, some: list[tuple[int, int, float]], rate: float, step: int) -> None:
    """One step of Adam on a batch of windows."""
    parts = [_slice(data[k], a) for k, a, _ in some]
    size = np.array([len(p[0]) for p in parts])
    words, grams = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    letters = np.array([len(p[1]) for p in parts])
    start = np.concatenate([p[2] + s for p, s in zip(parts, np.cumsum(letters) - letters)])
    flat = inputs(m, words, grams, start)
    mask = (np.arange(WINDOW) < size[:, None]).astype(np.float32)
    x = np.zeros((len(some), WINDOW, 2 * DIM), np.float32)
    x[mask > 0] = flat
    logit, kept = forward(m, x, mask, keep=True)
    y = np.array([label for _, _, label in some], np.float32)
    g, dx = backward(m, mask, kept, (_sigmoid(logit) - y) / len(some))
    dflat = dx[mask > 0]
    words_met, words_at = np.unique(words, return_inverse=True)
    grams_met, grams_at = np.unique(grams, return_inverse=True)
    if len(words):
        g["word"] = np.zeros((len(words_met), DIM), np.float32)
        np.add.at(g["word"], words_at, dflat[:, :DIM])
        per = np.diff(np.append(start, len(grams)))
        dgram = np.repeat(dflat[:, DIM:] / np.sqrt(per)[:, None], per, axis=0).astype(np.float32)
        g["gram"] = np.zeros((len(grams_met), DIM), np.float32)
        for own in grams_at.reshape(grams.shape).T:
            np.add.at(g["gram"], own, dgram)
        g["gram"][grams_met == GRAMS] = 0
    for k, grad in g.items():
        one, two = state[k]
        rows = {"word": words_met, "gram": grams_met}.get(k, slice(None))
        grad = np.clip(grad, -1, 1)
        one[rows] = 0.9 * one[rows] + 0.1 * grad
        two[rows] = 0.999 * two[rows] + 0.001 * grad * grad
        m[k][rows] -= (rate * (one[rows] / (1 - 0.9**step)) / (np.sqrt(two[rows] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)


def _packed(model: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **model)
    return out.getvalue()


def fit(docs: DataFrame, labels: DataFrame, sample: int = 1500, sample_letters: int = 12 << 20) -> dict[str, np.ndarray] | None:
    """The model, from at most `sample` toxic documents and twice as many others, or None without both. docs: rows that may be learned from.
    sample_letters: of the texts of either class together."""
    common.ship(docs.sparkSession)
    common.small_batches(docs.sparkSession)
    known = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.join(docs.select("doc_id").where("doc_id is not null").distinct(), "doc_id", "left_semi")
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic", F.xxhash64("doc_id").alias("draw"))
    drawn = [known.where(F.col("toxic") == y).orderBy("draw", "doc_id").limit(sample * (2 - y)) for y in (0, 1)]
    wanted = common.written(drawn[0].unionByName(drawn[1]))
    rows = common.documents(docs).join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "toxic", "draw").agg(F.max("text").alias("text"))  # 3 x sample rows at most

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, room = [], [sample_letters] * 2
        for batch in batches:  # in the order of the draw
            for doc, y, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "toxic", "text"))):
                if len(text or "") <= room[y]:
                    room[y] -= len(text or "")
                    own.append((doc, y, text or ""))
        own.sort()
        if len({y for _, y, _ in own}) == 2:
            toxic = np.array([y for _, y, _ in own])
            model = train([t for _, _, t in own], toxic)
            yield pa.RecordBatch.from_arrays([pa.array([_packed(model)], pa.binary())], names=["model"])

    found = rows.coalesce(1).sortWithinPartitions("draw", "doc_id").select("doc_id", "toxic", "text").mapInArrow(learn, "model binary").collect()  # one row of fixed size
    return dict(np.load(io.BytesIO(found[0].model))) if found else None


class _Numbers(dict):
    """Numbers of words, from 1; new: the words that were met since it was last emptied."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = n = len(self) + 1
        return n


class Scorer:
    """Scores texts; keeps what the words met add to the gates."""

    def __init__(self, m: dict | None) -> None:
        self.m, self.held = m, 0  # held: letters and what is between them, of the group
        self._empty()

    def _empty(self) -> None:
        self.numbers, self.letters = _Numbers(), 0
        if self.m:
            self.af, self.ab = _gates(self.m, np.zeros((1, 2 * DIM), np.float32))  # no word

    def _read(self, lowered: str) -> tuple[np.ndarray | tuple, int, Callable[[int], int]]:
        """For pieces(): numbers of the words, or their features where a word is one only of several in a run of letters."""
        self.held += len(lowered)
        runs = _RUN.findall(lowered)
        if runs and len(max(runs, key=len)) > LONGEST_WORD:
            return _read_features(lowered)
        numbers = np.fromiter(map(self.numbers.__getitem__, runs), np.int32, len(runs))
        return numbers, len(numbers), lambda k: next(islice(_RUN.finditer(lowered), k, None)).start()

    def _learn(self) -> None:
        """Gates of the new words."""
        new = self.numbers.new
        if not new:
            return
        for mine, more in zip(("af", "ab"), _gates(self.m, inputs(self.m, *_features(" ".join(new))[:3]))):
            held, n = getattr(self, mine), len(self.numbers) + 1
            if n > len(held):
                setattr(self, mine, held := np.concatenate([held, np.empty((max(n, 2 * len(held)) - len(held), held.shape[1]), held.dtype)]))
            held[n - len(new) : n] = more
        self.letters += sum(map(len, new))
        new.clear()

    def _logits(self, group: list[tuple[int, np.ndarray | tuple, np.ndarray]]) -> Iterator[tuple[int, np.ndarray]]:
        self._learn()
        for kind, logits in (
            (tuple, lambda data, starts: text_logits(self.m, data, starts=starts)),
            (np.ndarray, lambda data, starts: _gated_logits(self.m, self.af, self.ab, np.concatenate([*data, np.zeros(1, np.int32)]), np.array([len(d) for d in data]), starts)),
        ):
            own = [g for g in group if isinstance(g[1], kind)]
            if own:
                yield from zip([k for k, _, _ in own], logits([d for _, d, _ in own], [s for _, _, s in own]))
        if len(self.numbers) > KEPT or self.letters > KEPT_LETTERS:
            self._empty()

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Score and number of windows of each text."""
        best, count = np.full(len(texts), -np.inf), np.zeros(len(texts), np.int64)
        group: list[tuple[int, np.ndarray | tuple, np.ndarray]] = []

        def through() -> None:
            for k, x in self._logits(group):
                best[k], count[k] = max(best[k], x.max()), count[k] + len(x)
            group.clear()
            self.held = 0

        for k, text in enumerate(texts if self.m else []):
            for data, starts in pieces(text or "", self._read):
                group.append((k, data, starts))
                if self.held >= PIECE:
                    through()
        through()
        return np.where(np.isfinite(best), 1 / (1 + np.exp(-np.clip(best, -500, 500))), 0.0), count


def score(docs: DataFrame, model: dict[str, np.ndarray] | None) -> DataFrame:
    """doc_id, score, and n_windows: how many overlapping windows were scored."""
    spark = docs.sparkSession
    common.ship(spark)
    common.small_batches(spark)
    sent = spark.sparkContext.broadcast(model)  # of fixed size

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = Scorer(sent.value)
        for batch in batches:
            value, count = scored(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value, pa.float64()), pa.array(count, pa.int64())], names=["doc_id", "score", "n_windows"])

    return common.documents(docs).mapInArrow(rows, "doc_id long, score double, n_windows long")


def harmless(docs: DataFrame, model: dict[str, np.ndarray] | None, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, whole."""
    spark = docs.sparkSession
    common.ship(spark)
    common.small_batches(spark)
    sent, at = spark.sparkContext.broadcast(model), docs.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = Scorer(sent.value)
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(scored(batch.column(at).to_pylist())[0] < threshold))

    return docs.mapInArrow(rows, docs.schema)


def op4_recurrent_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs.where(~common.held_out()), common.table(spark, sf_dir, "labels"))
    out = score(docs, model)
    return out.select("doc_id", common.held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_windows")
