"""Language identification as inference over a mixture of languages.

Learning: character trigrams of whole words (with a mark at either end) are counted for each language over every
learnable document. A word's likelihood in a language is the product of its trigrams' smoothed frequencies there.

Prediction: a document is a mixture of languages with unknown proportions, its words drawn independently.
Expectation-maximisation finds the proportions, first with all languages. Nested language sets (the k largest
proportions, k from 1) are then fitted again, and the one with the best penalised likelihood (half a logarithm of the
number of words for each language beyond the first) is the document's set. The prediction is the language of the largest
proportion in it, the score that proportion.

Scale: learning and prediction are one pass each with no shuffle of text; learning sends the driver a table of counts
of fixed size for each language, summed on the executors. Texts are cut at word ends into bounded pieces, so a very long text
needs memory for its words' likelihoods only.

Defined cases: null texts and texts without a letter are "und" with score 0; so is every document if nothing can be
learned from; ties go to the language first in order; rows with a null doc_id are learned from; repeated rows
count as often as they occur; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Trigrams are hashed into this many classes.
CLASSES = 1 << 16
#: Code points of one numeric pass.
PIECE = 1 << 19

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Class of the trigram around each letter, and where each word's letters begin among them."""
    code = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _is_letter()[code]
    code = np.where(letter, code, 0).astype(np.uint32)
    at = np.flatnonzero(letter)
    mixed = (code[at - 1] * np.uint32(0x9E3779B1)) ^ (code[at] * np.uint32(0x85EBCA6B)) ^ ((code[at + 1] + np.uint32(7)) * np.uint32(0xC2B2AE35))
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    mixed ^= mixed >> np.uint32(13)
    return mixed % np.uint32(CLASSES), np.flatnonzero(~letter[at - 1])


def pieces(text: str) -> Iterator[str]:
    """The text in parts of bounded length, cut between words (a word beyond the bound is cut too)."""
    start = 0
    while len(text) - start > PIECE:
        end = start + PIECE
        while end > start + PIECE // 2 and text[end - 1].isalpha():
            end -= 1
        yield text[start:end]
        start = end
    yield text[start:]


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the smoothed logarithm of each class's frequency in each."""
    spark = docs.sparkSession
    common.ship(spark)
    common.small_batches(spark)
    learnable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("text").cast("string"), F.col("lang").cast("string"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = total.setdefault(lang, np.zeros(CLASSES, dtype=np.int64))
                for part in pieces(text):
                    own += np.bincount(trigrams(part)[0], minlength=CLASSES)
        for lang, own in total.items():
            seen = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.array(own[seen], pa.int64())], names=["lang", "class", "n"])

    counted = learnable.mapInArrow(count, "lang string, class int, n long").groupBy("lang", "class").agg(F.sum("n").alias("n"))
    got = counted.toPandas()
    langs = sorted(got["lang"].unique())
    table = np.zeros((len(langs), CLASSES))
    for k, lang in enumerate(langs):
        own = got[got["lang"] == lang]
        table[k, own["class"].to_numpy()] = own["n"].to_numpy()
    table += 0.5
    return langs, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def _rising(like: np.ndarray, doc: np.ndarray, starts: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions by expectation-maximisation and the log-likelihood. like: words x languages; share: documents x languages."""
    for k in range(rounds + 1):
        joint = like * share[doc]
        whole = joint.sum(axis=1)
        if k == rounds:
            return share, np.add.reduceat(np.log(np.maximum(whole, 1e-300)), starts)
        joint /= np.maximum(whole, 1e-300)[:, None]
        share = np.add.reduceat(joint, starts, axis=0)
        share /= share.sum(axis=1, keepdims=True)


def infer(words: list[np.ndarray], rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """words: for each document with any, its words' log-likelihoods by language. Proportions of the language set that
    penalised likelihood selects, and the best one's place."""
    sizes = np.array([len(w) for w in words])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    logs = np.concatenate(words).astype(np.float64)
    top = logs.max(axis=1, keepdims=True)
    like = np.exp(logs - top)
    doc = np.repeat(np.arange(len(words)), sizes)
    n, k = logs.shape[1], len(words)
    alone = np.add.reduceat(logs - top, starts, axis=0)
    best_one = alone.argmax(axis=1)
    chosen = np.zeros((k, n))
    chosen[np.arange(k), best_one] = 1.0
    value = alone.max(axis=1)
    if n == 1:
        return chosen, best_one
    share, upper = _rising(like, doc, starts, np.full((k, n), 1.0 / n), rounds)
    penalty = 0.5 * np.log(np.maximum(sizes, 2))
    order = np.argsort(-share, axis=1, kind="stable")
    # A set of m languages can't beat all of them; documents where even that bound loses are settled.
    for m in range(2, n + 1):
        open_ = np.flatnonzero(upper + 1e-9 - (m - 1) * penalty > value)
        if not open_.size:
            break
        rows = np.concatenate([np.arange(starts[d], starts[d] + sizes[d]) for d in open_])
        begin = np.zeros((len(open_), n))
        np.put_along_axis(begin, order[open_, :m], 1.0, axis=1)
        begin = np.where(begin > 0, np.maximum(share[open_], 1e-6), 0.0)
        begin /= begin.sum(axis=1, keepdims=True)
        own_doc = np.repeat(np.arange(len(open_)), sizes[open_])
        own_starts = np.concatenate([[0], np.cumsum(sizes[open_])[:-1]])
        fitted, reached = _rising(like[rows], own_doc, own_starts, begin, rounds)
        better = reached - (m - 1) * penalty[open_] > value[open_]
        value[open_[better]] = (reached - (m - 1) * penalty[open_])[better]
        chosen[open_[better]] = fitted[better]
    return chosen, chosen.argmax(axis=1)


def predict(docs: DataFrame, langs: list[str], logs: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score, and the mixture: the selected languages and their proportions."""
    spark = docs.sparkSession
    common.ship(spark)
    common.small_batches(spark)
    model = spark.sparkContext.broadcast((langs, np.ascontiguousarray(logs.T)))  # CLASSES x languages: of fixed size

    def word_logs(text: str, table: np.ndarray) -> np.ndarray:
        out = []
        for part in pieces(text):
            classes, starts = trigrams(part)
            if len(starts):
                out.append(np.add.reduceat(table[classes], starts, axis=0))
        return np.concatenate(out) if out else np.zeros((0, table.shape[1]), np.float32)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = model.value
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            pred, score, mixture = ["und"] * len(ids), [0.0] * len(ids), [{} for _ in ids]
            at, words, held = [], [], 0

            def settle() -> None:
                if at:
                    shares, best = infer(words)
                    for k, share, b in zip(at, shares, best):
                        pred[k], score[k] = names[b], float(min(1.0, share[b]))
                        mixture[k] = {names[j]: float(share[j]) for j in np.flatnonzero(share > 0)}

            if names:
                for k, text in enumerate(texts):
                    logs_k = word_logs(text, table) if text else np.zeros((0, len(names)))
                    if len(logs_k):
                        at.append(k)
                        words.append(logs_k)
                        held += len(logs_k)
                    if held > 200_000:
                        settle()
                        at, words, held = [], [], 0
                settle()
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array([list(m.items()) for m in mixture], pa.map_(pa.string(), pa.float64()))],
                names=["doc_id", "lang_pred", "score", "mixture"],
            )

    return common.documents(docs).mapInArrow(rows, "doc_id long, lang_pred string, score double, mixture map<string,double>")


def op7_language_mixture(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    langs, logs = fit(docs.where(~common.held_out()))
    out = predict(docs, langs, logs)
    return out.select("doc_id", common.held_out().alias("held_out"), "lang_pred", "score", "mixture")
