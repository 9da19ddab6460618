import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from gleanery.llm import common, packing


def test_cut():
    assert packing.cut(5, 8) == [(0, 5)] and packing.cut(16, 8) == [(0, 8), (8, 8)] and packing.cut(19, 8) == [(0, 3), (3, 8), (11, 8)]


def test_encoder_equals_the_tokenizers_library(spark, sf_dir):
    path = common.tokenizer_path("byte_bpe_50k.json")
    ours, theirs = packing.encoder(path, common.tokenizer_path("byte_bpe_50k.tiktoken")), Tokenizer.from_file(path)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    texts += ["", " ", "a\tb  c \n\n d's don't", "x  ", "\n\n", "<|endoftext|>", "a <|endoftext|> b", "x  <|endoftext|><|endoftext|>\n <|endoftext", "é　 x  y", "a \x1c\x1cb", "1 2  3 $$ a\r\n b", "z" * 5000]
    for t in texts:
        assert np.frombuffer(ours(t), "<u4").tolist() == theirs.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_no_constraint_is_broken(rule):
    rng = np.random.default_rng(1)
    p = packing.Packer((100, 3, 4000), (1, 0.1, 0.1), rule)
    for _ in range(3):
        p.add([(int(n),) for n in rng.integers(1, 64, 200)])
    assert sum(map(len, p.bins)) == 600
    for b in p.bins:
        n = [x[0] for x in b]
        assert len(n) == 1 or sum(n) <= 100 and len(n) <= 3 and sum(x * x for x in n) <= 4000


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_pieces_go_where_a_plain_best_fit_puts_them(rule):
    rng, capacity, weights = np.random.default_rng(5), (100.0, 4.0, 5000.0), (1.0, 0.3, 0.2)
    lengths = [int(n) for n in rng.integers(1, 90, 300)]
    p = packing.Packer(capacity, weights, rule)
    p.add([(n, k) for k, n in enumerate(lengths)])
    bins, rooms = [], []
    for n, k in sorted(((n, k) for k, n in enumerate(lengths)), key=lambda x: -x[0]):
        need = (n, 1, n * n)

        def merit(room):
            if rule == "norm":
                return -sum(w * ((r - d) / c) ** 2 for r, d, w, c in zip(room, need, weights, capacity))
            return sum(w * r * d / c**2 for r, d, w, c in zip(room, need, weights, capacity))

        fits = [b for b, room in enumerate(rooms) if all(r >= d for r, d in zip(room, need))]
        best = max(fits, key=lambda b: (round(merit(rooms[b]), 9), -b), default=None)
        if best is None:
            best = len(bins)
            bins.append([])
            rooms.append(capacity)
        bins[best].append((n, k))
        rooms[best] = tuple(r - d for r, d in zip(rooms[best], need))
    assert p.bins == bins


def test_open_sequences_are_bounded(spark):
    docs = spark.createDataFrame([(k, "word " * (1100 + k % 7)) for k in range(300)] + [(k, "word " * 40) for k in range(300, 400)], "doc_id long, text string")
    rows = packing.pack(docs.coalesce(2), with_ids=False, block_tokens=20_000, max_open=10, pass_tokens=100_000).collect()
    assert len({r.doc_id for r in rows}) == 400 and all(r.sequence_id is not None for r in rows)
    assert len({r.sequence_id for r in rows}) <= 330


def test_pieces_lie_gapless_and_few(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, 1), (None, "a b", 2), (10**6 + 1, "", 3), (10**6 + 1, "", 3)], "doc_id long, text string, piece int")
    both = docs.select("doc_id", "text").withColumn("piece", docs.doc_id.cast("int")).unionByName(odd)
    rows = packing.pack(both, length=512).collect()
    bins = {}
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 512
    assert len(bins) <= 1.01 * sum(r.length for r in rows) / 512 + 2
    whole = {}
    for r in sorted((r for r in rows if r.doc_id not in (None, 10**6 + 1)), key=lambda r: r.start):
        assert r.start == len(whole.get(r.doc_id, b"")) // 4
        whole[r.doc_id] = whole.get(r.doc_id, b"") + r.ids
    encode = packing.encoder(common.tokenizer_path("byte_bpe_50k.json"), common.tokenizer_path("byte_bpe_50k.tiktoken"))
    assert whole == {r.doc_id: encode(r.text or "") + bytes(4) for r in both.collect() if r.doc_id not in (None, 10**6 + 1)}
    assert packing.pack(docs.limit(0)).count() == 0
