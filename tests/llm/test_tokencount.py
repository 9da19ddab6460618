import random
import re

from gleanery.llm import common, tokencount


def plain(scores, unknown, s):
    """Best score and fewest pieces of every segmentation, by trying them all."""
    if not s:
        return (0.0, 0)
    found = []
    for i in range(1, len(s) + 1):
        score = scores.get(s[:i], unknown if i == 1 else None)
        if score is not None:
            rest = plain(scores, unknown, s[i:])
            found.append((score + rest[0], rest[1] + 1))
    return max(found, key=lambda x: (round(x[0], 9), -x[1]))


def test_trie_matches_every_segmentation():
    rng = random.Random(5)
    scores = {b"a": -2.0, b"b": -2.5, b"ab": -3.0, b"ba": -4.5, b"aba": -5.5, b"bb": -3.5, b"abab": -6.0, b"\xc3": -9.0}
    for most in (10**6, 20):
        trie = tokencount.Trie(scores, most)
        for _ in range(300):
            token = "".join(rng.choice("abcé") for _ in range(rng.randint(1, 9)))
            assert trie(token) == plain(scores, trie.unknown, token.encode())[1]


def test_long_pre_tokens_have_few_nodes(monkeypatch):
    rng = random.Random(6)
    scores = {b"a": -2.0, b"b": -2.5, b"ab": -3.0, b"ba": -4.5, b"aba": -5.5, b"bb": -3.5, b"abab": -6.0}
    long = "".join(rng.choice("ab") for _ in range(20_000))
    whole = tokencount.Trie(scores, 10**6)
    n = whole.insert(long)
    assert len(whole.best) == tokencount.DEEPEST + 1
    monkeypatch.setattr(tokencount, "DEEPEST", 10**6)
    assert tokencount.Trie(scores, 10**6).insert(long) == n
    monkeypatch.setattr(tokencount, "DEEPEST", 3)
    trie = tokencount.Trie(scores, 10**6)
    for _ in range(300):
        token = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
        assert trie(token) == plain(scores, trie.unknown, token.encode())[1]


def test_shared_prefixes_are_scored_once():
    trie = tokencount.Trie({b"a": -1.0}, 1000)
    for t in ("aaaa", "aaab", "aaa"):
        trie(t)
    assert len(trie.best) == 6 and trie.terminal == {"aaaa": 4, "aaab": 4, "aaa": 3}


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "a_b  1é\x00\n"), (-3, "a_b  1é\x00\n"), (None, "x" * 3000)], "doc_id long, text string")
    rows = tokencount.count_tokens(docs.limit(30).unionByName(odd).withColumn("n_tokens", docs.doc_id)).collect()
    scores = tokencount.vocabulary(common.tokenizer_path("byte_bpe_50k.tiktoken"))
    texts = {r.doc_id: r.text for r in docs.collect()} | {r.doc_id: r.text for r in odd.collect()}
    assert len(rows) == 35
    for r in rows:
        parts = re.findall(tokencount.PRE_TOKEN, texts[r.doc_id] or "")
        assert "".join(parts) == (texts[r.doc_id] or "") and r.n_pretokens == len(parts)
        fresh = tokencount.Trie(scores, 10**6)
        assert r.n_tokens == sum(fresh.insert(p) for p in parts)
    got = {r.doc_id: r for r in rows}
    assert got[-1].n_tokens == got[-2].n_tokens == 0 and got[None].n_bytes == 3000
    assert tokencount.count_tokens(docs.limit(0)).count() == 0
