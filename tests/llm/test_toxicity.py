import numpy as np
import pytest

from gleanery.llm import toxicity


def test_features():
    words, grams, start = toxicity.features("Ab, abcd 9")
    assert list(start) == [0, 2, 6] and len(words) == 3 and grams.shape == (7, 3)
    assert (grams[1] == grams[1][[0, 1, 2]]).all() and list(grams[6, 1:]) == [toxicity.GRAMS] * 2
    same, own, _ = toxicity.features("abcd")
    assert same[0] == words[1] and (own == grams[2:6]).all()
    assert len(toxicity.features("")[0]) == len(toxicity.features(" ,.\n")[0]) == 0


@pytest.mark.parametrize("n", [0, 1, 47, 48, 49, 72, 73, 500])
def test_windows_cover_and_overlap(n):
    at = toxicity.windows(n)
    assert at[0] == 0 and at[-1] + toxicity.WINDOW >= n
    assert all(b - a == toxicity.STRIDE < toxicity.WINDOW for a, b in zip(at, at[1:]))


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    m = toxicity.new_model(3, np.float64)
    x, mask = rng.standard_normal((3, 6, 2 * toxicity.DIM)), np.ones((3, 6))
    mask[0, 4:] = 0
    mask[2] = 0
    y = np.array([1.0, 0.0, 1.0])

    def loss(x):
        z = toxicity.forward(m, x, mask)[0]
        return float(np.sum(np.logaddexp(0, z) - y * z))

    z, kept = toxicity.forward(m, x, mask, keep=True)
    g, dx = toxicity.backward(m, mask, kept, 1 / (1 + np.exp(-z)) - y)
    for name in ("xf", "uf", "cf", "xb", "ub", "cb", "wa", "ba", "va", "wo", "bo"):
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in m[name].shape)
            old, e = m[name][at], 1e-5
            m[name][at] = old + e
            up = loss(x)
            m[name][at] = old - e
            down = loss(x)
            m[name][at] = old
            assert np.isclose((up - down) / (2 * e), g[name][at], rtol=1e-4, atol=1e-7), name
    for _ in range(6):
        at, e = tuple(rng.integers(0, n) for n in x.shape), 1e-5
        up, down = x.copy(), x.copy()
        up[at] += e
        down[at] -= e
        assert np.isclose((loss(up) - loss(down)) / (2 * e), dx[at], rtol=1e-4, atol=1e-7)


def test_a_text_scores_as_its_best_window():
    m = toxicity.new_model(1)
    text = " ".join(f"w{k % 37}" for k in range(200))
    words, grams, start = toxicity.features(text)
    whole = toxicity.text_logits(m, [toxicity.features("a b"), (words, grams, start)], batch=3)[1]
    for s, logit in zip(toxicity.windows(200), whole):
        alone = toxicity.text_logits(m, [toxicity._slice((words, grams, start), int(s))])[0]
        assert np.allclose(alone[0], logit, atol=1e-4)


@pytest.mark.parametrize("n", [20_000, 24_001, 24_024, 24_025, 24_048, 60_000])
def test_pieces_have_the_windows_of_the_whole_text(n):
    m, rng = toxicity.new_model(1), np.random.default_rng(n)
    text = ",  ".join(f"Wörd{k}" for k in rng.integers(0, 999, n))
    whole = toxicity.text_logits(m, [toxicity.features(text)])[0]
    parts = [toxicity.text_logits(m, [d], starts=[s])[0] for d, s in toxicity.pieces(text)]
    assert len(parts) > 1 and np.allclose(np.concatenate(parts), whole, atol=1e-5)


def test_pieces_of_odd_texts():
    assert not list(toxicity.pieces("")) and not list(toxicity.pieces(" " * 300_000))
    assert sum(len(d[1]) for d, _ in toxicity.pieces("-" * 200_000 + "hello")) == 5
    assert len(list(toxicity.pieces("x" * 500_000))) > 1


def test_a_word_that_comes_again_is_not_computed_again(monkeypatch):
    seen, plain = [], toxicity.inputs
    monkeypatch.setattr(toxicity, "inputs", lambda m, words, grams, start: seen.append(len(words)) or plain(m, words, grams, start))
    scored = toxicity.Scorer(toxicity.new_model(1))
    scored([" ".join(f"w{k % 37}" for k in range(60_000)), "w1 w2 new"])
    scored(["New, w3", "w4 w5"])
    assert sum(seen) == 38


@pytest.mark.parametrize("kept, letters", [(1 << 16, 1 << 20), (5, 1 << 20), (1 << 16, 100)])
def test_kept_words_score_as_computed_ones(monkeypatch, kept, letters):
    monkeypatch.setattr(toxicity, "KEPT", kept)
    monkeypatch.setattr(toxicity, "KEPT_LETTERS", letters)
    m, rng = toxicity.new_model(1), np.random.default_rng(7)
    pool = ["a", "Straße", "ΌΔΟΣ", "x" * 2048, "x" * 2049, "y" * 5000, "日本語", "²", "a_b", "1", "İ", "don't", "\ud800q", "e\u0301", "-", "\0", *(f"w{k}" for k in range(300))]
    texts = [" ".join(rng.choice(pool, n)) for n in (1, 2, 24, 25, 48, 49, 72, 73, 500, 3000)]
    texts += [None, "", " ,_", "w1 " * 100_000, "x" * 300_000, "w2 w3 " * 30_000 + "z" * 2100 + " w4" * 40_000, *texts[:4]]
    scored = toxicity.Scorer(m)
    best, count = (np.concatenate(x) for x in zip(scored(texts[:9]), scored(texts[9:])))
    for text, score, n in zip(texts, best, count):
        logits = [x for d, s in toxicity.pieces(text or "") for x in toxicity.text_logits(m, [d], starts=[s])[0]]
        assert n == len(logits) and np.isclose(score, 1 / (1 + np.exp(-max(logits))) if logits else 0, atol=1e-6)
    assert len(scored.numbers) <= kept


def test_runs_are_of_the_letters_of_words():
    marked = toxicity._word_letters()
    assert all(bool(toxicity._RUN.fullmatch(chr(c))) == marked[c] for c in range(0x110000))


def test_a_text_over_the_letters_of_the_sample_is_passed_over(spark):
    docs = spark.createDataFrame([(1, "bad " * 50), (2, "good " * 50), (3, "bad " * 9000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels, sample_letters=1000) is not None
    assert toxicity.fit(docs.where("doc_id <> 1"), labels, sample_letters=1000) is None


def test_learns_a_word_and_defined_cases(spark):
    rng = np.random.default_rng(4)
    filler = [f"{a}{b}" for a in "bcdfgh" for b in "aeiou"]
    text = lambda bad: " ".join([*rng.choice(filler, 90), *(["villain", "villainous"] if bad else []), *rng.choice(filler, 20)])
    rows = [(k, text(k % 3 == 0), "x", 0.5) for k in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(240)] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs.where("doc_id % 4 != 2"), labels)
    odd = spark.createDataFrame([(900, None), (901, ""), (902, ".,"), (None, "ba"), (903, ("ba " * 300_000) + "villain villainous")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(docs.where("doc_id % 4 = 2").select("doc_id", "text").unionByName(odd), model).collect()}
    assert all((s >= toxicity.THRESHOLD) == (k % 3 == 0) for k, s in got.items() if k is not None and k < 900)
    assert got[900] == got[901] == got[902] < 0.3 and got[903] >= 0.3 and 0 <= got[None] <= 1
    assert toxicity.fit(docs, labels.where("toxic = 0")) is None
    assert [r.score for r in toxicity.score(odd, None).collect()] == [0.0] * 5
    assert toxicity.score(odd.limit(0), model).count() == 0


def test_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = toxicity.op4_recurrent_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    hits, said, toxic = (sum(f(r) for r in rows) for f in (lambda r: r.predicted and r.toxic, lambda r: r.predicted, lambda r: r.toxic))
    assert toxic > 80 and hits >= 0.9 * said and hits >= 0.8 * toxic
    assert sum(r.predicted == r.toxic for r in rows) >= 0.97 * len(rows)
