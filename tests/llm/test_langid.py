import numpy as np

from gleanery.llm import langid

EN, FR = "the cat sat with this thing and that other thing", "le chat est dans une maison avec des fleurs et du vin"


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")


def test_mixture_and_defined_cases(spark):
    train = docs(spark, [(k, EN if k % 2 else FR, "en" if k % 2 else "fr", 0.0) for k in range(20)] + [(None, EN, "en", 0.0), (50, None, "en", 0.0), (51, "x", None, 0.0)])
    langs, logs = langid.fit(train)
    assert langs == ["en", "fr"]
    test = docs(spark, [(1, EN * 3, None, 0.0), (2, FR, "en", 0.0), (3, None, None, 0.0), (4, "12 34 !!", None, 0.0), (5, "", None, 0.0), (6, " ".join([EN] * 6 + [FR] * 6), None, 0.0), (7, EN + " " * 700_000 + EN, None, 0.0), (None, EN, None, 0.0)])
    got = {r.doc_id: r for r in langid.predict(test, langs, logs).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3, 4, 5, 7, None)] == ["en", "fr", "und", "und", "und", "en", "en"]
    assert got[3].score == 0 and got[1].score == 1.0 and set(got[1].mixture) == {"en"}
    assert set(got[6].mixture) == {"en", "fr"} and 0.3 < got[6].score < 0.75


def test_nothing_to_learn_from(spark):
    langs, logs = langid.fit(docs(spark, [(1, "abc", None, 0.0)]))
    assert [r.lang_pred for r in langid.predict(docs(spark, [(1, "abc", None, 0.0)]), langs, logs).collect()] == ["und"]
    assert langid.predict(docs(spark, []), langs, logs).count() == 0


def test_word_likelihoods_match_a_plain_count():
    classes, starts = langid.trigrams("Ab, c")
    assert len(classes) == 3 and list(starts) == [0, 2]
    assert np.array_equal(classes, np.concatenate([langid.trigrams("ab")[0], langid.trigrams("c")[0]]))


def test_expectation_maximisation_matches_a_plain_loop():
    rng = np.random.default_rng(3)
    words = [np.log(rng.random((n, 3))) for n in (1, 5, 40)]
    for w in words:
        share = np.full(3, 1 / 3)
        for _ in range(8):
            joint = np.exp(w) * share
            share = (joint / joint.sum(1, keepdims=True)).mean(0)
        got, _ = langid._rising(np.exp(w), np.zeros(len(w), int), np.array([0]), np.full((1, 3), 1 / 3), 8)
        assert np.allclose(got[0], share)


def test_held_out_accuracy(spark, sf_dir):
    d = langid.op7_language_mixture(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in d) >= 0.97 * len(d) > 0
