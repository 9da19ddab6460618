from collections import Counter

import corpus_pipeline
from gleanery.llm import decontam, jaccard, toxicity
from tests.llm.test_decontam import brute as leaked
from tests.llm.test_jaccard import brute as classes
from tests.llm.test_suffixes import plain


def test_every_stage_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = corpus_pipeline.common.written(stage(spark, docs, sf_dir))
        rows = docs.collect()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and rows
        seen[name] = (before, rows)
    assert list(stages) == ["toxicity", "jaccard_join", "suffix_dedup", "decontamination", "packing"]

    before, rows = seen["jaccard_join"]
    want = {d for _, d, _, c in classes([(r.doc_id, r.text) for r in before.values()]) if d == c}
    assert {r.doc_id for r in rows} == want and len(rows) == len(want)
    assert all(r == before[r.doc_id] for r in rows)

    before, rows = seen["suffix_dedup"]
    want = {}
    for d, t, spans in plain([(r.doc_id, r.text) for r in before.values()], 50):
        raw, at, out = t.encode(), 0, []
        for a, b in [*spans, (len(t.encode()),) * 2]:
            out.append(raw[at:a])
            at = b
        want[d] = b"".join(out).decode("utf-8", "ignore")
    assert {r.doc_id: r.text for r in rows} == want
    assert all(r.n_chars == len(r.text) and r.lang == before[r.doc_id].lang and r.source == before[r.doc_id].source for r in rows)

    before, rows = seen["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    gone = {d for d, _ in leaked([(r.doc_id, r.text) for r in before.values()], items)}
    assert {r.doc_id for r in rows} == set(before) - gone

    before, rows = seen["packing"]
    assert {r.doc_id for r in rows} == set(before)
    assert max(Counter((r.sequence_id, r.offset) for r in rows).values()) == 1

    before, rows = seen["toxicity"]
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    clean = [d for d in before if toxic.get(d) == 0]
    assert len({r.doc_id for r in rows} & set(clean)) >= 0.9 * len(clean)


def test_null_and_repeated_rows_pass_through(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "a b c d e f", None, None, 11), (1, "a b c d e f", None, None, 11), (2, None, "en", "s", 0), (None, None, None, None, None), (None, "x", None, None, 1), (3, "A b c d e f", "en", "s", 11)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, "x")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted((r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=repr)
    assert got == [1, 2]
    assert toxicity.THRESHOLD == 0.3 and jaccard.SHINGLE == decontam.SHINGLE == 5


def tables(spark, path, rows, schema, labels=(), items=((0, "x"),)):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_empty_documents(spark, tmp_path):
    path = tables(spark, tmp_path, [], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.run(spark, path).count() == 0


def test_clashing_columns_and_very_long_texts(spark, tmp_path):
    import random

    rng = random.Random(1)
    text = lambda n: " ".join(f"w{rng.randrange(9000)}" for _ in range(n))
    long, passage = text(60_000), text(30)
    names = "leaks part rest n node component_id item_id score width keys _row text_a label".split()
    texts = {1: long, 2: long + " end", 3: f"{text(40)} {passage} {text(40)}", 4: f"{text(50)} {passage} {text(50)}", 5: passage, 6: "", 7: None}
    rows = [(k, t, *[f"{c}{k}" for c in names]) for k, t in texts.items()] + [(8, "b a", *names), (8, "b b", *names)]
    path = tables(spark, tmp_path, rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.common.written(stage(spark, docs, path))
        assert docs.columns == ["doc_id", "text", *names], name
    got = {r.doc_id: r for r in docs.collect()}
    assert sorted(got) == [1, 3, 4, 5, 6, 7, 8] and got[1].text == long and got[8].text == "b b"
    assert passage in got[3].text and passage not in got[4].text and passage.startswith(got[5].text.strip() or passage)
    assert all(got[k][c] == f"{c}{k}" for k in (1, 3, 4, 5, 6, 7) for c in names)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    assert {r.doc_id for r in pieces} == set(got) and max(r.length for r in pieces) <= 2048
