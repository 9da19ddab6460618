"""A training corpus from documents: harmless, without near duplicates and repeated passages, free of benchmarks, packed.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns a DataFrame; all but the last return
the columns of documents, further ones included, whatever their names. Defined cases of all stages: an empty table gives an empty one;
null and empty texts stay to the end, where each is a piece of its end mark alone; repeated rows are one document from the near-duplicate
stage on; rows with a null doc_id stay through it, as nothing names their group, and share a verdict on leaks; very long texts are read
whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import common, decontam, jaccard, packing, suffixes, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at the threshold or above go; without learnable labels of both classes none does."""
    model = toxicity.fit(docs.where(~common.held_out()), common.table(spark, sf_dir, "labels"))
    return toxicity.harmless(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest doc_id stays; of several rows of that doc_id the one of the largest text,
    then of the largest other columns."""
    found = jaccard.near_duplicates(docs)
    stays = found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    stays = common.written(stays)
    kept = docs.join(stays.where("n = 1").select("doc_id"), "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
    several = stays.where("n > 1").select("doc_id")
    if not several.isEmpty():
        plain = [f.name for f in docs.schema if f.name not in ("doc_id", "text") and f.dataType.typeName() not in ("map", "variant")]
        rows = docs.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.max_by(F.struct(*docs.columns), F.struct("text", *plain)).alias("_row"))
        kept = kept.unionByName(rows.select("_row.*"))
    return kept.select(*docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated strings go from the texts; a document that is nothing else stays, with an empty text."""
    return suffixes.without_repeats(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go; an empty benchmark takes none."""
    found = decontam.leaks(docs, common.table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("leaks")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["leaks"]), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: every document of the stage before, in pieces."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", one_of_each),
    ("suffix_dedup", drop_repeats),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: Trained models, byte-wise repeats and bin packing are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
