"""The corpus pipeline: quality, near-duplicates, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns a DataFrame that is
written as Parquet and read again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starfield.llm import classifier, contamination, packing, simhash, substrings
from starfield.llm.queries import benchmark, documents, labels, tokenizer
from starfield.plans.materialize import written


#: Names of columns that are joined to those of the documents.
ID, TEXT_ID = "_pipeline_id", "_pipeline_text"


def _named(rows: DataFrame) -> DataFrame:
    """Of doc_id and text_id the names above: together they tell rows apart that share a doc_id or have none."""
    return rows.select(F.col("doc_id").alias(ID), F.col("text_id").alias(TEXT_ID)).distinct()


def _same(docs: DataFrame) -> Column:
    return docs["doc_id"].eqNullSafe(F.col(ID)) & (F.xxhash64(docs["text"]) == F.col(TEXT_ID))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects. It judges each row by itself, so rows that share a
    doc_id or have none stand alone; nulls, empty and long texts as in ``classifier.scored``."""
    model = classifier.trained(written(classifier.features(docs), "stage-views"), labels(spark, sf_dir))
    return classifier.accepted(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays: that with the smallest doc_id, of those the smallest
    fingerprint, then text hash; of rows equal in these any one. Rows that share a doc_id are judged by their own texts.
    Rows without a doc_id are last in a group, and stay if the group has no others."""
    rows = simhash.classed(docs)
    own = F.struct("doc_id", "text_id")
    first = rows.filter(own.eqNullSafe(F.struct("first.doc_id", "first.text_id"))).groupBy("doc_id", "text_id").agg(F.count("*").alias("n"))
    first = written(first, "first-rows")
    once = docs.join(_named(first.filter("n = 1")), _same(docs), "left_semi")
    more = docs.join(_named(first.filter("n > 1")), _same(docs), "left_semi").withColumn(TEXT_ID, F.xxhash64("text"))
    return once.unionByName(more.dropDuplicates(["doc_id", TEXT_ID]).select(docs.columns))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier document has, and drops what is left empty."""
    kept = substrings.without_repeats(docs)
    return kept.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(docs.columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of whose words a twentieth or more stand in benchmark passages. Each row is judged by its own
    text, whatever doc_id it shares or lacks."""
    hit = _named(contamination.contamination(docs, benchmark(spark, sf_dir), slop=0).filter("contaminated"))
    return docs.join(hit, _same(docs), "left_anti").select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of 1024 tokens: the pieces with their token ids. ``packing.sequences`` joins
    them into rows for training. Every row is packed, repeated ones and those without an id or text too."""
    return packing.packed(docs, tokenizer("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("quality classifier", good),
    ("simhash near-dedup", one_of_each),
    ("substring dedup", without_repeats),
    ("benchmark decontamination", clean),
    ("packing", packed),
]

#: No SQL expresses the stages; tests/llm compares them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
