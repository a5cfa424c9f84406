"""A training corpus from ``documents``: rules, classifier, line and near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the columns
of ``docs``; a clashing column of the input is carried as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postalloom.llm import line_dedup, packing, quality_classifier, quality_rules, simhash
from postalloom.llm.common import cut, table

#: The stages fit models, group texts and tokenise: SQL cannot express them. See tests/llm/test_pipeline.py.
ORACLE_SQL = None


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and that the weakly supervised rules find good (operator 4)."""
    return quality_rules.keep_good(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quadratic discriminant scores 0.5 or more (operator 7).

    It is fitted on the labelled rows of the table ``documents``: of ``docs`` the rules have taken most of the bad ones.
    """
    labelled = quality_classifier.counted(table(spark, sf_dir, "documents"), ["doc_id"])
    return quality_classifier.keep_good(docs, quality_classifier.fit(labelled, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that stay in another one (operator 5); n_chars counts what is left."""
    done = line_dedup.dedup(docs, counts=False)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard of 0.8 or more on five-word shingles, the one with the least doc_id.

    Operator 3: covering tables over SimHashes of whole texts and of their sections name the candidates.
    """
    return simhash.keep_one(docs)


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The records of the windows into which the documents are packed, ids included (operator 6)."""
    pieces = packing.pack(docs, *packing.default_tokenizer())
    return packing.digest(pieces, "ids")


STAGES = [
    ("quality_rules", rules),
    ("quality_classifier", classifier),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("packing", windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each cut off from the plan of the one before."""
    docs = table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = cut(docs)
    return docs
