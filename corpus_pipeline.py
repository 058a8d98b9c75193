"""The corpus pipeline: documents to sampled subword ids, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept. All but the last return the columns of ``documents`` as they are,
whatever their names; the last returns those it names.

Null text counts as empty and has no letter, so it goes in the first stage, as do
texts in no known language. Null doc_ids are allowed and differ from all others. Rows that repeat
doc_id and text are one document from ``near_duplicates`` on. Of near copies the
least doc_id stays, of equal ones the least hash of the text. Long texts are
whole in every stage. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halocline.llm import decontaminate, language_id, line_dedup, near_copies, pieces
from halocline.llm.common import materialise, packed, read


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is known; those too far from every centroid, or without a letter, go."""
    found = language_id.identify(packed(docs, "text"), language_id.fit(docs))
    return found.where(F.col("lang_pred") != language_id.UNDETERMINED).select("_row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten documents or more stay where they come first only; n_chars follows."""
    out = line_dedup.dedup_lines(docs, min_documents=10, min_chars=1, keep_first=True)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose links are a similarity of 0.8 or more of their 5-word shingles."""
    return near_copies.one_of_each(docs, shingle_words=5, least=0.8)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def subwords(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids of two sampled segmentations with their scores, and whether all decode to the text."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return pieces.encode_checked(own, F.col("doc_id"), k=2).select("doc_id", "samples", "round_trip")


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("subwords", subwords),
]

#: No single SQL statement: centroids, fingerprints, alignment and sampling have none.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
