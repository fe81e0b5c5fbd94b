"""The corpus pipeline: quality rules, line deduplication, near-duplicate documents, source mix, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents. Duplicate rows keep
together: rows that share an id are one document to every stage. An empty table stays empty in every stage; further
columns are dropped by the first; ties have a tiebreak by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ramify.llm import line_dedup, ngram_join, packing, quality_rules, queries, source_mix
from ramify.llm.common import NOT_SPACE, Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Rows with a null id are judged like others; a null text has no words, so it goes."""
    judged = quality_rules.apply_rules(docs, queries.table(spark, sf_dir, "labels"), keep_columns=tuple(COLUMNS))
    return judged.where("kept").select(COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; those in which no word is left go, as all they said stands elsewhere.

    Documents that lose no line stay as they are, null and empty texts and rows with a null id among them.
    """
    out = line_dedup.dedup_lines(docs)
    out = out.where((F.col("_removed") == 0) | F.col("text").rlike(NOT_SPACE))
    return out.select("doc_id", "text", "lang", "source", F.when(F.col("_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each connected group. Null and empty texts are in no group; rows with a null id stay."""
    groups = ngram_join.link_components(docs)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti").select(COLUMNS)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the calibrated sample takes. Null sources and languages are values of their own; null and empty texts take their cell's probability."""
    return source_mix.mix_sources(docs).where("_sampled").select(COLUMNS)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their places in sequences. A null or empty text is the end id alone; null ids are kept."""
    return packing.pack_documents(docs, queries.tokenizer_path())


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("source mix", mix_stage),
    ("best-fit packing", pack_stage),
]

#: Learnt cutoffs, fuzzy line groups, raking and the tokenizer have no form in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, over the documents of sf_dir."""
    docs = queries.table(spark, sf_dir, "documents")
    scratch = Scratch(spark)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.write(docs, f"stage{i}")
    return docs
