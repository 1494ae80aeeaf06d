"""The corpus pipeline: stages that each apply one corpus operator to what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents, with n_chars kept up to date. SQL can't express the stages; tests
compare them with brute force.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.mixing import mix_sources
from quillspark.llm.quality_classifier import score_quality
from quillspark.llm.sentencepiece_codec import encode_documents
from quillspark.llm.shared import table, written
from quillspark.llm.shingle_join import without_copies
from quillspark.llm.suffix_dedup import GRAM, LENGTH, find_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return score_quality(docs, table(spark, sf_dir, "labels"), *COLUMNS[1:]).where("predicted = 1").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies, and of its rows without doc_id one. Rows that repeat a doc_id are judged each."""
    return without_copies(docs, *COLUMNS[2:]).select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without passages that occur earlier."""
    cut = find_repeats(docs, LENGTH, GRAM, "lang", "source", as_text=True)
    return cut.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.char_length("kept").cast("long").alias("n_chars"))


def _named(docs: DataFrame) -> DataFrame:
    """docs with where each row lies in its files, which names it whatever its columns say; rows that lie in none are written first."""
    try:
        return docs.select(*COLUMNS, F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_index"))
    except AnalysisException:
        return _named(written(docs.select(*COLUMNS)))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: each document as many times as the mix takes it."""
    rows = _named(docs)
    mix = mix_sources(rows, "_file", "_index").where("taken > 0").select("_file", "_index", (F.col("taken") / F.col("size")).cast("int").alias("_copies"))
    taken = rows.join(mix, ["_file", "_index"])
    return taken.select(*COLUMNS, F.explode(F.sequence(F.lit(1), "_copies")).alias("_copy")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of each document of the mix, and round_trip: whether the ids decode to its text."""
    encoded = encode_documents(docs.select("doc_id", "text", "lang", "source"), None, keep=("lang", "source"), verify=True)
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [("quality", quality), ("near_copies", near_copies), ("repeats", repeats), ("mixture", mixture), ("tokens", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
