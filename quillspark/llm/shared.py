"""Helpers that the corpus operators have in common: shared storage, sizes, labels."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and all run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", found) if spark.conf.isModifiable("spark.checkpoint.dir") else spark.sparkContext.setCheckpointDir(found)
    return found


def written_at(df: DataFrame) -> tuple[DataFrame, str]:
    """The same rows, read back from a table in the shared folder, and where that is."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame) -> DataFrame:
    """The same rows, read back from a table in the shared folder: cuts the lineage, and survives lost executors."""
    return written_at(df)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table of written_at that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def heavy_keys(counted: DataFrame, size: str, key: list[str], rows: int, most: int = 10_000) -> DataFrame:
    """The keys that more than a `most`-th of all rows (1,000 at least) have: at most `most` of them, so they can be broadcast."""
    return written(counted.where(F.col(size) > max(1000, rows // most)).select(*key))


def join_split(rows: DataFrame, side: DataFrame, key: list[str], heavy: DataFrame) -> DataFrame:
    """rows left-joined with side, which has each key once. What the heavy keys have is broadcast, so their rows stay where they are."""
    heavy = F.broadcast(heavy)
    hot = rows.join(heavy, key, "left_semi").join(F.broadcast(side.join(heavy, key, "left_semi")), key, "left")
    return rows.join(heavy, key, "left_anti").join(side, key, "left").unionByName(hot)


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def crc_mod(key: str, n: int) -> Column:
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(n))


def one_label(labels: DataFrame, column: str) -> DataFrame:
    """doc_id and one label for each; where rows disagree, the larger label; rows without id or label don't count."""
    return labels.select("doc_id", F.col(column).cast("int").alias("label")).dropna().groupBy("doc_id").agg(F.max("label").alias("label"))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, mod: int, not_rest: int, bound: int) -> DataFrame:
    """(doc_id, text, label) of at most `bound` labelled rows that may be learnt from, chosen by a hash of the id.

    The bound is what allows the model to be broadcast; it doesn't depend on the corpus.
    """
    open_rows = one_label(labels, column).where(crc_mod("doc_id", mod) != not_rest)
    chosen = open_rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    texts = docs.select("doc_id", "text").where(crc_mod("doc_id", mod) != not_rest)
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
