"""Resumable generation as a stream: new bundle files, each encounter once, pairs appended with a checkpoint.

An extension: the same passes that operators.passes runs in batch, driven by files as they come.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark import schemas as S


def bundle_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(S.BUNDLE).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder).selectExpr("_metadata.file_path as path", "entry")


def generate(spark: SparkSession, folder: str, out: str, checkpoint: str, make: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Runs `make` (bundles to pairs with encounter_id) on new files and appends what isn't in `out` yet; ends when all are read.

    The ids that are done are kept beside the checkpoint, as a small table by batch: seeded from
    `out` once, then added to. So a batch reads ids only, never the pairs, and one that is run
    again after a failure doesn't count its own ids as done.
    """
    from quillspark.operators.report import append_pairs
    from quillspark.sources.files import done_ids, exists

    ids = f"{checkpoint}-ids"
    schema = "encounter_id string, batch long"
    if not exists(spark, f"{ids}/batch=-1"):
        done_ids(spark, out).write.mode("overwrite").parquet(f"{ids}/batch=-1")

    def batch(df: DataFrame, n: int) -> None:
        before = spark.read.schema(schema).parquet(ids).where(F.col("batch") < n).select("encounter_id")
        again = spark.read.schema(schema).parquet(ids).where(F.col("batch") >= n).limit(1).count() > 0
        new = make(df).join(before, "encounter_id", "left_anti")
        if again:  # this batch was cut short: some of its pairs may have been written
            new = new.join(done_ids(spark, out), "encounter_id", "left_anti")
        new.select("encounter_id").distinct().write.mode("overwrite").parquet(f"{ids}/batch={n}")
        append_pairs(new, out)

    return bundle_stream(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
