"""Scans: bundle folders, JSON lines, JSON arrays, checkpoints, result files, and keys of arbitrary JSON."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark import schemas as S

SKIPPED = "^(hospitalInformation|practitionerInformation)"


def bundles(spark: SparkSession, folder: str) -> DataFrame:
    """(path, entry): one row per *.json file of a folder, but for the skipped names. Sort by path where order matters."""
    df = spark.read.schema(S.BUNDLE).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    path = F.col("_metadata.file_path")
    return df.select(path.alias("path"), "entry").where(~F.substring_index("path", "/", -1).rlike(SKIPPED))


def bundles_of(docs: DataFrame, path: str, body: str) -> DataFrame:
    """(path, entry) of a table that holds each bundle's JSON text."""
    return docs.select(F.col(path).cast("string").alias("path"), F.from_json(body, S.BUNDLE)["entry"].alias("entry"))


def json_lines(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Rows of a JSON-lines file; a malformed line fails the scan."""
    return spark.read.schema(schema or S.PAIR).option("mode", "FAILFAST").json(path)


def json_array(spark: SparkSession, path: str, schema: T.StructType, limit: int | None = None) -> DataFrame:
    """Elements of one JSON array with their position; the limit holds before any filter."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.posexplode(F.from_json("value", T.ArrayType(schema))).alias("pos", "row"))
    return (rows if limit is None else rows.where(F.col("pos") < limit)).select("pos", "row.*")


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or a temporary one where all run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quillspark-")
    return f"{found}/{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def write_lines(rows: DataFrame, folder: str, key: str) -> None:
    """A *.json file of the lines in `value` for each key, below folder. All rows of a key lie in one task, sorted by the key and then by their order in the file."""
    rows.select(key, "value").write.partitionBy(key).text(folder)
    hadoop = rows.sparkSession._jvm.org.apache.hadoop.fs
    where = hadoop.Path(f"{folder}/*/*.txt")
    fs = where.getFileSystem(rows.sparkSession._jsc.hadoopConfiguration())
    for found in fs.globStatus(where):
        path = found.getPath()
        if not fs.rename(path, hadoop.Path(path.getParent(), path.getName().removesuffix(".txt") + ".json")):
            raise OSError(f"{path} can't be renamed")


def done_ids(spark: SparkSession, path: str) -> DataFrame:
    """encounter_id of what a checkpoint holds: none where it isn't there yet, and malformed lines don't count."""
    if not exists(spark, path):
        return spark.createDataFrame([], "encounter_id string")
    schema = "encounter_id string, _bad string"
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where("encounter_id is not null").select("encounter_id").distinct()


def results(spark: SparkSession, folder: str) -> DataFrame:
    """(path, result...) of each result file."""
    df = spark.read.schema(S.RESULT).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    return df.select(F.col("_metadata.file_path").alias("path"), *S.RESULT.fieldNames())


def json_objects(spark: SparkSession, folder: str) -> DataFrame:
    """(path, pos, body): objects of all *.json files below a folder, alone or in an array; what isn't readable is skipped."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    v = F.try_parse_json("value")
    kind = F.schema_of_variant(v)
    items = F.when(kind.rlike("^ARRAY"), F.try_variant_get(v, "$", "array<variant>")).when(kind.rlike("^OBJECT"), F.array(v))
    rows = text.select(F.col("_metadata.file_path").alias("path"), F.posexplode(items).alias("pos", "item"))
    return rows.where(F.schema_of_variant("item").rlike("^OBJECT")).select("path", "pos", F.to_json("item").alias("body"))
