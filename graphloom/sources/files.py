"""Markdown and text files as source documents, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GLOB = "*.{md,txt}"


def decoded_path(c: Column) -> Column:
    """A file's path without its scheme and percent signs; a plus stays a plus."""
    return F.url_decode(F.regexp_replace(F.regexp_replace(c, "^file:/*", "/"), "\\+", "%2B"))


def _documents(raw: DataFrame) -> DataFrame:
    """Empty files are left out; the id follows from the path."""
    rows = raw.select(decoded_path(F.col("_metadata.file_path")).alias("source_path"), F.col("value").alias("raw_content"), F.col("_metadata.file_modification_time").alias("created_at"))
    return rows.where(F.length("raw_content") > 0).select(F.sha2("source_path", 256).alias("id"), "source_path", "raw_content", F.lit("pending").alias("pipeline_status"), "created_at")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """All .md and .txt files below a folder (any file system Spark reads); none if there is no such folder."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "id string, source_path string, raw_content string, pipeline_status string, created_at timestamp")
    return _documents(spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", GLOB).load(folder))


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """One file as a source document, whatever its ending."""
    return _documents(spark.read.format("text").option("wholetext", True).load(path))


def unreadable(spark: SparkSession, folder: str) -> DataFrame:
    """(source_path, reason) of the files that are empty, or whose bytes are not UTF-8 and are read with substitutes."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", GLOB).load(folder)
    # Empty files give no rows; the reader's list of files, which it keeps on the driver anyhow, has them.
    listed = spark.createDataFrame([(p,) for p in raw.inputFiles()], "path string").select(decoded_path(F.col("path")).alias("source_path"))
    read = raw.select(decoded_path(F.col("path")).alias("source_path"), F.is_valid_utf8(F.col("content").cast("string")).alias("valid"))
    empty = listed.join(read, "source_path", "left_anti").select("source_path", F.lit("empty").alias("reason"))
    return empty.unionByName(read.where(~F.col("valid")).select("source_path", F.lit("not UTF-8").alias("reason")))


def stream_documents(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    reader = spark.readStream.format("text").schema("value string").option("wholetext", True).option("recursiveFileLookup", True)
    return _documents(reader.option("pathGlobFilter", GLOB).option("maxFilesPerTrigger", files_per_batch).load(folder))
