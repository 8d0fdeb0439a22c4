"""Sources and sinks of document collections, all with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK = "chunk_id string, doc_id string, content string, doc_type string, title string, year int, _corrupt string"
USAGE = "timestamp timestamp, query string, mode string, model string, input_tokens long, output_tokens long, cost_usd double, processing_time double, success boolean, error string"


def discover(spark: SparkSession, folder: str, glob: str = "*.pdf") -> DataFrame:
    """Index of the files below a folder: path, name, size, time, doc_id (parent and stem in lower case, _ for space and -)."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder).drop("content")
    parts = F.split("path", "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    return f.select("path", F.element_at(parts, -1).alias("file_name"), F.col("length").alias("file_size"), "modificationTime", F.regexp_replace(F.lower(F.concat_ws("_", F.element_at(parts, -2), stem)), "[ -]", "_").alias("doc_id"))


def read_texts(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, text) of whole text or HTML files."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return f.select("path", F.col("content").cast("string").alias("text"))


def read_chunks(spark: SparkSession, paths, schema: str = CHUNK) -> DataFrame:
    """JSON lines; a line that is no JSON is left out, its number can be had by ``bad_lines``."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(paths).where("_corrupt is null").drop("_corrupt")


def read_arrays(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """Files that hold JSON arrays, as one table."""
    return spark.read.schema(schema).option("multiLine", True).json(glob)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; rows with an empty ``supersedes`` are left out, the rest listed by order."""
    c = spark.read.option("header", True).csv(path)
    return c.where(F.trim(F.coalesce("supersedes", F.lit(""))) != "").groupBy("go_number").agg(F.array_sort(F.collect_set("supersedes")).alias("supersedes"))


def write_chunks(df: DataFrame, path: str, by: str = "doc_type", mode: str = "append", fmt: str = "json") -> None:
    df.write.mode(mode).partitionBy(by).format(fmt).save(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """Upsert semantics: the last row of each key."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_rn = 1").drop("_rn")


def upsert(spark: SparkSession, df: DataFrame, path: str, key: str, order: str, collection: str = "collection") -> DataFrame:
    """Merges rows into a table partitioned by collection, in a new folder; returns what it holds. Empty vectors are left out."""
    new = df.where(F.size("embedding") > 0) if "embedding" in df.columns else df
    merged = latest(new, key, order)
    merged.write.mode("overwrite").partitionBy(collection).parquet(path)
    return spark.read.parquet(path)


def unprocessed(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Resume: the rows whose key is not among the processed ones."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def to_json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))


def collection_counts(df: DataFrame, collection: str = "collection") -> DataFrame:
    return df.groupBy(collection).agg(F.count("*").alias("n"))
