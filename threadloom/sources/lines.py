"""JSON lines, JSON documents and parquet as sources and sinks."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Control characters that break lines or hide in them. A fixed value.
CONTROLS = r"[\x{2028}\x{2029}\x00-\x08\x0B-\x1F\x7F\x{FEFF}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}\x{2066}-\x{2069}]"


def scrub(c: Column) -> Column:
    """Control, zero-width and bidi characters become spaces."""
    return F.regexp_replace(c, CONTROLS, " ")


def read_strict(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Every line must parse; blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_tolerant(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines with their first 1,000 characters)."""
    whole = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.schema(whole).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    good = rows.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    text = spark.read.text(path)
    bad = text.where(F.from_json("value", whole, {"columnNameOfCorruptRecord": "_corrupt_record"})["_corrupt_record"].isNotNull())
    return good, bad.select(F.substring("value", 1, 1000).alias("raw"))


def write_lines(df: DataFrame, path: str, append: bool = False) -> None:
    """One JSON object a line, with nulls, text fields scrubbed."""
    clean = df.withColumns({f.name: scrub(F.col(f.name)) for f in df.schema.fields if isinstance(f.dataType, T.StringType)})
    clean.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def write_document(spark: SparkSession, value: object, path: str) -> None:
    """A small JSON document, pretty, through the file system of the path."""
    text = json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_document(spark: SparkSession, path: str) -> object:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def write_splits(df: DataFrame, split: str, path: str) -> None:
    """One parquet folder per split."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def latest_file(spark: SparkSession, path: str) -> str | None:
    """The newest file below a path, by modification time, then name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime")
    row = files.orderBy(F.desc("modificationTime"), F.desc("path")).first()
    return row["path"] if row else None
