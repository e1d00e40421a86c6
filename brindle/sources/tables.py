"""Readers: parquet tables by name, CSV folders, JSON logs and warehouse tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.ordering import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Whole-table read; Catalyst prunes columns and pushes filters to the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(spark: SparkSession, sql: str, *params) -> DataFrame:
    """SQL with positional parameters; as many values as question marks."""
    places = re.sub(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*", "", sql).count("?")  # not those in literals
    if places != len(params):
        raise ValueError(f"{places} placeholders, {len(params)} parameters")
    return spark.sql(sql, args=list(params))


def jdbc(spark: SparkSession, url: str, name: str, column: str, low: int, high: int, partitions: int, **options) -> DataFrame:
    """A warehouse table read in parallel ranges of a numeric column; filters and columns are pushed down by Spark."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=partitions, **options)
    return reader.load()


def inventory(df: DataFrame) -> DataFrame:
    """(file, bytes, n_rows) of the files behind a DataFrame."""
    meta = df.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    return meta.groupBy("file", "bytes").agg(F.count("*").alias("n_rows"))


def sample_rows(df: DataFrame, keys: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """n rows, the same on every run: the least by a seeded hash of their keys."""
    return df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(n)


def append_log(df: DataFrame, path: str) -> None:
    """Records appended to a JSON log, which the streaming file source reads back."""
    df.write.mode("append").json(path)


def result_digest(df: DataFrame) -> DataFrame:
    """Order-free digest of a result: row count, xor and sum of row hashes."""
    h = F.xxhash64(*df.columns)
    return df.agg(F.count("*").alias("n_rows"), F.bit_xor(h).alias("xor"), F.sum(h.cast("decimal(38,0)")).alias("sum"))


def write_result(df: DataFrame, path: str, kind: str = "csv") -> DataFrame:
    """Write a result and return the digest of what was written: both come from one stored evaluation."""
    df = stored(df, "result")
    df.write.mode("overwrite").option("header", True).format(kind).save(path)
    return result_digest(df)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """A result as a table in the shared folder, and a view of it."""
    out = stored(df, name)
    out.createOrReplaceTempView(name)
    return out


def csv_tables(spark: SparkSession, folder: str, names: Sequence[str] | None = None, schemas: dict | None = None) -> dict[str, DataFrame]:
    """One DataFrame and temporary view per CSV file, named by its stem; a declared file that is missing is an error."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = {s.getPath().getName().removesuffix(".csv"): s.getPath().toString() for s in fs.listStatus(fs_path) if s.getPath().getName().endswith(".csv")}
    if missing := set(names or ()) - found.keys():
        raise FileNotFoundError(sorted(missing))
    out = {}
    for name in names or sorted(found):
        reader = spark.read.option("header", True)
        reader = reader.schema(schemas[name]) if schemas and name in schemas else reader.option("inferSchema", True)
        out[name] = reader.csv(found[name])
        out[name].createOrReplaceTempView(name)
    return out
