"""Answer files, vectors and models as files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet with column pruning."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def scan_ids(df: DataFrame, ids: DataFrame, key: str, *, limit: int = 1_000_000) -> DataFrame:
    """Rows whose key is among ``ids``; the ids are broadcast up to ``limit``, counted first, so that the scan is filtered where it is read."""
    few = ids.select(key).distinct()
    return df.join(F.broadcast(few) if few.limit(limit + 1).count() <= limit else few, key, "left_semi")


def with_positions(spark: SparkSession, path: str) -> DataFrame:
    """Rows with __file and __row, their place in the files: the order of arrival of a table without a key."""
    return spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))


def write_parquet(df: DataFrame, path: str, schema=None) -> None:
    """Overwrite; with ``schema``, columns are cast to it first, as a writer whose first batch fixes the types does."""
    if schema is not None:
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    df.write.mode("overwrite").parquet(path)


def write_answers(df: DataFrame, path: str) -> None:
    """CSV with header, one file: a row per query, which is little."""
    df.select("query_id", "answer").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; an empty answer is '' again."""
    df = spark.read.option("header", True).schema("query_id string, answer string").csv(path)
    return df.withColumn("answer", F.coalesce("answer", F.lit("")))


def write_vectors(df: DataFrame, path: str, key: str, vector: str = "embedding") -> None:
    df.select(key, F.col(vector).cast("array<float>").alias("embedding")).write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
