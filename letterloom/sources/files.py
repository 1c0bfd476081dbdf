"""Readers for whole-text files, JSON records and saved tables."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from letterloom.operators.intake import visible_only
from letterloom.operators.records import split_valid
from letterloom.schemas import AUTHOR_STYLE, USER_PROFILE


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row per non-hidden file: its name, its time and its whole text."""
    read = (
        spark.read.text(path, wholetext=True)
        .withColumnRenamed("value", "text")
        .select(
            "*",
            F.col("_metadata.file_name").alias("file_name"),
            F.col("_metadata.file_modification_time").alias("modified_at"),
        )
    )
    return visible_only(read, "file_name")


def read_samples(
    spark: SparkSession,
    path: str,
    kind: str,
    decoder: Callable[[bytes], str] | None = None,
    suffix: str = ".pdf",
) -> DataFrame:
    """The writing samples of a folder. A folder without any is an error.

    Files whose name ends in `suffix` go through the caller's `decoder` (bytes to text).
    """
    texts = read_texts(spark, path)
    if decoder is not None:
        plain = texts.filter(~F.lower("file_name").endswith(suffix))
        texts = plain.unionByName(read_binaries(spark, path, decoder, suffix))
    # head looks at a few files first, isEmpty at all
    if not texts.select("file_name").head(1):
        raise ValueError(f"No documents found in {path}.")
    return texts.withColumn("kind", F.lit(kind))


def read_binaries(
    spark: SparkSession, path: str, decoder: Callable[[bytes], str], suffix: str
) -> DataFrame:
    files = (
        spark.read.format("binaryFile")
        .load(path)
        .select(
            "content",
            F.element_at(F.split("path", "/"), -1).alias("file_name"),
            F.col("modificationTime").alias("modified_at"),
        )
        .filter(F.lower("file_name").endswith(suffix))
    )

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(text=[decoder(content) for content in batch["content"]]).drop(
                columns="content"
            )

    decoded = files.mapInPandas(decode, "file_name string, modified_at timestamp, text string")
    return visible_only(decoded, "file_name").select("text", "file_name", "modified_at")


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    """Postings kept as files; a path that does not exist is an error."""
    return read_texts(spark, path)


def read_templates(spark: SparkSession, path: str | None) -> DataFrame:
    """Templates are optional: without a path there are none, and no template output is made."""
    if path is None:
        return spark.createDataFrame([], "text string, file_name string, modified_at timestamp")
    return read_texts(spark, path)


def read_profiles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid profiles with the typed record, invalid ones with every violation)."""
    return split_valid(read_texts(spark, path), "text", USER_PROFILE, "profile")


def read_style_cache(spark: SparkSession, path: str) -> DataFrame:
    """Saved styles, taken as they are; `check_styles` tells the sound ones."""
    return spark.read.parquet(path)


def check_styles(df: DataFrame, style: str = "style") -> tuple[DataFrame, DataFrame]:
    """(styles that hold every required field, the others with their violations)."""
    as_json = df.withColumn("json", F.to_json(style)).drop(style)
    return split_valid(as_json, "json", AUTHOR_STYLE, style)


def load_fetched(df: DataFrame) -> DataFrame:
    """Pages crawled elsewhere: (url, status, body), any other column kept."""
    return df.withColumn("status", F.col("status").cast("int"))
