"""Writers for saved records, output documents and fetched postings."""

import os
from collections.abc import Iterable, Iterator, Sequence
from urllib.parse import urlparse
from urllib.request import url2pathname

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from letterloom.functions.text import pretty_json
from letterloom.session import materialise


def write_state(df: DataFrame, path: str, keys: Sequence[str], previous: str | None = None) -> None:
    """Write a version of a record table in which the new rows replace the old rows of their keys.

    The whole table is written again, in one folder; `store.update_store` rewrites what is touched.

    `previous` names the folder of the version before. A version is never changed once it is
    written, so a lost job leaves the one before whole.
    """
    table = df
    if previous is not None:
        # used twice, so worked out before: a completion in it is paid once
        new = materialise(df, "records")
        old = df.sparkSession.read.parquet(previous)
        table = new.unionByName(old.join(new.select(*keys).distinct(), list(keys), "left_anti"))
    table.write.mode("overwrite").parquet(path)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_profile(df: DataFrame, editable: str, debug: str) -> None:
    """Two copies of the profiles: JSON to edit and reuse, Parquet for later inspection.

    The JSON copy is written from the Parquet copy, so that the profiles are worked out once.
    """
    df.write.mode("overwrite").parquet(debug)
    df.sparkSession.read.parquet(debug).write.mode("overwrite").json(editable)


def write_outputs(df: DataFrame, path: str) -> None:
    """Documents by job slug; a slug that is written again replaces its earlier documents.

    The rows are gathered by slug first, so a slug gets few files; the rebalance hint lets Spark
    split a slug that holds very many documents.
    """
    (
        df.hint("rebalance", "job_slug")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("job_slug")
        .parquet(path)
    )


def write_posting_cache(df: DataFrame, path: str, previous: str | None = None) -> None:
    """Fetched texts, one for each posting (see `intake.posting_identity`)."""
    write_state(df, path, ["identity"], previous)


def to_pretty_json(df: DataFrame, record: str, json: str = "json") -> DataFrame:
    return df.withColumn(json, pretty_json(F.col(record)))


def write_texts(df: DataFrame, path: str, key: str, text: str = "text", slices: int = 64) -> None:
    """One file for each key, named by it, with the lines of its rows; a task has folders of its own.

    Without Hadoop's native library its local file system starts a process for each file and folder, so
    the tasks write files of a local path, which all executors share, themselves. Elsewhere Spark
    writes them, a folder `key=...` for each. A null text is an empty line; keys are numbers. Keep
    `spark.speculation` off: two tries of a task at a time would write the same files.
    """
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    place = urlparse(path)
    if place.scheme not in ("", "file"):
        rows.withColumnRenamed("key", key).write.partitionBy(key).text(path)
        return
    folder = url2pathname(place.path) if place.scheme else path

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = f"{folder}/part={TaskContext.get().partitionId()}"
        begun: set[str] = set()
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                name = f"{own}-{(k or 0) % slices}"
                os.makedirs(name, exist_ok=True)
                name = f"{name}/{'null' if k is None else k}.txt"
                # what a lost try of this task left is overwritten
                with open(name, "ab" if name in begun else "wb") as file:
                    file.write((t or b"") + b"\n")
                begun.add(name)
        yield pa.RecordBatch.from_arrays([pa.array([len(begun)], pa.int64())], names=["n"])

    os.makedirs(folder, exist_ok=True)
    rows.mapInArrow(run, "n long").agg(F.sum("n")).collect()


def key_of_text(read: DataFrame, key: str) -> Column:
    """The key of each file that `write_texts` wrote and `read` holds: its folder's, or else its name's."""
    if key in read.columns:
        return F.col(key).cast("long")
    return F.nullif(F.regexp_extract("file_name", r"^(-?[0-9]+)\.txt$", 1), F.lit("")).cast("long")
