"""Session settings and the shared folder for tables that are written and read again."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a hot key is split even where that costs one more shuffle afterwards
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # shuffled rows of a step that is written go when it ends, not when the driver's memory is next cleaned
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}
#: Tasks that list the folders of one path; Spark's own 10,000 take longer to start than to list.
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
LEAST_LISTING_TASKS = 32
#: Writes rows of megabytes in groups of a few: a size that is looked at after each row, not after 100.
_WIDE_ROWS = {
    "parquet.block.size": str(8 << 20),
    "parquet.page.size.row.check.min": "1",
    "parquet.page.size.row.check.max": "1",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in _DEFAULTS.items():
        spark.conf.set(key, value)
    spark.conf.set(_LISTING, str(max(LEAST_LISTING_TASKS, 4 * spark.sparkContext.defaultParallelism)))
    return spark


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder under spark.checkpoint.dir.

    Only a local session may leave the setting out; it gets a temporary folder.
    """
    context = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, purpose: str, wide: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back.

    What follows starts from the written rows, and the size of the files tells Spark whether the
    table is small enough to broadcast (`spark.sql.autoBroadcastJoinThreshold`).

    wide: rows hold megabytes each, so that a task may write and read only a few at a time.
    """
    folder = shared_folder(df.sparkSession, purpose)
    df.write.options(**(_WIDE_ROWS if wide else {})).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def materialise_parts(parts: dict[str, DataFrame]) -> list[DataFrame]:
    """Write tables one after the other, so that what one of them shuffled is gone before the next begins."""
    return [materialise(df, purpose) for purpose, df in parts.items()]


def is_broadcast(df: DataFrame) -> bool:
    """Whether Spark broadcasts a written table in a join, by its own rule and the size of the files."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= limit
