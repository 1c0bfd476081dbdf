"""New postings, each taken in once."""

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pyspark.sql import functions as F

from letterloom.functions.text import strip
from letterloom.operators.intake import posting_identity, url_key
from letterloom.operators.matching import default_style
from letterloom.plans.phases import ingest_distinct
from letterloom.session import materialise
from letterloom.sources.store import touched_rows, update_store


def posting_stream(spark: SparkSession, path: str, schema: str = "url string, text string") -> DataFrame:
    """Postings from the Parquet files of a folder that grows, keyed by their URL."""
    read = spark.readStream.schema(schema).parquet(path)
    return read.filter(strip(F.col("text")) != "").withColumns(
        {"url_key": url_key(F.col("url")), "identity": posting_identity(F.col("url"), F.col("text"))}
    )


def incremental_postings(
    stream: DataFrame,
    out: str,
    checkpoint: str,
    seen: str | None = None,
    enrich: Callable[[DataFrame], DataFrame] | None = None,
    identity: Sequence[str] = ("identity",),
) -> StreamingQuery:
    """Take in all postings that are new since the last run, then stop.

    What was taken in is known by a keyed store in `seen` (`out` with "-seen" behind it), of which a batch
    reads and writes only the buckets of its own identities. So the stream itself holds no state,
    however many postings have ever come, and a late copy is found as well as an early one. Each
    batch has a folder of its own, and the store knows which batch brought an identity: a batch that
    is run again after a failure writes the same rows over what it left. `seen`, `out` and
    `checkpoint` belong together. `enrich` adds saved records to the rows of a batch; one that is marked
    `by_key` gets them before the records of their texts, which are wide, are joined.
    """
    store = seen or f"{out.rstrip('/')}-seen"
    keys = list(identity)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = materialise(batch.dropDuplicates(keys), "batch")
        known = touched_rows(spark, store, rows, keys)
        if known is not None:
            earlier = known.filter(F.col("batch_id") != batch_id).select(*keys)
            rows = materialise(rows.join(earlier.hint("merge"), keys, "left_anti"), "batch")
        early = getattr(enrich, "by_key", False)
        taken_in = ingest_distinct(rows, enrich if early else None)
        (enrich(taken_in) if enrich and not early else taken_in).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        if not rows.isEmpty():
            update_store(rows.select(*keys, F.lit(batch_id).alias("batch_id")), store, keys)

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def with_saved_records(profiles: str, styles: str, key: str = "applicant_id") -> Callable[[DataFrame], DataFrame]:
    """For `enrich`: the saved profile and style of the person that a posting was asked for.

    `profiles` and `styles` are keyed stores (key, profile) and (key, style), of which only the buckets
    of the batch's people are read, as they are at that time. Without a saved style the default
    one is used and flagged; a person without a profile has NULL there. Records that are alike make
    small files, however many there are, so Spark is kept from broadcasting them by the size of these.
    """

    def enrich(batch: DataFrame) -> DataFrame:
        spark = batch.sparkSession
        people = batch.select(key).distinct()
        joined = batch
        for path in (profiles, styles):
            saved = touched_rows(spark, path, people, [key])
            if saved is None:
                raise ValueError(f"there is no store in {path}")
            joined = joined.join(saved.hint("merge"), key, "left")
        return joined.withColumns(
            {"is_default": F.col("style").isNull(), "style": F.coalesce("style", default_style())}
        )

    enrich.by_key = True
    return enrich
