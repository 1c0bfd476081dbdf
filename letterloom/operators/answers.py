"""Completion with a log of paid answers, so that a run that was stopped pays none of them twice."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from letterloom.constants import CHEAP_TIER, FIRST_WAIT_SECONDS, MAX_ATTEMPTS
from letterloom.functions.text import free_name
from letterloom.operators.completion import Completer, complete
from letterloom.session import materialise

LOG = "prompt_key string, answer_json string, attempts int, error string"
#: Prompts that one task answers before they are in the log.
BATCH = 16
#: Calls at a time, where the caller names none.
CALLS = 8


def read_log(spark, log: str) -> DataFrame:
    """(prompt_key, answer_json, attempts, error): every prompt once, with its answer if there is one.

    Of several answers, as two tries of one task may leave them, the first in order counts.
    """
    answered = F.col("answer_json").isNotNull()
    return (
        spark.read.schema(LOG)
        .parquet(log)
        .groupBy("prompt_key")
        .agg(
            F.min("answer_json").alias("__answer"),
            F.coalesce(F.min_by("attempts", "answer_json"), F.max("attempts")).alias("attempts"),
            F.max(F.when(~answered, F.col("error"))).alias("__error"),
        )
        .select(
            "prompt_key",
            F.col("__answer").alias("answer_json"),
            "attempts",
            F.when(F.col("__answer").isNull(), F.col("__error")).alias("error"),
        )
    )


def complete_logged(
    df: DataFrame,
    prompt: str,
    schema: T.StructType,
    fn: Completer,
    log: str,
    tier: str = CHEAP_TIER,
    max_attempts: int = MAX_ATTEMPTS,
    base_delay: float = FIRST_WAIT_SECONDS,
    fail_fast: bool = False,
    parallelism: int | None = None,
    batch: int = BATCH,
    required: str | None = None,
    required_in: str = "template_variables",
) -> DataFrame:
    """As `completion.complete`, with a folder of answers that only grows.

    A prompt is known by a hash of its text, tier, schema and required keys. Equal prompts are asked
    once, and those that the log answers are not asked. The rest are asked in rounds of at most about
    `parallelism * batch` prompts, `parallelism` at a time; the answers of a task are in the log when
    it ends, even if its round or the run is lost, so what can be paid twice is what unfinished
    tasks held. Prompts that failed are in the log with their error and are asked again by the next
    run; with `fail_fast` the run ends after the round of the first one. One run at a time may use a log.
    A NULL prompt counts as an empty one.
    """
    spark = df.sparkSession
    calls = parallelism or CALLS
    level = df if "tier" in df.columns else df.withColumn("tier", F.lit(tier))
    key = free_name(level, "prompt_key")
    parts = [F.coalesce(F.col(prompt), F.lit("")), F.col("tier"), F.lit(schema.json()), F.lit(required_in)]
    if required:
        parts.append(F.to_json(F.col(required)))
    keyed = level.withColumn(key, F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256))
    wanted = [F.first(F.coalesce(F.col(prompt), F.lit(""))).alias("prompt"), F.first("tier").alias("tier")]
    if required:
        wanted.append(F.first(required).alias("required"))
    asked = keyed.groupBy(F.col(key).alias("prompt_key")).agg(*wanted)

    spark.createDataFrame([], LOG).write.mode("append").parquet(log)
    known = read_log(spark, log).filter(F.col("answer_json").isNotNull())
    todo = materialise(asked.join(known, "prompt_key", "left_anti"), "prompts")
    rounds = -(-todo.count() // (calls * batch))
    for number in range(rounds):
        part = todo.filter(F.pmod(F.xxhash64("prompt_key"), F.lit(rounds)) == number).repartition(calls)
        answered = complete(
            part, "prompt", schema, fn, tier, max_attempts, base_delay,
            required="required" if required else None, required_in=required_in,
        )
        # with this way to commit, the rows of a finished task stay where the job fails
        (
            answered.select("prompt_key", "answer_json", "attempts", "error")
            .write.mode("append")
            .option("mapreduce.fileoutputcommitter.algorithm.version", "2")
            .parquet(log)
        )
        if fail_fast:
            failed = read_log(spark, log).join(part.select("prompt_key"), "prompt_key", "left_semi")
            first = failed.filter(F.col("answer_json").isNull()).orderBy("prompt_key").first()
            if first:
                raise RuntimeError(first["error"])
    results = read_log(spark, log).withColumnRenamed("prompt_key", key)
    joined = keyed.join(results, key).withColumn("answer", F.from_json("answer_json", schema))
    return joined.select(*level.columns, "answer_json", "attempts", "error", "answer")
