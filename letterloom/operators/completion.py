"""Prompts and the batch completion with a function that the caller supplies."""

import json
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from letterloom.constants import CHEAP_TIER, FIRST_WAIT_SECONDS, MAX_ATTEMPTS, STRONG_TIER
from letterloom.functions.text import pretty_json

Completer = Callable[[str, str, str], str]
"""(prompt, JSON of the schema, tier) -> JSON text of the answer"""


def _block(title: str, body: Column) -> Column:
    return F.concat(F.lit(f"## {title}\n"), body, F.lit("\n"))


def strategy_prompt(job: Column, profile: Column, style: Column) -> Column:
    return F.concat_ws(
        "\n",
        _block("Job Context", pretty_json(job)),
        _block("Applicant Profile", pretty_json(profile)),
        _block("Applicant Writing Style", pretty_json(style)),
    )


def generation_prompt(
    strategy: Column, style: Column, profile: Column, job: Column, template: Column | None = None
) -> Column:
    """The four record blocks, and a template block where the row has a template."""
    blocks = [
        _block("Tailoring Strategy", pretty_json(strategy)),
        _block("Author Writing Voice", pretty_json(style)),
        _block("Applicant Profile", pretty_json(profile)),
        _block("Target Job", pretty_json(job)),
    ]
    if template is not None:
        fenced = F.concat(F.lit("```latex\n"), template, F.lit("\n```"))
        blocks.append(F.when(template.isNotNull(), _block("LaTeX Template", fenced)))
    return F.concat_ws("\n", *blocks)


def with_tier(df: DataFrame, phase: str) -> DataFrame:
    """The cheap tier reads postings, the strong tier does everything else."""
    return df.withColumn("tier", F.when(F.col(phase) == "ingestion", CHEAP_TIER).otherwise(STRONG_TIER))


def complete(
    df: DataFrame,
    prompt: str,
    schema: T.StructType,
    fn: Completer,
    tier: str = CHEAP_TIER,
    max_attempts: int = MAX_ATTEMPTS,
    base_delay: float = FIRST_WAIT_SECONDS,
    fail_fast: bool = False,
    parallelism: int | None = None,
    required: str | None = None,
    required_in: str = "template_variables",
) -> DataFrame:
    """One structured answer per row; adds `answer`, `attempts` and `error`.

    Any failure of `fn`, and any answer that breaks the schema, is tried again after 1 s, 2 s and so
    on. The last error is kept in its row, or ends the job with `fail_fast`. A `tier` column in `df`
    decides over the `tier` argument. `required` names a column of keys that a row's answer must hold as
    texts in its field `required_in`: the schema that `fn` is given asks for these, and an answer without
    one is tried again; a row without keys has the plain schema. The calls are the costly part: `parallelism` bounds how many run
    at a time, and the result should be written before it is used more than once.
    """
    source = df if parallelism is None else df.repartition(parallelism)
    source = source if "tier" in df.columns else source.withColumn("tier", F.lit(tier))
    out = T.StructType(
        [
            *source.schema.fields,
            T.StructField("answer_json", T.StringType()),
            T.StructField("attempts", T.IntegerType()),
            T.StructField("error", T.StringType()),
        ]
    )
    run = _runner(fn, schema, prompt, max_attempts, base_delay, fail_fast, required, required_in)
    answered = source.mapInArrow(run, out)
    return answered.withColumn("answer", F.from_json("answer_json", schema))


def _runner(
    fn: Completer,
    schema: T.StructType,
    prompt: str,
    max_attempts: int,
    base_delay: float,
    fail_fast: bool,
    required: str | None,
    required_in: str,
) -> Callable:
    """The function that runs on the executors. It is self-contained, so it needs no package there."""
    plain = schema.jsonValue()

    def with_keys(keys: list[str] | None) -> dict:
        """The schema of a row, whose map of texts has these keys."""
        if not keys:
            return plain
        texts = [{"name": k, "type": "string", "nullable": False, "metadata": {}} for k in keys]
        wanted = {"type": {"type": "struct", "fields": texts}, "nullable": False}
        return {**plain, "fields": [{**f, **wanted} if f["name"] == required_in else f for f in plain["fields"]]}

    def broken(value: object, kind: object, path: str) -> str | None:
        """The first place where a value breaks its declared type."""
        name = kind if isinstance(kind, str) else kind["type"]
        if name == "string":
            return None if isinstance(value, str) else path
        if name == "array":
            if not isinstance(value, list):
                return path
            inner = ((v, kind["elementType"], f"{path}[{i}]") for i, v in enumerate(value))
        elif name == "map":
            if not isinstance(value, dict):
                return path
            inner = ((v, kind["valueType"], f"{path}.{k}") for k, v in value.items())
        elif name == "struct":
            if not isinstance(value, dict):
                return path
            inner = (
                (value.get(f["name"]), f["type"], f"{path}.{f['name']}")
                for f in kind["fields"]
                if f["name"] in value or not f["nullable"]
            )
        else:
            number = isinstance(value, (int, float)) and not isinstance(value, bool)
            return None if number else path
        return next((found for v, t, p in inner if (found := broken(v, t, p))), None)

    def answer(text: str, level: str, keys: list[str] | None) -> tuple[str | None, int, str | None]:
        declared, error = with_keys(keys), None
        schema_json = json.dumps(declared)
        for attempt in range(1, max_attempts + 1):
            try:
                reply = fn(text, schema_json, level)
                place = broken(json.loads(reply), declared, "$")
                if place:
                    raise ValueError(f"answer breaks the schema at {place}")
                return reply, attempt, None
            except Exception as problem:
                error = f"{type(problem).__name__}: {problem}"
                if attempt < max_attempts:
                    time.sleep(base_delay * 2 ** (attempt - 1))
        if fail_fast:
            raise RuntimeError(error)
        return None, max_attempts, error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, tiers = batch.column(prompt).to_pylist(), batch.column("tier").to_pylist()
            keys = batch.column(required).to_pylist() if required else [None] * len(texts)
            results = [answer(*row) for row in zip(texts, tiers, keys, strict=True)]
            added = [
                pa.array([r[0] for r in results], pa.string()),
                pa.array([r[1] for r in results], pa.int32()),
                pa.array([r[2] for r in results], pa.string()),
            ]
            names = [*batch.schema.names, "answer_json", "attempts", "error"]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=names)

    return run
