"""Documents to a training mix: toxic ones out, near copies out, benchmark passages out, secrets masked,
sources mixed. Every stage works on all that the one before it kept."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from letterloom.llm import decontaminate, jaccard, mixing, secrets, toxicity
from letterloom.llm.common import free_name, remainder
from letterloom.session import materialise, tune

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the labelled neighbours do not call toxic; labels held out elsewhere stay unused.

    Each row is judged by its text alone, so equal rows share their fate; null and empty texts get the
    score of texts without evidence. Without labels nothing is toxic.
    """
    labels = tune(spark).read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    index = toxicity.train(docs, labels.filter(remainder(F.col("doc_id"), 3) != 1))
    name = free_name(docs, "toxicity")
    scored = toxicity.score_toxicity(docs, index, name=name)
    return scored.filter(F.col(f"{name}.predicted") == 0).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that with the smallest id; of equal ids any one.

    Rows are told apart by a number of their own, so rows that share an id and rows without one are
    documents like others: a null id counts as larger than all ids. Rows without words all stay.
    """
    row = free_name(docs, "row")
    rows = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = jaccard.similar_groups(rows.select(row, "text"), key=row, counted=False)
    members = groups.select(F.col("doc_id").alias(row), "component_id").join(rows.select(row, "doc_id"), row)
    place = F.struct(F.col("doc_id").isNull(), "doc_id", row)
    first = members.groupBy("component_id").agg(F.min(place)[row].alias("first"))
    extra = members.join(first, "component_id").filter(F.col(row) != F.col("first")).select(row)
    return rows.join(materialise(extra, "extra"), row, "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth stands in the benchmark.

    Null and empty texts have no words and stay; equal rows share their fate.
    """
    benchmark = tune(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    name = free_name(docs, "found")
    found = decontaminate.find_passages(docs, benchmark, name=name)
    verdict = decontaminate.contamination(name)["contaminated"]
    return found.filter(~verdict).select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts (and n_chars counted anew there)."""
    language = secrets.learn_language(docs)
    forest = secrets.train_forest(secrets.plain_findings(docs, language), language)
    name = free_name(docs, "scan")
    scanned = secrets.scan_secrets(docs, forest, name=name)
    redacted = F.col(f"{name}.redacted")
    changed = {"text": F.coalesce(redacted, F.col("text"))}
    if "n_chars" in docs.columns:
        size = F.length(redacted).cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(redacted.isNotNull(), size).otherwise(F.col("n_chars"))
    return scanned.withColumns(changed).select(*docs.columns)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated towards shares that follow mass ** 0.7 of each source, in random order."""
    return mixing.mix_sources(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("mixing", mix_to_weights),
]

#: The toxicity, near-copy and secret stages have no SQL. Tests compare the near-copy, benchmark and mixing
#: stages with brute force and look for planted cases in the rows of all of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of `sf_dir` through all stages, each written to the shared folder."""
    docs = tune(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
