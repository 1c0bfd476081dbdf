"""The registered queries of this folder. Each takes (spark, folder) and gives a DataFrame."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from letterloom.llm import (
    decontaminate,
    extraction,
    jaccard,
    langid,
    language_model,
    mixing,
    neighbours,
    quality,
    ranked_search,
    secrets,
    token_counts,
    toxicity,
    whitening,
)
from letterloom.llm.common import remainder
from letterloom.session import tune

#: The vocabulary of op8; any sentencepiece file will do.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{folder}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Documents repeated towards shares that follow mass ** 0.7 of each source, in random order."""
    return mixing.mix_sources(_table(spark, folder, "documents"))


def op2_language_model(spark: SparkSession, folder: str) -> DataFrame:
    """Log-probability of every text; trained on nine of ten documents."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    held_out = remainder(F.col("doc_id"), 10) == 0
    trained = language_model.train(docs.filter(~held_out))
    scored = language_model.score_texts(docs, trained, stored=True)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates and secrets of every document; secrets as begin-end in code points."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    language = secrets.learn_language(docs)
    forest = secrets.train_forest(secrets.plain_findings(docs, language), language)
    found = secrets.scan_secrets(docs, forest, name="scan")
    spans = F.transform("scan.secrets", lambda s: F.concat_ws("-", s["begin"], s["end"]))
    return found.select(
        "doc_id",
        F.col("scan.n_candidates").alias("n_candidates"),
        F.size("scan.secrets").cast("long").alias("n_secrets"),
        F.array_join(spans, ",").alias("spans"),
        F.array_max(F.transform("scan.secrets", lambda s: s["score"])).alias("max_score"),
    )


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document by its nearest labelled ones; a third is never learned from."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    held_out = remainder(F.col("doc_id"), 3) == 1
    labels = _table(spark, folder, "labels").select("doc_id", "toxic").filter(~held_out)
    scored = toxicity.score_toxicity(docs, toxicity.train(docs, labels), name="toxicity")
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("toxicity.score").alias("score"),
        F.col("toxicity.predicted").alias("predicted"),
        F.array_join("toxicity.evidence", " ").alias("evidence"),
    )


def op5_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that stand in passages of the benchmark."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.find_passages(docs, _table(spark, folder, "benchmark"), name="found")
    return found.withColumn("digest", decontaminate.contamination("found")).select("doc_id", "digest.*")


def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document; a quarter is never learned from."""
    docs = _table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = remainder(F.col("doc_id"), 4) == 2
    trees = langid.learn(docs.filter(~held_out))
    found = langid.predict_language(docs.select("doc_id", "text"), trees, name="language")
    return found.select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"),
    )


def op7_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    pages = _table(spark, folder, "pages").select("page_id", "url", "html")
    return extraction.extract_text(pages, name="main").select("page_id", "url", "main.text", "main.n_chars")


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document under a public vocabulary."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, token_counts.read_pieces(VOCABULARY), name="tokens")
    return counted.select("doc_id", "tokens.n_tokens", "tokens.n_words")


def op9_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest vectors found for one vector in 20, out of all."""
    vectors = _table(spark, folder, "embeddings").select("vec_id", "embedding")
    return neighbours.search(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


def op10_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the group of near copies it is in."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return jaccard.similar_groups(docs).select("doc_id", "n_shingles", "component_id", "class_id", "n_links")


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector on the first eight principal components of all, with unit variance."""
    return whitening.whiten(_table(spark, folder, "embeddings").select("vec_id", "embedding"))


def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents for every item of the benchmark."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return ranked_search.search(docs, _table(spark, folder, "benchmark").select("item_id", "text"))


def op13_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document by the passages that matter; a fifth is never learned from."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    held_out = remainder(F.col("doc_id"), 5) == 0
    labels = _table(spark, folder, "labels").select("doc_id", "quality").filter(~held_out)
    scored = quality.score_quality(docs, quality.train(docs, labels), name="quality")
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("quality.score").alias("score"),
        F.col("quality.predicted").alias("predicted"),
        F.col("quality.n_passages").alias("n_passages"),
        F.col("quality.top_passage").alias("top_passage"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mix_sources,
        op2_language_model,
        op3_secret_scan,
        op4_toxicity,
        op5_decontaminate,
        op6_language,
        op7_main_text,
        op8_token_counts,
        op9_neighbours,
        op10_jaccard_join,
        op11_whitening,
        op12_ranked_search,
        op13_quality,
    )
}
