"""The phases as whole-table jobs, for users who want more than single operators."""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterloom.constants import (
    FILLER_WORDS,
    FIRST_WAIT_SECONDS,
    MAX_TRANSITIONS,
    MIN_TRANSITIONS,
    STRONG_TIER,
)
from letterloom.functions.ranking import top_rows
from letterloom.functions.text import free_name, has_number, sentence_bodies
from letterloom.operators.answers import complete_logged
from letterloom.operators.completion import Completer, complete, generation_prompt
from letterloom.operators.extract import job_context
from letterloom.operators.intake import accept_pages, job_slug, page_lines, page_text, posting_identity, url_key
from letterloom.operators.profile import (
    distinct_skills,
    education_rows,
    latest_wins,
    merge_bullets,
    role_date,
    role_rows,
)
from letterloom.operators.templates import inject, placeholders, unfilled
from letterloom.operators.voice import (
    habit_columns,
    habit_numbers,
    sentence_columns,
    sentence_numbers,
    opener,
    phrases_used,
    sentence_openings,
    sign_off,
)
from letterloom.schemas import GENERATION_OUTPUT
from letterloom.session import materialise, shared_folder

SENTENCE_SUMS = ("n", "words", "squares", "short", "long", "semicolons")


def calibrate(
    samples: DataFrame,
    lexicon: Sequence[str] = tuple(FILLER_WORDS),
    separator: str = r"\n\s*\n",
    kind: str = "cover_letter",
) -> DataFrame:
    """The measured style of every author, from the samples of one kind.

    Every text is read once: it is turned into a few numbers and short phrases in the scan, and
    identical texts of an author are then counted once by their hash. Phrases and numbers travel as
    tagged rows through one counting step and one ranking step, so there is a single chain of
    shuffles, none of which carries a text.
    """
    text, bodies = F.col("text"), F.col("bodies")
    habits = habit_numbers(text, bodies, separator)
    split = samples.filter(F.col("kind") == kind).withColumn("bodies", sentence_bodies(text))
    measured = split.select(
        "author_id",
        "doc_id",
        F.sha2(text, 256).alias("text_hash"),
        sentence_numbers(bodies).alias("s"),
        F.struct(*[c.alias(n) for n, c in habits.items()]).alias("h"),
        phrases_used(text, lexicon).alias("used"),
        sentence_openings(bodies).alias("openings"),
        opener(text).alias("opener"),
        sign_off(text).alias("sign_off"),
    )
    once = top_rows(measured, ["author_id", "text_hash"], [F.col("doc_id").asc()], 1)
    numbers = {
        "n_docs": F.lit(1),
        **{c: F.col(f"s.{c}") for c in SENTENCE_SUMS},
        **{c: F.col(f"h.{c}") for c in habits},
        **{f"u{i}": F.array_contains("used", w).cast("int") for i, w in enumerate(lexicon)},
    }

    def tagged(tag: str, value: Column) -> Column:
        return F.struct(F.lit(tag).alias("tag"), value.alias("value"))

    facts = F.concat(
        F.array(
            tagged("document", F.lit("")),
            tagged("opener", F.col("opener")),
            tagged("sign_off", F.col("sign_off")),
        ),
        F.transform("openings", lambda p: tagged("transition", p)),
    )
    rows = once.select(
        "author_id",
        F.struct(*[c.cast("long").alias(n) for n, c in numbers.items()]).alias("numbers"),
        F.explode(facts).alias("fact"),
    ).select(
        "author_id",
        "fact.*",
        *[F.when(F.col("fact.tag") == "document", F.col(f"numbers.{n}")).alias(n) for n in numbers],
    )
    counted = rows.groupBy("author_id", "tag", "value").agg(
        F.count(F.lit(1)).alias("support"), *[F.sum(n).alias(n) for n in numbers]
    )
    order = [F.col("support").desc(), F.col("value").asc()]
    best = top_rows(counted, ["author_id", "tag"], order, MAX_TRANSITIONS, rank="place")

    def first(tag: str) -> Column:
        return F.max(F.when((F.col("tag") == tag) & (F.col("place") == 1), F.col("value")))

    transition = F.when(F.col("tag") == "transition", F.struct("place", "value"))
    style = best.groupBy("author_id").agg(
        *[F.max(n).alias(n) for n in numbers],
        first("opener").alias("opener"),
        first("sign_off").alias("sign_off"),
        F.array_sort(F.collect_list(transition))["value"].alias("common_transitions"),
    )
    forbidden = F.filter(
        F.array(*[F.when(F.col(f"u{i}") == 0, F.lit(w)) for i, w in enumerate(lexicon)]),
        lambda w: w.isNotNull(),
    )
    return style.select(
        "author_id",
        "n_docs",
        *sentence_columns(),
        *habit_columns(),
        "opener",
        "sign_off",
        "common_transitions",
        (F.size("common_transitions") >= MIN_TRANSITIONS).alias("enough_transitions"),
        forbidden.alias("forbidden_words"),
    )


def ingest(postings: DataFrame) -> DataFrame:
    """The record of every posting and the slug its documents go under; no shuffle."""
    return (
        postings.withColumn("job_context", job_context(F.col("text")))
        .withColumn(
            "job_slug", job_slug(F.col("job_context.company_name"), F.col("job_context.job_title"))
        )
        .drop("text")
    )


def ingest_distinct(postings: DataFrame, beside: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """As `ingest`, with each different text read once however many rows hold it.

    Texts are told apart by their SHA-256; the records are written and meet the rows by it. Their files
    are far smaller than they are (postings share their words), so Spark is kept from broadcasting them.
    `beside` adds columns to the rows while they have neither text nor record.
    """
    key = free_name(postings, "text_hash")
    hashed = postings.withColumn(key, F.coalesce(F.sha2("text", 256), F.lit("")))
    records = materialise(ingest(hashed.select(key, "text").dropDuplicates([key])), "records")
    columns = [c for c in postings.columns if c != "text"]
    rows = hashed.drop("text")
    rows = beside(rows) if beside else rows
    added = [c for c in rows.columns if c not in (*columns, key)]
    return rows.join(records.hint("merge"), key).select(*columns, "job_context", "job_slug", *added)


def ingest_pages(fetched: DataFrame) -> DataFrame:
    """The records of crawled postings, taken from the lines and lists of their pages."""
    return ingest(postings_from_pages(fetched, page_lines))


def postings_from_pages(fetched: DataFrame, read: Callable[[Column], Column] = page_text) -> DataFrame:
    """Accepted pages as postings under their URL key; `read` makes the text of a page."""
    accepted = accept_pages(fetched).filter(F.col("reject_reason").isNull())
    texts = accepted.withColumn("text", read(F.col("body")))
    named = {"url_key": url_key(F.col("url")), "identity": posting_identity(F.col("url"), F.col("text"))}
    return texts.withColumns(named).drop("body", "reject_reason")


def build_profiles(
    resumes: DataFrame, facts: DataFrame, mentions: DataFrame, bullets: DataFrame
) -> DataFrame:
    """Everything known about every person, as rows (applicant, section, ref, item, detail).

    `resumes(applicant_id, role_id, text)` are texts with one person's name, roles and education,
    `facts(applicant_id, field, value, ts, event_id)` dated values, `mentions(applicant_id, skill)`
    skill mentions and `bullets(role_id, text)` the bullets of the roles.
    """
    keys = ["applicant_id", "role_id"]
    newest = latest_wins(facts, ["applicant_id", "field"], ["ts", "event_id"])
    found = role_rows(resumes, keys)
    text = F.concat_ws(
        " | ", "title", "company", F.nullif("location", F.lit("")), role_date(F.col("start")), role_date(F.col("end"))
    )
    schools = education_rows(resumes, keys)
    merged = merge_bullets(bullets).join(resumes.select(*keys), "role_id")

    def rows(df: DataFrame, section: str, ref: Column, item: Column, detail: Column) -> DataFrame:
        return df.select(
            "applicant_id",
            F.lit(section).alias("section"),
            ref.cast("string").alias("ref"),
            item.alias("item"),
            detail.cast("string").alias("detail"),
        )

    none = F.lit("")
    return (
        rows(newest, "fact", none, F.col("field"), F.col("value"))
        .unionByName(rows(found.select("applicant_id", "name").distinct(), "name", none, F.col("name"), none))
        .unionByName(rows(distinct_skills(mentions), "skill", none, F.col("skill"), none))
        .unionByName(rows(found, "role", F.col("role_id"), text, none))
        .unionByName(
            rows(
                schools.select("applicant_id", "degree", "school", "graduation_year").distinct(),
                "education",
                none,
                F.concat_ws(", ", "degree", "school"),
                F.col("graduation_year"),
            )
        )
        .unionByName(rows(merged, "bullet", F.col("role_id"), F.col("text"), none))
    )


def profile_records(items: DataFrame) -> DataFrame:
    """The rows of a person as records: one header and one record for each role.

    The header has `ref` "" and holds the name, skills, education and facts; the record of a role has
    its id as `ref` and holds the role and its bullets. The shape is the same for people of any
    size, and a person of very many roles is many small records. Facts without a field name are left
    out; give each field once (`latest_wins`), as of several rows the greatest value stays.
    """
    numbers_first = F.when(has_number(F.col("item")), 0).otherwise(1)
    entry = F.struct("section", "ref", numbers_first.alias("rank"), "item", "detail")
    grouped = items.groupBy("applicant_id", "ref").agg(
        F.array_sort(F.collect_list(entry)).alias("items")
    )

    def section(name: str) -> Column:
        return F.filter("items", lambda i: i["section"] == name)

    def texts(name: str) -> Column:
        return F.transform(section(name), lambda i: i["item"])

    # a map has a field once; a field without a name or with several rows keeps its greatest value
    named = F.filter(section("fact"), lambda f: f["item"].isNotNull())

    def value(name: Column) -> Column:
        details = F.transform(F.filter(named, lambda f: f["item"] == name), lambda f: f["detail"])
        return F.struct(name.alias("item"), F.array_max(details).alias("detail"))

    facts = F.transform(F.array_distinct(F.transform(named, lambda f: f["item"])), value)

    return grouped.select(
        "applicant_id",
        "ref",
        F.struct(
            F.get(texts("name"), F.lit(0)).alias("name"),
            texts("skill").alias("skills"),
            F.transform(
                section("role"), lambda r: F.struct(r["ref"].alias("ref"), r["item"].alias("role"))
            ).alias("experience"),
            F.transform(
                section("bullet"), lambda b: F.struct(b["ref"].alias("ref"), b["item"].alias("text"))
            ).alias("bullets"),
            F.transform(
                section("education"),
                lambda e: F.struct(e["item"].alias("degree"), e["detail"].alias("graduation_year")),
            ).alias("education"),
            F.map_from_entries(facts).alias("facts"),
        ).alias("profile"),
    )


def produce(
    assembled: DataFrame,
    fn: Completer,
    tier: str = STRONG_TIER,
    parallelism: int | None = None,
    contract: bool = True,
    log: str | None = None,
    base_delay: float = FIRST_WAIT_SECONDS,
) -> DataFrame:
    """Documents for rows of (strategy, style, profile, job, template), written once and read back.

    `template` may be NULL; then no filled template is made. With `contract` an answer must have a text
    for every hole of its template and is asked for again if it lacks one; without, the holes that
    stay are only reported. The answers are kept as a table in the shared folder, so that no later
    step calls `fn` again; with `log`, a folder of answers that outlives the run, a run that was
    stopped goes on where it was (see `answers.complete_logged`).
    """
    spark = assembled.sparkSession
    prompted = assembled.withColumn(
        "prompt",
        generation_prompt(
            F.col("strategy"), F.col("style"), F.col("profile"), F.col("job"), F.col("template")
        ),
    ).drop("strategy", "style", "profile", "job")
    holes = None
    if contract:
        holes = free_name(prompted, "holes")
        prompted = prompted.withColumn(holes, placeholders(F.col("template")))
    if log is None:
        answered = complete(
            prompted, "prompt", GENERATION_OUTPUT, fn, tier, base_delay=base_delay, parallelism=parallelism, required=holes
        )
    else:
        answered = complete_logged(
            prompted, "prompt", GENERATION_OUTPUT, fn, log, tier, base_delay=base_delay,
            parallelism=parallelism, required=holes,
        )
    folder = shared_folder(spark, "answers")
    answered.drop("prompt", *([holes] if holes else [])).write.parquet(folder)
    kept = spark.read.parquet(folder).select("*", "answer.*").drop("answer", "answer_json")
    return unfilled(inject(kept, "template", "template_variables"))


def output_documents(made: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The documents of `produce` as rows (keys, job_slug, file_name, text), ready to be written."""
    named = {"cover_letter.md": "cover_letter", "resume.md": "resume_content", "resume.tex": "filled"}
    files = [
        F.struct(F.lit(name).alias("file_name"), F.col(text).alias("text"))
        for name, text in named.items()
    ]
    rows = made.select(*keys, "job_slug", F.inline(F.array(*files)))
    return rows.filter(F.col("text").isNotNull())

