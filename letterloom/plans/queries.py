"""One registered query per operator. Each takes (spark, folder) and gives a DataFrame."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from letterloom.constants import FILLER_WORDS
from letterloom.operators import checks, extract, intake, lines, matching, phrases, profile, roles, templates, voice
from letterloom.operators.answers import complete_logged
from letterloom.operators.completion import (
    complete,
    generation_prompt,
    strategy_prompt,
    with_tier,
)
from letterloom.operators.matching import default_style
from letterloom.operators.records import keep_declared, split_valid, validate_records
from letterloom.plans import phases
from letterloom.plans.fixtures import LEXICON, WORD_PAIRS, Tables
from letterloom.schemas import USER_PROFILE
from letterloom.session import materialise, materialise_parts, shared_folder, tune
from letterloom.sources import files, sinks, store
from letterloom.streaming.postings import incremental_postings, posting_stream, with_saved_records

Query = Callable[[Tables], DataFrame]

SECTIONS = ["Salary", "Hiring manager", "About", "Responsibilities", "Required", "Preferred"]
VALUE_WORDS = ["ownership", "autonomy", "value"]
VERBS = ["Delivered", "Built", "Reduced"]
AS_OF_M = 12 * 2002 + 1
LETTER_KEYS = ["application_id", "turn"]
HINTS = {"leverage": ["use", "the"], "utilize": ["avec"]}
OUTPUT_PARAGRAPH = r"\n"

_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: fn(Tables(tune(spark), folder))

    return {name: bind(fn) for name, fn in _QUERIES.items()}


def _joined(column: str, by: str = ", ") -> Column:
    return F.array_join(F.col(column), by)


# Sources


@query
def read_samples(t: Tables) -> DataFrame:
    """Samples written as one file per document and read back whole."""
    folder = shared_folder(t.spark, "samples")
    sinks.write_texts(t.samples(), folder, "doc_id")
    read = files.read_samples(t.spark, folder, "cover_letter")
    return read.select(
        sinks.key_of_text(read, "doc_id").alias("doc_id"),
        "kind",
        F.length("text").alias("n_chars"),
        F.sha2("text", 256).alias("text_hash"),
    )


@query
def read_postings(t: Tables) -> DataFrame:
    """Postings written as one file each and read back whole."""
    folder = shared_folder(t.spark, "postings")
    t.postings().write.partitionBy("job_id").text(folder)
    return files.read_postings(t.spark, folder).select(
        F.col("job_id").cast("long").alias("job_id"),
        extract.labelled(F.col("text"), "Company").alias("company_name"),
        F.size(extract.items(F.col("text"), "Required")).alias("n_required"),
    )


@query
def read_profiles(t: Tables) -> DataFrame:
    """Profiles split into valid records and rejected ones."""
    valid, invalid = split_valid(t.profile_json(), "json", USER_PROFILE, "profile")
    good = valid.select(
        "applicant_id",
        F.lit(True).alias("is_valid"),
        F.col("profile.email").alias("email"),
        F.element_at("profile.skills", -1).alias("last_skill"),
        F.element_at("profile.education", 1)["graduation_year"].alias("graduation_year"),
        F.lit(0).alias("n_violations"),
    )
    bad = invalid.select(
        "applicant_id",
        F.lit(False).alias("is_valid"),
        F.lit("").alias("email"),
        F.lit("").alias("last_skill"),
        F.lit(0.0).alias("graduation_year"),
        F.size("violations").alias("n_violations"),
    )
    return good.unionByName(bad)


@query
def read_templates(t: Tables) -> DataFrame:
    """One template file per posting, read back with its holes."""
    folder = shared_folder(t.spark, "templates")
    text = F.concat(F.lit("{{NAME}} for "), extract.labelled(F.col("text"), "Company"), F.lit(" {{SKILLS}}"))
    t.postings().select("job_id", text.alias("text")).write.partitionBy("job_id").text(folder)
    return files.read_templates(t.spark, folder).select(
        F.col("job_id").cast("long").alias("job_id"),
        "text",
        F.array_join(templates.placeholders(F.col("text")), ", ").alias("keys"),
    )


@query
def read_style_cache(t: Tables) -> DataFrame:
    folder = shared_folder(t.spark, "styles")
    voice.input_inventory(t.samples()).write.parquet(folder)
    return files.read_style_cache(t.spark, folder)


@query
def load_fetched(t: Tables) -> DataFrame:
    return files.load_fetched(t.fetched()).select(
        "page_id", "url", "status", F.length("body").alias("n_chars")
    )


# Sinks


def _latest(t: Tables) -> DataFrame:
    return profile.latest_wins(t.facts(), ["applicant_id", "field"], ["ts", "event_id"])


@query
def write_state(t: Tables) -> DataFrame:
    """A first version with the earliest facts, then one in which newer clicks replace the old ones."""
    keys = ["applicant_id", "field"]
    newest = _latest(t).select(*keys, "event_id")
    first = t.facts().groupBy(*keys).agg(F.min("event_id").alias("event_id"))
    old, new = (shared_folder(t.spark, f"facts-{v}") for v in ("v1", "v2"))
    sinks.write_state(first, old, keys)
    sinks.write_state(newest.filter(F.col("field") == "click"), new, keys, previous=old)
    return sinks.read_state(t.spark, new)


@query
def update_store(t: Tables) -> DataFrame:
    """The earliest facts in a keyed store, of which two updates replace some."""
    keys = ["applicant_id", "field"]
    folder = shared_folder(t.spark, "fact-store")
    newest = _latest(t).select(*keys, "event_id")
    first = t.facts().groupBy(*keys).agg(F.min("event_id").alias("event_id"))
    store.update_store(first, folder, keys, buckets=16)
    store.update_store(newest.filter(F.col("field") == "click"), folder, keys)
    store.update_store(newest.filter(F.col("applicant_id") == 7), folder, keys)
    return store.read_store(t.spark, folder)


@query
def read_store_version(t: Tables) -> DataFrame:
    """The same store as it was after its first update."""
    keys = ["applicant_id", "field"]
    folder = shared_folder(t.spark, "fact-store")
    first = t.facts().groupBy(*keys).agg(F.min("event_id").alias("event_id"))
    number = store.update_store(first, folder, keys, buckets=16)
    store.update_store(_latest(t).select(*keys, "event_id"), folder, keys)
    return store.read_store(t.spark, folder, version=number)


@query
def write_profile(t: Tables) -> DataFrame:
    """Both copies of the valid profiles, read back and compared."""
    valid, _ = split_valid(t.profile_json(), "json", USER_PROFILE, "profile")
    editable, debug = shared_folder(t.spark, "profiles"), shared_folder(t.spark, "profiles-debug")
    sinks.write_profile(valid, editable, debug)
    edited = t.spark.read.schema(valid.schema).json(editable)
    kept = t.spark.read.parquet(debug)
    return edited.join(kept.withColumnRenamed("profile", "kept"), "applicant_id").select(
        "applicant_id",
        F.col("profile.name").alias("name"),
        (F.to_json("profile") == F.to_json("kept")).alias("same"),
    )


@query
def write_outputs(t: Tables) -> DataFrame:
    """Letters by job slug; the slugs of even jobs are written again and replace the first copy."""
    folder = shared_folder(t.spark, "outputs")
    slug = intake.job_slug(F.concat(F.lit("Company "), F.col("job_id").cast("string")), F.lit("Planner"))
    letters = t.letters().select(*LETTER_KEYS, "job_id", "text", slug.alias("job_slug"))
    sinks.write_outputs(letters.withColumn("version", F.lit(1)), folder)
    again = letters.filter(F.col("job_id") % 2 == 0).withColumn("version", F.lit(2))
    sinks.write_outputs(again, folder)
    return t.spark.read.parquet(folder).select(*LETTER_KEYS, "job_slug", "version")


@query
def write_posting_cache(t: Tables) -> DataFrame:
    folder = shared_folder(t.spark, "fetched")
    keyed = phases.postings_from_pages(t.fetched())
    once = intake.top_rows(keyed, ["identity"], [F.col("page_id").asc()], 1)
    sinks.write_posting_cache(once, folder)
    return t.spark.read.parquet(folder).select(
        "url_key", "page_id", F.length("text").alias("n_chars")
    )


@query
def to_pretty_json(t: Tables) -> DataFrame:
    rows = t.requirements().withColumn("record", F.struct("job_id", "skill", "level"))
    return sinks.to_pretty_json(rows, "record").select("job_id", "rnk", "json")


# Filters, routing, validation


@query
def visible_only(t: Tables) -> DataFrame:
    return intake.visible_only(t.sample_files(), "file_name").select("doc_id", "file_name")


@query
def route_sources(t: Tables) -> DataFrame:
    return intake.route_sources(t.requests(), "source").select("page_id", "source", "route")


@query
def accept_pages(t: Tables) -> DataFrame:
    judged = intake.accept_pages(t.fetched())
    return judged.select(
        "page_id", "status", F.coalesce("reject_reason", F.lit("")).alias("reject_reason")
    )


@query
def page_text(t: Tables) -> DataFrame:
    return t.pages().select("page_id", intake.page_text(F.col("html")).alias("text"))


@query
def url_key(t: Tables) -> DataFrame:
    urls = t.requests().filter(F.lower("source").startswith("http"))
    return urls.select(
        "page_id",
        intake.url_key(F.col("source")).alias("url_key"),
        intake.posting_file(F.col("source")).alias("file_name"),
    )


@query
def job_slug(t: Tables) -> DataFrame:
    title = F.regexp_extract("text", r"^([^\n]*)", 1)
    return t.samples().select(
        "doc_id", intake.job_slug(F.col("author_id"), title).alias("job_slug")
    )


@query
def validate_profiles(t: Tables) -> DataFrame:
    return validate_records(t.profile_json(), "json", USER_PROFILE, ["applicant_id"])


@query
def keep_declared_fields(t: Tables) -> DataFrame:
    kept = keep_declared(t.profile_json(), "json", USER_PROFILE, "profile")
    return kept.select(
        "applicant_id",
        F.coalesce("profile.name", F.lit("")).alias("name"),
        (~F.coalesce(F.to_json("profile"), F.lit("")).contains("hobby")).alias("declared_only"),
    )


@query
def dry_run_report(t: Tables) -> DataFrame:
    people = t.read("customer").select(F.col("c_custkey").alias("applicant_id"))
    requests = people.withColumn("posting_found", F.col("applicant_id") % 9 != 0)
    owner = F.col("doc_id") - F.col("doc_id") % 3
    documents = t.samples().select(owner.alias("applicant_id"), "kind")
    valid, invalid = split_valid(t.profile_json(), "json", USER_PROFILE, "profile")
    judged = valid.select("applicant_id", F.lit(True).alias("is_valid")).unionByName(
        invalid.select("applicant_id", F.lit(False).alias("is_valid"))
    )
    saved = judged.filter(F.col("applicant_id") % 2 == 0)
    return intake.dry_run_report(documents, requests, saved)


@query
def key_collisions(t: Tables) -> DataFrame:
    keyed = t.samples().select(
        "doc_id",
        intake.job_slug(F.col("author_id"), F.regexp_extract("text", r"^([^ ]*)", 1)).alias("key"),
    )
    return intake.key_collisions(keyed, "key", "doc_id")


# Joins


@query
def assemble(t: Tables) -> DataFrame:
    jobs = t.read("supplier").select(F.col("s_suppkey").alias("job_id"), F.col("s_name").alias("company_name"))
    people = t.read("customer").select(F.col("c_custkey").alias("applicant_id"), F.col("c_name").alias("name"))
    cached = t.read("customer").select(F.col("c_custkey").alias("applicant_id")).filter(F.col("applicant_id") % 4 > 0)
    styles = cached.withColumn("style", F.concat(F.lit("style "), F.col("applicant_id").cast("string")))
    return matching.assemble(t.applications(), jobs, people, styles).select(
        "applicant_id", "job_id", "company_name", "name", F.coalesce("style", F.lit("")).alias("style")
    )


@query
def style_or_default(t: Tables) -> DataFrame:
    authors = t.samples().select("author_id").distinct()
    measured = t.style_cache().withColumn("style", matching.default_style())
    styled = matching.style_or_default(authors, measured)
    return styled.select(
        "author_id",
        F.col("style.voice_profile.tone").alias("tone"),
        F.array_join("style.resume_structure_preferences.section_ordering", ", ").alias("sections"),
        "is_default",
    )


@query
def split_cached(t: Tables) -> DataFrame:
    reused, again = matching.split_cached(t.samples(), t.style_cache(), ["author_id"])
    return (
        reused.withColumn("action", F.lit("reuse"))
        .unionByName(again.withColumn("action", F.lit("measure")))
        .groupBy("author_id", "action")
        .agg(F.count(F.lit(1)).alias("n_docs"))
    )


@query
def skill_match(t: Tables) -> DataFrame:
    return matching.skill_match(t.applications(), t.requirements(), t.skills())


@query
def skill_gap(t: Tables) -> DataFrame:
    return matching.skill_gap(t.applications(), t.requirements(), t.skills())


@query
def coverage(t: Tables) -> DataFrame:
    return matching.coverage(t.applications(), t.requirements(), t.skills())


@query
def transferable(t: Tables) -> DataFrame:
    gap = matching.skill_gap(t.applications(), t.requirements(), t.skills())
    return matching.transferable(gap, t.skills(), t.related())


@query
def transferable_by_cover(t: Tables) -> DataFrame:
    gap = matching.skill_gap(t.applications(), t.requirements(), t.skills())
    return matching.transferable_by_cover(gap, t.skills(), t.covers())


@query
def absent_words(t: Tables) -> DataFrame:
    return voice.absent_words(t.samples(), LEXICON, HINTS)


@query
def forbidden_hits(t: Tables) -> DataFrame:
    return checks.forbidden_hits(t.outputs(), [*LEXICON, "der die", "de la"])


@query
def phrase_hits(t: Tables) -> DataFrame:
    """Every document's uses of the phrases that documents open with."""
    texts = t.documents().select("doc_id", "text")
    return phrases.phrase_hits(texts, t.opening_phrases(), ["doc_id"])


@query
def forbidden_by_author(t: Tables) -> DataFrame:
    """Each author's own list: of every word pair the word that they do not prefer."""
    owned = t.outputs().withColumn(
        "author_id", F.concat(F.lit("src"), (F.col("application_id") % 20).cast("string"))
    )
    choices = voice.word_choice(t.samples(), WORD_PAIRS).filter(F.col("preferred") != "")
    other = F.when(F.col("preferred") == F.col("word_a"), F.col("word_b")).otherwise(F.col("word_a"))
    lists = choices.select("author_id", other.alias("phrase"))
    return checks.forbidden_by_author(owned, lists)


@query
def untraceable_numbers(t: Tables) -> DataFrame:
    return checks.untraceable_numbers(t.outputs_num(), t.bullets(), "role_id")


@query
def untraceable_entities(t: Tables) -> DataFrame:
    known = t.skills().select("applicant_id", F.lit("skill").alias("kind"), F.col("skill").alias("value"))
    return checks.untraceable_entities(t.claims(), known)


@query
def link_bullets(t: Tables) -> DataFrame:
    return matching.link_bullets(t.bullets(), t.requirements())


# Aggregations


@query
def input_inventory(t: Tables) -> DataFrame:
    return voice.input_inventory(t.samples())


@query
def concat_samples(t: Tables) -> DataFrame:
    named = intake.visible_only(t.sample_files(), "file_name")
    parts = voice.concat_samples(named, "file_name", "doc_id", max_chars=50_000)
    return parts.select(
        "author_id",
        "part_no",
        "n_docs",
        F.length("text").alias("n_chars"),
        F.sha2("text", 256).alias("text_hash"),
    )


@query
def sentence_profile(t: Tables) -> DataFrame:
    return voice.sentence_profile(t.samples())


@query
def formatting_habits(t: Tables) -> DataFrame:
    return voice.formatting_habits(t.samples(), OUTPUT_PARAGRAPH)


@query
def usual_opener(t: Tables) -> DataFrame:
    return voice.usual_opener(t.samples())


@query
def usual_sign_off(t: Tables) -> DataFrame:
    return voice.usual_sign_off(t.samples())


@query
def recurring_patterns(t: Tables) -> DataFrame:
    return voice.recurring_patterns(t.samples(), keep_weak=True).groupBy(
        "author_id", "signal", "n_docs"
    ).agg(
        F.count(F.lit(1)).alias("n_phrases"),
        F.min("phrase").alias("first_phrase"),
        F.max("phrase").alias("last_phrase"),
    )


@query
def majority_value(t: Tables) -> DataFrame:
    languages = t.read("documents").select(F.col("source").alias("author_id"), "lang")
    return voice.majority_value(languages, ["author_id"], "lang")


@query
def word_choice(t: Tables) -> DataFrame:
    return voice.word_choice(t.samples(), WORD_PAIRS)


@query
def distinct_skills(t: Tables) -> DataFrame:
    return profile.distinct_skills(t.skill_mentions())


@query
def merge_bullets(t: Tables) -> DataFrame:
    return profile.merge_bullets(t.bullets())


@query
def resolve_roles(t: Tables) -> DataFrame:
    """The role of every mention, over all resumes of a person."""
    return roles.resolve_roles(t.role_mentions(), AS_OF_M)


@query
def merge_roles(t: Tables) -> DataFrame:
    """Every role once, with its newest values and how many bullets all its mentions have together."""
    mentions = t.role_mentions()
    resolved = materialise(roles.resolve_roles(mentions, AS_OF_M), "resolved")
    merged = roles.merge_roles(mentions, resolved, ["version", "mention_id"])
    keys = ["applicant_id", "role_ref"]
    counts = roles.merge_role_bullets(t.mention_bullets(), resolved).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_bullets"), F.max("text").alias("last_bullet")
    )
    merged, counts = materialise_parts({"merged": merged, "counts": counts})
    return merged.join(counts, keys, "left").select(
        *keys, "n_mentions", "title", "company", F.coalesce("location", F.lit("")).alias("location"),
        F.coalesce("start_m", F.lit(0)).alias("start_m"), F.coalesce("end_m", F.lit(0)).alias("end_m"),
        F.coalesce("n_bullets", F.lit(0)).alias("n_bullets"), F.coalesce("last_bullet", F.lit("")).alias("last_bullet"),
    )


@query
def metric_habits(t: Tables) -> DataFrame:
    return profile.metric_habits(t.bullets(), ["role_id"])


@query
def density(t: Tables) -> DataFrame:
    return profile.density(t.bullets(), t.roles())


@query
def section_order(t: Tables) -> DataFrame:
    owned = t.postings().select(F.expr("job_id div 5").cast("string").alias("author_id"), "text")
    return voice.section_order(owned, SECTIONS)


@query
def page_budget(t: Tables) -> DataFrame:
    return profile.page_budget(t.roles(), AS_OF_M)


def _posted_letters(t: Tables) -> DataFrame:
    """Letters as outputs of a job, with their text."""
    return t.letters().select(*LETTER_KEYS, "job_id", "text")


@query
def ats_coverage(t: Tables) -> DataFrame:
    return checks.ats_coverage(_posted_letters(t), t.requirements(), LETTER_KEYS)


@query
def culture_repeats(t: Tables) -> DataFrame:
    return extract.culture_repeats(t.postings(), ["job_id"], VALUE_WORDS)


# Rankings


@query
def latest_wins(t: Tables) -> DataFrame:
    return _latest(t).select("applicant_id", "field", "value", "event_id")


@query
def top_roles(t: Tables) -> DataFrame:
    links = matching.link_bullets(t.bullets(), t.requirements(), distinct=False)
    return matching.top_roles(t.applications(), t.requirements(), links, t.roles())


@query
def top_bullets(t: Tables) -> DataFrame:
    return matching.top_bullets(t.bullets()).select("role_id", "bullet_rank", "bullet_no", "text")


@query
def top_transitions(t: Tables) -> DataFrame:
    return voice.top_transitions(t.samples())


@query
def hook_pairs(t: Tables) -> DataFrame:
    links = matching.link_bullets(t.bullets(), t.requirements(), distinct=False)
    return matching.hook_pairs(t.applications(), t.requirements(), links, t.roles())


@query
def sentence_variation(t: Tables) -> DataFrame:
    return voice.sentence_variation(t.outputs())


@query
def requirement_rank(t: Tables) -> DataFrame:
    return extract.requirement_rank(t.postings(), ["job_id"])


@query
def order_sections(t: Tables) -> DataFrame:
    parts = extract.posting_sections(t.postings(), ["job_id"])
    return profile.order_sections(
        parts.select("job_id", "section"), "section", ["Required", "Preferred", "Responsibilities"]
    )


# Set operations


@query
def preferred_only(t: Tables) -> DataFrame:
    return matching.preferred_only(t.listed_requirements())


@query
def skills_to_list(t: Tables) -> DataFrame:
    preferred = t.requirements().filter(F.col("level") == "preferred")
    highlighted = matching.skill_match(t.applications(), preferred, t.skills())
    return matching.skills_to_list(highlighted, t.applications(), t.requirements(), t.skills())


@query
def all_postings(t: Tables) -> DataFrame:
    keyed = phases.postings_from_pages(t.fetched()).select("identity", "url_key", "page_id", "text")
    local = t.read("pages").filter(F.col("page_id") % 5 == 0).select(
        intake.posting_identity(F.col("url"), F.col("html")).alias("identity"),
        intake.url_key(F.col("url")).alias("url_key"),
        "page_id",
        F.col("html").alias("text"),
    )
    every = intake.all_postings(keyed, local, "identity", ["page_id"])
    return every.select("url_key", "origin", "page_id", F.length("text").alias("n_chars"))


@query
def dedup_documents(t: Tables) -> DataFrame:
    once = intake.dedup_documents(t.samples(), ["author_id"], "text", "doc_id")
    return once.select("author_id", "doc_id", "text_hash")


# Extraction


@query
def posting_header(t: Tables) -> DataFrame:
    return extract.posting_header(t.postings(), ["job_id"])


@query
def remote_policy(t: Tables) -> DataFrame:
    return t.postings().select("job_id", extract.remote_policy(F.col("text")).alias("remote_policy"))


@query
def posting_facts(t: Tables) -> DataFrame:
    """What postings in several styles say."""
    facts = t.styled_postings().select("job_id", lines.posting_facts(F.col("text")).alias("f"))
    listed = [_joined(f"f.{c}", "|").alias(c) for c in ("responsibilities", "required", "preferred")]
    names = ["job_title", "company_name", "location", "pay", "about"]
    return facts.select("job_id", *[F.col(f"f.{c}").alias(c) for c in names], *listed)


@query
def read_lines(t: Tables) -> DataFrame:
    """Every line of these postings with its kind and section."""
    return lines.read_lines(t.styled_postings(), ["job_id"])


@query
def unread_lines(t: Tables) -> DataFrame:
    return lines.unread_lines(t.styled_postings(), ["job_id"])


@query
def salary_range(t: Tables) -> DataFrame:
    return extract.salary_range(t.postings(), ["job_id"])


@query
def section_items(t: Tables) -> DataFrame:
    return extract.section_items(t.postings(), ["job_id"])


@query
def seniority(t: Tables) -> DataFrame:
    return extract.seniority(t.postings(), ["job_id"])


@query
def contacts(t: Tables) -> DataFrame:
    return profile.contacts(t.samples()).select("doc_id", "email", "phone", "linkedin")


@query
def skill_mentions(t: Tables) -> DataFrame:
    return profile.skill_mentions(t.bullets(), t.vocabulary(), ["role_id", "bullet_no"])


@query
def education_rows(t: Tables) -> DataFrame:
    return profile.education_rows(t.resumes(), ["role_id"])


@query
def role_rows(t: Tables) -> DataFrame:
    return profile.role_rows(t.resumes(), ["role_id"])


@query
def resume_rows(t: Tables) -> DataFrame:
    """Roles, degrees and lines left over of resumes in several styles."""
    resumes, keys = t.styled_resumes(), ["role_id"]
    degrees = profile.education_rows(resumes, keys).select(*keys, "degree", "school", "graduation_year")
    left = profile.unread_items(resumes, keys).withColumnRenamed("item", "unread")
    return profile.role_rows(resumes, keys).join(degrees, "role_id").join(left, "role_id")


@query
def role_dates(t: Tables) -> DataFrame:
    dated = profile.role_dates(profile.role_rows(t.resumes(), ["role_id"]), "start", "end")
    return dated.select(
        "role_id",
        "start_date",
        "end_date",
        "is_current",
        F.date_format("start_day", "yyyy-MM-dd").alias("start_day"),
    )


@query
def salutation(t: Tables) -> DataFrame:
    return extract.salutation(t.postings(), ["job_id"])


@query
def group_skills(t: Tables) -> DataFrame:
    return profile.group_skills(t.skills(), t.categories())


# Output checks


@query
def length_check(t: Tables) -> DataFrame:
    return checks.length_check(t.outputs())


@query
def banned_openings(t: Tables) -> DataFrame:
    letters = t.letters().select(*LETTER_KEYS, "text")
    return checks.banned_openings(letters, paragraph=2)


@query
def banned_closings(t: Tables) -> DataFrame:
    letters = t.letters().select(*LETTER_KEYS, "text")
    return checks.banned_closings(letters, paragraph=-2)


@query
def bullet_check(t: Tables) -> DataFrame:
    return checks.bullet_check(t.samples().select("doc_id", "text"))


@query
def structure_check(t: Tables) -> DataFrame:
    letters = t.letters().select(*LETTER_KEYS, "text")
    return checks.structure_check(letters, frame=2)


@query
def summary_check(t: Tables) -> DataFrame:
    return checks.summary_check(t.samples().select("doc_id", "text"))


@query
def verb_lead(t: Tables) -> DataFrame:
    return checks.verb_lead(t.bullets(), VERBS)


def _strategies(t: Tables) -> DataFrame:
    return matching.strategise(
        t.applications(), t.requirements(), t.skills(), t.related(), t.roles(), t.bullets()
    )


@query
def cardinality_check(t: Tables) -> DataFrame:
    return matching.cardinality_check(_strategies(t))


@query
def education_unchanged(t: Tables) -> DataFrame:
    known = t.skills().select("applicant_id", F.lit("skill").alias("kind"), F.col("skill").alias("value"))
    return checks.education_unchanged(t.claims(), known, ["applicant_id", "kind", "value"])


def _job_details(t: Tables) -> DataFrame:
    text = F.col("text")
    return t.postings().select(
        "job_id",
        extract.labelled(text, "Company").alias("company_name"),
        extract.items(text, "Responsibilities").alias("details"),
    )


@query
def company_specific(t: Tables) -> DataFrame:
    return checks.company_specific(_posted_letters(t), _job_details(t), LETTER_KEYS)


def _names(t: Tables) -> DataFrame:
    own = F.when(F.col("c_custkey") % 16 == 0, "Yours,")
    return t.read("customer").select(
        F.col("c_custkey").alias("applicant_id"), F.col("c_name").alias("name"), own.alias("sign_off")
    )


@query
def sign_off_check(t: Tables) -> DataFrame:
    letters = t.letters().select(*LETTER_KEYS, "applicant_id", "text")
    return checks.sign_off_check(letters, _names(t), LETTER_KEYS)


def _letter_report(t: Tables) -> DataFrame:
    """All rules over the letters, which are worked out once."""
    folder = shared_folder(t.spark, "letters")
    t.letters().write.parquet(folder)
    letters = t.spark.read.parquet(folder)
    plain = letters.select(*LETTER_KEYS, "text")
    posted = letters.select(*LETTER_KEYS, "job_id", "text")
    people = _names(t)
    evidence = people.select("applicant_id", F.col("name").alias("text"))
    reports = {
        "length": (checks.length_check(plain).filter("NOT ok"), F.col("n_words")),
        "opening": (checks.banned_openings(plain, paragraph=2), F.col("phrase")),
        "closing": (checks.banned_closings(plain, paragraph=-2), F.col("phrase")),
        "bullets": (checks.bullet_check(plain).filter("NOT ok"), F.col("n_bullets")),
        "structure": (checks.structure_check(plain, frame=2).filter("NOT ok"), F.col("n_paragraphs")),
        "company": (
            checks.company_specific(posted, _job_details(t), LETTER_KEYS).filter("NOT ok"),
            F.lit(""),
        ),
        "sign-off": (
            checks.sign_off_check(
                letters.select(*LETTER_KEYS, "applicant_id", "text"), people, LETTER_KEYS
            ).filter("NOT ok"),
            F.lit(""),
        ),
        "forbidden": (checks.forbidden_hits(plain, FILLER_WORDS + LEXICON[:4]), F.col("phrase")),
        "numbers": (
            checks.untraceable_numbers(
                letters.select(*LETTER_KEYS, "applicant_id", "text"), evidence, "applicant_id"
            ),
            F.col("number"),
        ),
    }
    return checks.rule_report(reports, LETTER_KEYS)


@query
def rule_report(t: Tables) -> DataFrame:
    return _letter_report(t)


@query
def count_violations(t: Tables) -> DataFrame:
    return checks.count_violations(_letter_report(t), ["application_id"])


# Templates


@query
def placeholders(t: Tables) -> DataFrame:
    keys = templates.placeholders(F.col("text"))
    return t.templates().select("template_id", F.array_join(keys, ", ").alias("keys"))


@query
def template_contract(t: Tables) -> DataFrame:
    return templates.template_contract(t.templates()).select(
        "template_id",
        _joined("missing_keys").alias("missing_keys"),
        F.array_join(F.array_sort("extra_keys"), ", ").alias("extra_keys"),
    )


@query
def inject(t: Tables) -> DataFrame:
    return templates.inject(t.templates()).select("template_id", "filled")


@query
def unfilled(t: Tables) -> DataFrame:
    filled = templates.unfilled(templates.inject(t.templates()))
    return filled.select("template_id", _joined("unfilled_keys").alias("unfilled_keys"))


# Prompts and completion


def _people(t: Tables) -> DataFrame:
    return t.read("customer").select(
        F.col("c_custkey").alias("applicant_id"),
        F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("summary")).alias("profile"),
    )


def _assembled(t: Tables) -> DataFrame:
    jobs = phases.ingest(t.postings())
    styled = _people(t).select("applicant_id", matching.default_style().alias("style"))
    return matching.assemble(t.applications(), jobs, _people(t), styled)


def _block_count(prompt: Column) -> Column:
    return F.regexp_count(prompt, F.lit(r"(?:^|\n)## "))


@query
def strategy_prompts(t: Tables) -> DataFrame:
    prompt = strategy_prompt(F.col("job_context"), F.col("profile"), F.col("style"))
    return _assembled(t).select("applicant_id", "job_id", prompt.alias("prompt")).select(
        "applicant_id",
        "job_id",
        _block_count(F.col("prompt")).alias("n_blocks"),
        F.regexp_extract("prompt", r'"company_name" : "([^"]*)"', 1).alias("company_name"),
        F.regexp_extract("prompt", r'"name" : "([^"]*)"', 1).alias("name"),
    )


@query
def generation_prompts(t: Tables) -> DataFrame:
    template = F.when(F.col("job_id") % 2 == 0, F.concat(F.lit("{{SUMMARY}} of "), "job_slug"))
    strategy = F.struct(F.col("job_slug").alias("positioning_angle"))
    prompt = generation_prompt(
        strategy, F.col("style"), F.col("profile"), F.col("job_context"), template
    )
    return _assembled(t).select("applicant_id", "job_id", prompt.alias("prompt")).select(
        "applicant_id",
        "job_id",
        _block_count(F.col("prompt")).alias("n_blocks"),
        F.regexp_extract("prompt", r"\{\{SUMMARY\}\} of ([a-z0-9_]*)", 1).alias("template_slug"),
    )


HEADER_ANSWER = T.StructType(
    [T.StructField("title", T.StringType(), False), T.StructField("n_lines", T.DoubleType(), False)]
)


@query
def complete_prompts(t: Tables) -> DataFrame:
    """A rule stands in for the model: it answers with the first line and the number of lines."""

    def fn(prompt: str, schema: str, tier: str) -> str:
        import json

        lines = prompt.split("\n")
        return json.dumps({"title": lines[0], "n_lines": len(lines), "ignored": tier})

    done = complete(t.postings(), "text", HEADER_ANSWER, fn)
    return done.select("job_id", "answer.title", "answer.n_lines", "attempts", "tier")


@query
def complete_with_retries(t: Tables) -> DataFrame:
    """A stand-in that answers some postings at once and never answers the others rightly."""

    def fn(prompt: str, schema: str, tier: str) -> str:
        if "(Remote)" in prompt:
            raise RuntimeError("no answer")
        return '{"title": "ok", "n_lines": 1}' if "(Hybrid" in prompt else '{"title": 5}'

    done = complete(t.postings(), "text", HEADER_ANSWER, fn, base_delay=0.0)
    return done.select(
        "job_id",
        "attempts",
        F.coalesce("answer.title", F.lit("")).alias("title"),
        F.coalesce("error", F.lit("")).alias("error"),
    )


@query
def answer_log(t: Tables) -> DataFrame:
    """Three runs with one log, over half of the skills and then all: how often each answer was paid."""
    log = shared_folder(t.spark, "answer-log")

    def fn(prompt: str, schema: str, tier: str) -> str:
        import json

        return json.dumps({"title": prompt, "n_lines": 0})

    asked = t.vocabulary()
    for chosen in (asked.filter(F.length("skill") % 2 == 0), asked, asked):
        complete_logged(chosen, "skill", HEADER_ANSWER, fn, log, batch=4).count()
    paid = t.spark.read.parquet(log).select(F.get_json_object("answer_json", "$.title").alias("skill"))
    return paid.groupBy("skill").agg(F.count(F.lit(1)).alias("n_paid"))


@query
def tiers(t: Tables) -> DataFrame:
    phase = F.when(F.col("job_id") % 3 == 0, "ingestion").otherwise("strategy")
    return with_tier(t.applications().withColumn("phase", phase), "phase")


# Phases


@query
def calibrate(t: Tables) -> DataFrame:
    return phases.calibrate(t.samples(), LEXICON, OUTPUT_PARAGRAPH).select(
        *["author_id", "n_docs", "n_sentences", "mean_words", "sd_words", "short_share"],
        *["never_exclaims", "prefers_dashes", "sentences_per_paragraph", "enough_transitions"],
        *["opener", "sign_off"],
        _joined("common_transitions").alias("common_transitions"),
        _joined("forbidden_words").alias("forbidden_words"),
    )


def _profile_rows(t: Tables) -> DataFrame:
    return phases.build_profiles(
        t.resumes(), t.facts(), t.skill_mentions(), t.bullets().select("role_id", "text")
    )


@query
def build_profiles(t: Tables) -> DataFrame:
    rows = _profile_rows(t).withColumn("detail", F.when(F.col("section") != "fact", F.col("detail")).otherwise(""))
    return rows.withColumn("detail", F.coalesce("detail", F.lit("")))


@query
def profile_records(t: Tables) -> DataFrame:
    """What the header and the roles of every person hold together."""
    records = phases.profile_records(_profile_rows(t))
    return records.groupBy("applicant_id").agg(
        F.sum(F.size("profile.skills")).alias("n_skills"),
        F.sum(F.size("profile.experience")).alias("n_roles"),
        F.sum(F.size("profile.bullets")).alias("n_bullets"),
        F.sum(F.size("profile.education")).alias("n_degrees"),
        F.sum(F.size("profile.facts")).alias("n_facts"),
        F.max("profile.name").alias("name"),
    )


@query
def ingest(t: Tables) -> DataFrame:
    job = "job_context"
    return phases.ingest(t.postings()).select(
        "job_id",
        "job_slug",
        f"{job}.job_title",
        f"{job}.seniority_level",
        f"{job}.remote_policy",
        f"{job}.salary_range",
        _joined(f"{job}.key_responsibilities", "|").alias("key_responsibilities"),
        _joined(f"{job}.required_skills", "|").alias("required_skills"),
        _joined(f"{job}.preferred_skills", "|").alias("preferred_skills"),
        _joined(f"{job}.culture_signals", "|").alias("culture_signals"),
    )


@query
def strategise(t: Tables) -> DataFrame:
    roles = F.transform(
        "experiences_to_emphasize",
        lambda r: F.concat_ws(
            ": ", r["title"], r["company"], r["reason"], F.array_join(r["bullets_to_highlight"], "; ")
        ),
    )
    gaps = F.transform(
        "skills_gap_strategy", lambda g: F.concat_ws(": ", g["missing_skill"], g["mitigation"])
    )
    return _strategies(t).select(
        "applicant_id",
        "job_id",
        F.array_join(roles, " | ").alias("roles"),
        _joined("skills_to_highlight", "|").alias("skills"),
        F.array_join(gaps, "|").alias("gaps"),
        _joined("cover_letter_hooks", "|").alias("hooks"),
    )


def _made(t: Tables) -> DataFrame:
    """Documents for every application, with a rule in place of the model."""

    def fn(prompt: str, schema: str, tier: str) -> str:
        import json
        import re

        company = re.search(r'"company_name" : "([^"]*)"', prompt).group(1)
        name = re.search(r'"name" : "([^"]*)"', prompt).group(1)
        return json.dumps(
            {
                "cover_letter": f"Dear {company},\n\n{name}",
                "resume_content": f"# {name}",
                "template_variables": {"NAME": name, "TIER": tier},
            }
        )

    template = F.when(F.col("job_id") % 2 == 0, "{{NAME}} at {{PLACE}} by {{TIER}}")
    assembled = _assembled(t).select(
        "applicant_id",
        "job_id",
        "job_slug",
        F.struct(F.col("job_slug").alias("positioning_angle")).alias("strategy"),
        "style",
        "profile",
        F.col("job_context").alias("job"),
        template.alias("text"),
    )
    return phases.produce(assembled.withColumn("template", F.col("text")), fn, contract=False)


@query
def output_documents(t: Tables) -> DataFrame:
    """All documents written under the slug of their job and read back."""
    folder = shared_folder(t.spark, "documents")
    sinks.write_outputs(phases.output_documents(_made(t), ["applicant_id", "job_id"]), folder)
    return t.spark.read.parquet(folder)


@query
def produce(t: Tables) -> DataFrame:
    return _made(t).select(
        "applicant_id",
        "job_id",
        "job_slug",
        "cover_letter",
        "resume_content",
        F.coalesce("filled", F.lit("")).alias("filled"),
        F.coalesce(_joined("unfilled_keys"), F.lit("")).alias("unfilled_keys"),
        "attempts",
    )


@query
def produce_contract(t: Tables) -> DataFrame:
    """A stand-in that forgets a hole of the template the first time it sees a prompt."""
    seen: set[str] = set()

    def fn(prompt: str, schema: str, tier: str) -> str:
        import json

        wanted = [f for f in json.loads(schema)["fields"] if f["name"] == "template_variables"][0]["type"]
        keys = [f["name"] for f in wanted["fields"]] if wanted["type"] == "struct" else []
        variables = {k: k.lower() for k in (keys if prompt in seen else keys[:-1])}
        seen.add(prompt)
        return json.dumps({"cover_letter": "c", "resume_content": "r", "template_variables": variables})

    record = F.struct(F.col("job_id").cast("string").alias("job"))
    template = F.when(F.col("job_id") % 3 > 0, F.concat(F.lit("{{NAME}} "), F.repeat(F.lit("{{ PLACE }} "), (F.col("job_id") % 3 - 1).cast("int"))))
    assembled = t.postings().select(
        "job_id", *[record.alias(n) for n in ("strategy", "style", "profile", "job")], template.alias("text")
    )
    made = phases.produce(assembled.withColumn("template", F.col("text")), fn, base_delay=0.0)
    return made.select(
        "job_id", F.coalesce("filled", F.lit("")).alias("filled"), "attempts",
        F.size(F.coalesce("unfilled_keys", F.array().cast("array<string>"))).alias("n_unfilled"),
    )


@query
def take_in_new_postings(t: Tables) -> DataFrame:
    """Two runs over a growing folder: the second brings half of the first again, and the rest."""
    source, out, state = (shared_folder(t.spark, n) for n in ("incoming", "taken-in", "progress"))
    url = F.concat(F.lit("https://jobs.example.com/p/"), F.col("job_id").cast("string"))
    posted = t.postings().select("job_id", url.alias("url"), "text")
    schema = "job_id long, url string, text string"
    posted.filter(F.col("job_id") % 3 > 0).write.mode("append").parquet(source)
    incremental_postings(posting_stream(t.spark, source, schema), out, state).awaitTermination()
    posted.filter(F.col("job_id") % 3 < 2).write.mode("append").parquet(source)
    incremental_postings(posting_stream(t.spark, source, schema), out, state).awaitTermination()
    taken = t.spark.read.parquet(out)
    return taken.select("job_id", "url_key", "job_slug", F.size("job_context.required_skills").alias("n_required"))


@query
def take_in_applications(t: Tables) -> DataFrame:
    """Postings asked for by people, with saved profiles and styles; the second run brings copies."""
    source, out, state, people, styles = (
        shared_folder(t.spark, n) for n in ("asked", "prepared", "progress", "profiles", "styles")
    )
    named = t.read("customer").select(
        F.col("c_custkey").alias("applicant_id"), F.struct(F.col("c_name").alias("name")).alias("profile")
    )
    store.update_store(named, people, ["applicant_id"], buckets=16)
    measured = named.filter(F.col("applicant_id") % 4 > 0).select("applicant_id", default_style().alias("style"))
    store.update_store(measured, styles, ["applicant_id"], buckets=16)
    url = F.concat(F.lit("https://jobs.example.com/p/"), F.col("job_id").cast("string"))
    asked = t.applications().join(t.postings(), "job_id").select("job_id", "applicant_id", url.alias("url"), "text")
    schema = "job_id long, applicant_id long, url string, text string"
    for chosen in (F.col("applicant_id") % 3 > 0, F.col("applicant_id") % 3 < 2):
        asked.filter(chosen).write.mode("append").parquet(source)
        incremental_postings(
            posting_stream(t.spark, source, schema), out, state,
            enrich=with_saved_records(people, styles), identity=["identity", "applicant_id"],
        ).awaitTermination()
    return t.spark.read.parquet(out).select(
        "applicant_id", "job_id", "job_slug", F.col("profile.name").alias("name"), "is_default"
    )
