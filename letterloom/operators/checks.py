"""Rules for finished documents. Each check gives one row per text, or one row per broken rule."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterloom.constants import (
    BANNED_CLOSINGS,
    BANNED_OPENINGS,
    DEFAULT_SIGN_OFF,
    MAX_BODY_PARAGRAPHS,
    MAX_LETTER_WORDS,
    MIN_BODY_PARAGRAPHS,
    MIN_LETTER_WORDS,
)
from letterloom.functions.text import (
    BLANK_LINE,
    BULLET_LINE,
    FIRST_PERSON,
    NUMBER,
    find_all,
    let,
    normalised,
    paragraphs,
    sentence_bodies,
    strip,
    tokens,
    word_count,
)
from letterloom.operators.phrases import phrase_hits, phrase_rows


def _kept(df: DataFrame, text: str) -> list[str]:
    return [c for c in df.columns if c != text]


def length_check(
    df: DataFrame,
    low: int = MIN_LETTER_WORDS,
    high: int = MAX_LETTER_WORDS,
    text: str = "text",
) -> DataFrame:
    n = word_count(F.col(text))
    return df.select(*_kept(df, text), n.alias("n_words"), n.between(low, high).alias("ok"))


def _banned(paragraph: Column, phrases: Sequence[str]) -> Column:
    """The phrases in a paragraph, in any case."""
    lowered = F.lower(paragraph)
    found = [F.when(lowered.contains(p.lower()), F.lit(p)) for p in phrases]
    return F.filter(F.array(*found), lambda p: p.isNotNull())


def banned_openings(
    df: DataFrame,
    phrases: Sequence[str] = tuple(BANNED_OPENINGS),
    text: str = "text",
    separator: str = BLANK_LINE,
    paragraph: int = 1,
) -> DataFrame:
    """Stock phrases in the opening paragraph, counted from 1 (2 where a greeting comes first)."""
    opening = F.coalesce(
        F.try_element_at(paragraphs(F.col(text), separator), F.lit(paragraph)), F.lit("")
    )
    return df.select(*_kept(df, text), F.explode(_banned(opening, phrases)).alias("phrase"))


def banned_closings(
    df: DataFrame,
    phrases: Sequence[str] = tuple(BANNED_CLOSINGS),
    text: str = "text",
    separator: str = BLANK_LINE,
    paragraph: int = -1,
) -> DataFrame:
    """Stock phrases in the closing paragraph, counted from the end."""
    return banned_openings(df, phrases, text, separator, paragraph)


def bullet_check(df: DataFrame, text: str = "text") -> DataFrame:
    n = F.regexp_count(F.col(text), F.lit(BULLET_LINE))
    return df.select(*_kept(df, text), n.alias("n_bullets"), (n == 0).alias("ok"))


def structure_check(
    df: DataFrame,
    low: int = MIN_BODY_PARAGRAPHS,
    high: int = MAX_BODY_PARAGRAPHS,
    text: str = "text",
    separator: str = BLANK_LINE,
    frame: int = 0,
) -> DataFrame:
    """Number of body paragraphs; `frame` counts those around the body (greeting, sign-off)."""
    n = F.greatest(F.size(paragraphs(F.col(text), separator)) - frame, F.lit(0))
    return df.select(*_kept(df, text), n.alias("n_paragraphs"), n.between(low, high).alias("ok"))


def summary_check(df: DataFrame, text: str = "text") -> DataFrame:
    """Exactly two sentences and no first person."""
    n = F.size(sentence_bodies(F.col(text)))
    first_person = F.col(text).rlike(FIRST_PERSON)
    return df.select(
        *_kept(df, text),
        n.alias("n_sentences"),
        first_person.alias("first_person"),
        ((n == 2) & ~first_person).alias("ok"),
    )


def verb_lead(df: DataFrame, verbs: DataFrame | Sequence[str], text: str = "text") -> DataFrame:
    """Whether a bullet begins with one of the action verbs, a table (verb) of any size or a sequence."""
    listed = phrase_rows(df.sparkSession, verbs, "verb")
    known = listed.select(F.lower("verb").alias("__first")).distinct().withColumn("__known", F.lit(True))
    first = F.lower(F.regexp_extract(text, r"^[^\p{L}\p{N}]*([\p{L}\p{N}]+)", 1))
    flagged = df.withColumn("__first", first).join(known, "__first", "left")
    return flagged.withColumn("leads_with_verb", F.coalesce("__known", F.lit(False))).drop("__first", "__known")


def forbidden_hits(df: DataFrame, forbidden: DataFrame | Sequence[str], text: str = "text") -> DataFrame:
    """Every use of a forbidden word or phrase of a common list, with its count.

    The list is a table (phrase) of any size, or a short sequence. Rows are told apart by the columns
    besides the text. A phrase without a letter or digit is never found (see `phrases.phrase_hits`).
    """
    return phrase_hits(df, phrase_rows(df.sparkSession, forbidden), _kept(df, text), text)


def forbidden_by_author(
    outputs: DataFrame, forbidden: DataFrame, owner: str = "author_id"
) -> DataFrame:
    """The same with a list per author, `forbidden(author_id, phrase)`.

    The list of an author is one field of their style record, so it fits in a row. A text meets the
    list of its author once and is searched where it is; its words are not shuffled.
    """
    entry = F.struct("phrase", normalised(F.col("phrase")).alias("run"))
    lists = forbidden.groupBy(owner).agg(F.collect_set(entry).alias("entries"))

    def uses(words: Column, run: Column) -> Column:
        phrase = F.split(run, " ")
        starts = F.filter(
            F.transform(words, lambda w, i: F.when(w == F.get(phrase, F.lit(0)), i + 1)), lambda i: i.isNotNull()
        )
        return F.size(F.filter(starts, lambda i: F.slice(words, i, F.size(phrase)) == phrase))

    def counts(words: Column) -> Column:
        return F.transform(
            "entries", lambda e: F.struct(e["phrase"].alias("phrase"), uses(words, e["run"]).alias("n"))
        )

    used = F.filter(let(tokens(F.col("text")), counts), lambda c: c["n"] > 0)
    return outputs.join(lists, owner).select(*_kept(outputs, "text"), F.inline(used))


def untraceable_numbers(outputs: DataFrame, evidence: DataFrame, owner: str) -> DataFrame:
    """Numbers of an output that are nowhere in its owner's own material, digit for digit."""
    found = outputs.select("*", F.explode(F.array_distinct(find_all(F.col("text"), NUMBER))).alias("number"))
    known = evidence.select(owner, F.explode(find_all(F.col("text"), NUMBER)).alias("number")).distinct()
    return found.join(known, [owner, "number"], "left_anti").select(
        *_kept(outputs, "text"), "number"
    )


def untraceable_entities(claims: DataFrame, known: DataFrame) -> DataFrame:
    """Claimed roles, companies or skills that the profile does not hold."""
    keys = ["applicant_id", "kind", "value"]
    return claims.join(known.select(*keys).distinct(), keys, "left_anti")


def _framed(text: Column) -> Column:
    """Words, with the signs that belong to names such as C++ and C#, between single spaces."""
    return F.concat(F.lit(" "), F.array_join(find_all(text, r"[\p{L}\p{N}+#]+"), " "), F.lit(" "))


def ats_coverage(outputs: DataFrame, requirements: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of the required terms that are in an output word for word.

    The required terms of a posting came from one text, so they are one short list per posting; the
    outputs meet that list once and are not copied for every term. Outputs of a posting that requires
    nothing have 0 terms and a NULL share.
    """
    lists = (
        requirements.filter(F.col("level") == "required")
        .groupBy("job_id")
        .agg(F.collect_set(F.lower("skill")).alias("terms"))
    )
    text = _framed(F.lower(F.col("text")))
    none = F.array().cast("array<string>")
    joined = outputs.join(lists, "job_id", "left").withColumn("terms", F.coalesce("terms", none))
    hits = F.size(F.filter("terms", lambda t: text.contains(_framed(t))))
    return joined.select(
        *keys,
        F.size("terms").alias("n_terms"),
        hits.alias("n_found"),
        F.round(F.try_divide(hits, F.size("terms")), 6).alias("share"),
    )


def education_unchanged(written: DataFrame, profile: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that were added to or dropped from the education of the profile.

    Both sides are counted in one grouping, which combines equal rows before the shuffle.
    """
    every = written.select(*keys, F.lit(1).alias("side")).unionByName(
        profile.select(*keys, F.lit(-1).alias("side"))
    )
    return (
        every.groupBy(*keys)
        .agg(F.sum("side").alias("balance"))
        .filter(F.col("balance") != 0)
        .select(*keys, F.when(F.col("balance") > 0, "added").otherwise("dropped").alias("change"))
    )


def company_specific(outputs: DataFrame, jobs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whether a letter names the company and at least one responsibility of the posting.

    `jobs(job_id, company_name, details)` holds the details of a posting as an array. A letter whose
    job is unknown names neither.
    """
    text = F.lower(F.col("text"))
    joined = outputs.join(jobs, "job_id", "left")
    names = F.coalesce(text.contains(F.lower("company_name")), F.lit(False))
    detail = F.coalesce(F.exists("details", lambda d: text.contains(F.lower(d))), F.lit(False))
    return joined.select(
        *keys,
        names.alias("names_company"),
        detail.alias("names_detail"),
        (names & detail).alias("ok"),
    )


def sign_off_check(
    outputs: DataFrame, profiles: DataFrame, keys: Sequence[str], default: str = DEFAULT_SIGN_OFF
) -> DataFrame:
    """Whether the last line is the full name and the line before it the author's closing.

    `profiles(applicant_id, name, sign_off)`; an author without a known closing uses the default,
    and a letter of an unknown author is not signed.
    """
    lines = F.filter(F.split(F.col("text"), "\n"), lambda line: strip(line) != "")
    joined = outputs.join(profiles, "applicant_id", "left").withColumn("lines", lines)
    last = strip(F.coalesce(F.try_element_at("lines", F.lit(-1)), F.lit("")))
    before = strip(F.coalesce(F.try_element_at("lines", F.lit(-2)), F.lit("")))
    signed = F.coalesce(last == F.col("name"), F.lit(False))
    closed = before == F.coalesce("sign_off", F.lit(default))
    return joined.select(
        *keys, signed.alias("signed"), closed.alias("closed"), (signed & closed).alias("ok")
    )


def rule_report(reports: dict[str, tuple[DataFrame, Column]], keys: Sequence[str]) -> DataFrame:
    """All broken rules as rows (keys, rule, detail).

    `reports` maps a rule to the table of its violations and to the text that tells what broke it.
    """
    parts = [
        df.select(*keys, F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))
        for rule, (df, detail) in reports.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def count_violations(report: DataFrame, keys: Sequence[str]) -> DataFrame:
    return report.groupBy(*keys, "rule").agg(F.count(F.lit(1)).alias("n_violations"))
