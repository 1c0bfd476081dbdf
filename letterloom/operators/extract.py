"""Facts of a posting, taken from its text by rules (see `lines` for how its lines are read)."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterloom.constants import GENERIC_GREETING, NOT_SPECIFIED, WORK_ARRANGEMENTS
from letterloom.functions.text import (
    find_all,
    let,
    literal_texts,
    or_default,
    sentences,
    strip,
    tokens,
)
from letterloom.operators.lines import posting_facts

LEVEL_WORDS = ["Principal", "Staff", "Lead", "Senior", "Junior", "Intern"]
SENIOR_YEARS, MID_YEARS = 6, 3
LEADING = r"(?i)\b(?:lead|leads|leading|mentor|mentoring)\b"


def labelled(text: Column, label: str) -> Column:
    """The rest of the first line that begins with a label, "" if there is none."""
    return strip(F.regexp_extract(text, rf"(?:^|\n){label}:[ \t]*([^\n]*)", 1))


def section_body(text: Column, heading: str) -> Column:
    """The lines after a heading, up to the next line that is neither blank nor a list item."""
    line = r"\n[ \t]*+(?:[-*•][ \t]++[^\n]*+)?(?=\n|$)"
    return F.regexp_extract(text, rf"(?i)(?:^|\n)[ \t]*(?:{heading})[ \t]*:?[ \t]*((?:{line})++)", 1)


def items(text: Column, heading: str) -> Column:
    """The items of a section in their order and wording."""
    return F.transform(find_all(section_body(text, heading), r"\n[ \t]*[-*•][ \t]([^\n]*)", 1), strip)


HEADER = ["job_title", "company_name", "company_description", "location", "team_or_department"]


def posting_header(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    facts = df.select(*keys, posting_facts(F.col(text)).alias("__facts"))
    return facts.select(*keys, *[F.col(f"__facts.{c}").alias(c) for c in HEADER])


def remote_policy(text: Column, location: Column | None = None) -> Column:
    """The work arrangement, from the location if it tells, else from the whole text."""

    remote, hybrid, on_site, unknown = WORK_ARRANGEMENTS

    def told_by(source: Column) -> Column:
        return (
            F.when(source.rlike("(?i)hybrid"), hybrid)
            .when(source.rlike("(?i)remote"), remote)
            .when(source.rlike("(?i)on-?site|in[- ]office"), on_site)
        )

    return F.coalesce(told_by(labelled(text, "Location") if location is None else location), told_by(text), F.lit(unknown))


AMOUNT = r"(?:[$€£][ ]?|(?<=[0-9kK] ?(?:-|–|to) ?))([0-9](?:[0-9.,]*[0-9])?)[ ]?([kK]?)"


def salary_range(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """The pay text as written, and the bounds and currency read from it (NULL where not stated)."""
    df = df.select(*keys, posting_facts(F.col(text))["pay"].alias("__pay"))
    pay = F.col("__pay")
    currency = F.element_at(
        F.map_from_arrays(literal_texts(["$", "€", "£"]), literal_texts(["USD", "EUR", "GBP"])),
        F.nullif(F.regexp_extract(pay, "([$€£])", 1), F.lit("")),
    )

    def bound(i: int) -> Column:
        # signs before three digits group thousands, the last one before one or two is the decimal point
        amount = F.get(find_all(pay, AMOUNT, 1), F.lit(i))
        digits = F.regexp_replace(F.regexp_replace(amount, "[,.](?=[0-9]{3}(?![0-9]))", ""), ",", ".")
        thousands = F.lower(F.get(find_all(pay, AMOUNT, 2), F.lit(i))) == "k"
        return digits.try_cast("double") * F.when(thousands, 1000.0).otherwise(1.0)

    return df.select(
        *keys,
        or_default(pay, NOT_SPECIFIED).alias("salary_range"),
        bound(0).alias("salary_low"),
        bound(1).alias("salary_high"),
        F.coalesce(currency, F.lit("")).alias("currency"),
    )


def section_items(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """One row per listed item: kind, place in its list and wording.

    A skill listed as both required and preferred is only required; the comparison is made inside
    the row, so nothing is shuffled.
    """

    def tagged(kind: str, listed: Column) -> Column:
        return F.transform(
            listed,
            lambda item, i: F.struct(
                F.lit(kind).alias("kind"), (i + 1).alias("position"), item.alias("item")
            ),
        )

    def every(facts: Column) -> Column:
        return F.concat(
            tagged("responsibility", facts["responsibilities"]),
            tagged("required", facts["required"]),
            tagged("preferred", facts["preferred"]),
        )

    return df.select(*keys, F.inline(let(posting_facts(F.col(text)), every)))


def requirement_rank(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Responsibilities with their place in the posting."""
    listed = posting_facts(F.col(text))["responsibilities"]
    return df.select(*keys, F.posexplode(listed).alias("pos", "responsibility")).select(
        *keys, (F.col("pos") + 1).alias("position"), "responsibility"
    )


def seniority_columns(text: Column, title: Column) -> list[Column]:
    word = F.regexp_extract(title, rf"\b({'|'.join(LEVEL_WORDS)})\b", 1)
    years = F.regexp_extract(text, r"([0-9]+)\+? years", 1)
    n_years = years.try_cast("int")
    signals = F.filter(
        F.array(
            F.when(word != "", F.concat(F.lit("title includes "), word)),
            F.when(years != "", F.concat(F.lit("asks for "), years, F.lit("+ years"))),
            F.when(text.rlike(LEADING), F.lit("mentions leading others")),
        ),
        lambda s: s.isNotNull(),
    )
    level = (
        F.when(word != "", word)
        .when(n_years >= SENIOR_YEARS, "Senior")
        .when(n_years >= MID_YEARS, "Mid-level")
        .when(n_years.isNotNull(), "Junior")
        .otherwise(NOT_SPECIFIED)
    )
    return [level.alias("level"), F.array_join(signals, "; ").alias("signals")]


def seniority(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """The level and every signal for it: title word, years asked for, leading others."""
    titled = df.select(*keys, F.col(text).alias("__text"), posting_facts(F.col(text))["job_title"].alias("__title"))
    return titled.select(*keys, *seniority_columns(F.col("__text"), F.col("__title")))


def culture_quotes(about: Column) -> Column:
    """What the posting says about itself in the first person, word for word."""
    return F.filter(F.transform(sentences(about), strip), lambda s: s.rlike(r"(?i)\b(?:we|our|us)\b"))


def job_context(text: Column) -> Column:
    """The whole record of a posting, made from its lines without any shuffle."""

    def record(facts: Column) -> Column:
        level, signals = seniority_columns(text, facts["job_title"])
        return F.struct(
            *[facts[c].alias(c) for c in HEADER],
            facts["responsibilities"].alias("key_responsibilities"),
            facts["required"].alias("required_skills"),
            facts["preferred"].alias("preferred_skills"),
            culture_quotes(facts["about"]).alias("culture_signals"),
            F.concat_ws(" — ", level, F.nullif(signals, F.lit(""))).alias("seniority_level"),
            remote_policy(text, facts["location"]).alias("remote_policy"),
            or_default(facts["pay"], NOT_SPECIFIED).alias("salary_range"),
        )

    return let(posting_facts(text), record)


def salutation(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    named = df.select(*keys, posting_facts(F.col(text))["manager"].alias("__manager"))
    manager = F.col("__manager")
    greeting = F.when(manager != "", F.concat(F.lit("Dear "), manager, F.lit(","))).otherwise(
        GENERIC_GREETING
    )
    return named.select(*keys, greeting.alias("greeting"))


def posting_sections(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """The labelled parts of a posting: one row per line that opens a part, with its list items."""
    parts = find_all(F.col(text), r"(?:^|\n)([A-Z][A-Za-z ]*:[^\n]*+(?:\n- [^\n]*+)*+)", 1)
    return df.select(*keys, F.explode(parts).alias("part")).select(
        *keys,
        F.regexp_extract("part", "^([^:]*):", 1).alias("section"),
        F.regexp_extract("part", r"(?s)^[^:]*:(.*)$", 1).alias("body"),
    )


def culture_repeats(
    df: DataFrame, keys: Sequence[str], terms: Sequence[str], text: str = "text"
) -> DataFrame:
    """Value words of a posting, how often they occur and in how many of its sections."""
    parts = find_all(F.col(text), r"(?:^|\n)([A-Z][A-Za-z ]*:[^\n]*+(?:\n- [^\n]*+)*+)", 1)

    def uses(words: Column, term: str) -> Column:
        return F.size(F.filter(words, lambda w: w == term))

    def found(term: str) -> Column:
        return F.struct(
            F.lit(term).alias("term"),
            F.size(F.filter("parts", lambda p: F.array_contains(tokens(p), term))).alias("n_sections"),
            uses(tokens(F.col(text)), term).alias("n_mentions"),
        )

    rows = F.filter(F.array(*[found(t) for t in terms]), lambda r: r["n_mentions"] > 0)
    return df.withColumn("parts", parts).select(*keys, F.inline(rows))
