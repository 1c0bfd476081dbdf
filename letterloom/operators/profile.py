"""Facts about a person, merged from many documents."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterloom.constants import DEFAULT_SECTIONS, ONE_PAGE_YEARS, SKILL_GROUP_LIMIT
from letterloom.functions.ranking import top_rows
from letterloom.functions.text import (
    EDGE_SPACE,
    find_all,
    has_number,
    let,
    literal_texts,
    or_default,
    strip,
    tokens,
)
from letterloom.operators.lines import ITEM
from letterloom.operators.matching import names_term, term_runs, term_table
from letterloom.session import materialise

# the look-behind starts a match only at the beginning of a run, so long runs are read once
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\+?[0-9][0-9 ().-]{7,}[0-9]"
YEARS = r"^[(]?(?:19|20)[0-9]{2}[ ().-]+(?:19|20)[0-9]{2}$"
PHONE_DIGITS = (7, 15)
PROFILE_LINK = r"(?:https?://)?(?:www\.)?linkedin\.com/[A-Za-z0-9_/-]+"
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
CURRENT_WORDS = ["present", "current", "now", "today"]


def latest_wins(facts: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row of every key; `order` must be total within a key."""
    return top_rows(facts, keys, [F.col(c).desc() for c in order], 1)


def distinct_skills(mentions: DataFrame) -> DataFrame:
    """Every skill once per person, as rows."""
    return mentions.select("applicant_id", "skill").distinct()


def merge_bullets(bullets: DataFrame, role: str | Sequence[str] = "role_id") -> DataFrame:
    """The unique bullets of every role over all documents, in their own words.

    Bullets of the same words are one: the longest text stays, and the first among equally long ones.
    A bullet whose words begin a longer bullet of the role is a shorter version of it and goes;
    bullets that only start alike all stay. A role of very many bullets is spread over the tasks:
    bullets and the beginnings of others meet by equality of 128 bits of hashes of role and words, so
    a beginning crosses the shuffle as two numbers. Bullets are gathered once and written, as both sides
    start from them; a bullet without a role is compared with none.
    """
    keys = [role] if isinstance(role, str) else list(role)
    words = tokens(F.col("text"))
    keyed = bullets.select(*keys, "text", F.array_join(words, " ").alias("version"))
    once = materialise(top_rows(keyed, [*keys, "version"], [F.length("text").desc(), F.col("text").asc()], 1), "bullets")

    has_role = F.lit(True)
    for k in keys:
        has_role &= F.col(k).isNotNull()

    def known(version: Column) -> list[Column]:
        return [F.xxhash64(*keys, version).alias("h1"), F.xxhash64(F.lit(1), *keys, version).alias("h2")]

    def beginning(n: Column) -> Column:
        return F.struct(*known(F.call_function("substring_index", F.col("version"), F.lit(" "), n)))

    n_spaces = F.length("version") - F.length(F.replace("version", F.lit(" "), F.lit("")))
    shorter = F.when(n_spaces > 0, F.transform(F.sequence(F.lit(1), n_spaces), beginning))
    beginnings = once.filter(has_role).select(F.inline(shorter))
    hashes = [F.when(has_role, h) for h in known(F.col("version"))]
    return once.withColumns(dict(zip(("h1", "h2"), hashes, strict=True))).join(
        beginnings, ["h1", "h2"], "left_anti"
    ).select(*keys, "version", "text")


def metric_habits(bullets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How numbers are shown in bullets: shares of bullets, rounded to six places."""
    text = F.col("text")
    flags = {
        "with_number": has_number(text),
        "leads_with_number": text.rlike("^[^A-Za-z0-9]*[0-9]"),
        "with_percentage": text.rlike("[0-9] ?%"),
        "with_range": text.rlike("[0-9] ?[-–] ?[0-9]"),
    }
    sums = bullets.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_bullets"),
        *[F.count_if(flag).alias(name) for name, flag in flags.items()],
    )
    return sums.select(
        *keys,
        "n_bullets",
        *[F.round(F.col(name) / F.col("n_bullets"), 6).alias(name) for name in flags],
    )


def density(bullets: DataFrame, roles: DataFrame) -> DataFrame:
    """Bullets per role, characters per bullet and the oldest role kept, per person."""
    per_role = bullets.groupBy("role_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")
    )
    joined = roles.select("applicant_id", "role_id", "start_m").join(per_role, "role_id", "left")
    sums = joined.groupBy("applicant_id").agg(
        F.count(F.lit(1)).alias("n_roles"),
        F.sum(F.coalesce("n", F.lit(0))).alias("n_bullets"),
        F.sum(F.coalesce("chars", F.lit(0))).alias("chars"),
        F.min("start_m").alias("oldest_start_m"),
    )
    return sums.select(
        "applicant_id",
        "n_roles",
        F.round(F.col("n_bullets") / F.col("n_roles"), 6).alias("bullets_per_role"),
        F.round(F.col("chars") / F.greatest("n_bullets", F.lit(1)), 6).alias("chars_per_bullet"),
        "oldest_start_m",
    )


def page_budget(roles: DataFrame, as_of_m: int, has_template: bool = False) -> DataFrame:
    """Months of experience without counting overlaps twice, and the pages they allow.

    Months are numbered 12 * year + month and a role holds the months from its start up to, but not
    including, its end; a current role ends at `as_of_m`. Counting the distinct months merges
    overlapping roles without ordering a person's roles in one task: repeated months are combined
    before each shuffle.
    """
    ended = F.when(F.col("is_current"), F.greatest(F.col("end_m"), F.lit(as_of_m))).otherwise(F.col("end_m"))
    spans = roles.select("applicant_id", "start_m", ended.alias("end_m"))
    held = F.when(
        F.col("end_m") > F.col("start_m"), F.sequence(F.col("start_m"), F.col("end_m") - 1)
    )
    months = spans.select("applicant_id", F.explode_outer(held).alias("month"))
    total = months.groupBy("applicant_id").agg(F.count_distinct("month").alias("n_months"))
    pages = F.lit(1) if has_template else F.when(F.col("n_months") < 12 * ONE_PAGE_YEARS, 1).otherwise(2)
    return total.withColumn("max_pages", pages)


def contacts(df: DataFrame, text: str = "text") -> DataFrame:
    """Contact facts exactly as written, "" where there is none.

    A phone number has 7 to 15 digits and is not a range of years.
    """

    def is_phone(run: Column) -> Column:
        n_digits = F.length(F.regexp_replace(run, "[^0-9]", ""))
        return n_digits.between(*PHONE_DIGITS) & ~run.rlike(YEARS)

    phone = F.get(F.filter(find_all(F.col(text), PHONE), is_phone), F.lit(0))
    return df.select(
        *[c for c in df.columns if c != text],
        F.regexp_extract(text, EMAIL, 0).alias("email"),
        F.coalesce(strip(phone), F.when(F.col(text).isNotNull(), "")).alias("phone"),
        F.regexp_extract(text, PROFILE_LINK, 0).alias("linkedin"),
    )


def skill_mentions(df: DataFrame, vocabulary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Terms of the vocabulary that a text names explicitly; nothing is implied."""
    terms = term_table(vocabulary)
    runs = df.select(*keys, "text", F.explode(term_runs(F.col("text"), terms)).alias("term"))
    named = runs.join(terms, "term").filter(names_term(F.col("text"), F.col("skill"), F.col("signed")))
    return named.select(*keys, "skill").distinct()


#: A date of a role as people write it, and what stands between two of them.
DATE = r"(?:\p{L}{3,9}\.? [0-9]{4}|[0-9]{4}-(?:0[1-9]|1[0-2])|(?:0[1-9]|1[0-2])/[0-9]{4}|[0-9]{4})"
UNTIL = r" ?(?: to | until |-|–|—) ?"
OPEN_END = "(?i:" + "|".join(CURRENT_WORDS) + ")"
PERIOD = rf"({DATE}){UNTIL}({DATE}|{OPEN_END}|)"
#: What every period begins with: cheap to look for before a whole line is matched.
BEGUN = DATE + UNTIL
#: "Title at Company, Place (period)", "Title, Company, period"
ROLE = rf"^(.+?)(?: at |, )([^,(]+?)(?:, ([^,(]+?))?,? \(?{PERIOD}\)?$"
DEGREE = r"^(.*), (.*), ([0-9.]*)$"
#: "Degree, School (2004)", "Degree, School, 2000 - 2004": the last year counts
DEGREE_YEARS = r"^(.+), ([^0-9,][^,]*?),? \(?(?:[0-9]{4} ?(?:-|–|—|to) ?)?([0-9]{4})\)?$"


#: A list line and what it says, both without space at their ends, in one match.
_EDGE = "".join(c for c in EDGE_SPACE if c not in "\n\r\u2028\u2029")
STRIPPED_ITEM = ITEM.replace("^", f"^[{EDGE_SPACE}]*+").replace(
    "(.+)$", rf"[{_EDGE}]*+(.*[^{EDGE_SPACE}\x85])(?:[{EDGE_SPACE}]*+\z|[{_EDGE}]*+\x85[{EDGE_SPACE}]*+\z)"
)


def _list_items(text: Column) -> Column:
    """What the list lines of a text say, behind any sign of a list."""
    said = F.transform(F.split(text, r"\r?\n|\r"), lambda line: F.regexp_extract(line, STRIPPED_ITEM, 1))
    return F.filter(said, lambda item: item != "")


def _may_be_degree(item: Column) -> Column:
    """Whether a list item is no role by its signs or by " at " and a company."""
    whole = rf"^.+ (?:at|,)? ?.*{PERIOD}\)?$"
    is_role = item.contains(" | ") | item.contains(" · ") | (item.rlike(r" at \p{Lu}") & item.rlike(BEGUN) & item.rlike(whole))
    return ~is_role


def _is_degree(item: Column) -> Column:
    named = item.rlike(DEGREE) | (item.rlike(r"[0-9]{4}\)?$") & item.rlike(DEGREE_YEARS))
    return named & _may_be_degree(item)


def _degree(item: Column) -> Column:
    """(degree, school, year) of a list item that `_is_degree`."""

    def read(pattern: str) -> Column:
        parts = [F.regexp_extract(item, pattern, i) for i in (1, 2, 3)]
        return F.struct(*[c.alias(n) for c, n in zip(parts, ("degree", "school", "year"), strict=True)])

    return F.when(item.rlike(DEGREE), read(DEGREE)).otherwise(read(DEGREE_YEARS))


def education_rows(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Degree, school and graduation year from list lines such as "- BSc, Some School, 2004", with the
    year behind a comma or in brackets, or the last of two years.

    The year is kept as a number by the record schema; one that is not whole is flagged.
    """
    # in the generator, whose columns are not worked out again for each use
    rows = df.select(*keys, F.inline(F.transform(F.filter(_list_items(F.col(text)), _is_degree), _degree)))
    year = F.expr("try_cast(year AS double)")
    return (
        rows.withColumn("graduation_year", F.expr("try_cast(try_cast(year AS double) AS int)"))
        .withColumn("year_is_whole", F.coalesce(year == F.floor(year), F.lit(False)))
        .drop("year")
    )


def _role(item: Column) -> Column:
    """(title, company, location, start, end) of a list item, NULL if it is no role."""

    def made(title: Column, company: Column, location: Column, start: Column, end: Column) -> Column:
        named = {"title": title, "company": company, "location": location, "start": start, "end": end}
        return F.struct(*[strip(F.coalesce(c, F.lit(""))).alias(n) for n, c in named.items()])

    def in_columns(parts: Column) -> Column:
        n_parts = F.size(parts)
        last = F.element_at(parts, -1)
        dates = F.split(last, " to(?: |$)", 2)
        place = F.when(n_parts == 4, F.get(parts, F.lit(2)))
        title, company = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
        whole = rf"^{PERIOD}$"
        return F.when(
            n_parts.between(3, 4),
            F.when(F.size(dates) == 2, made(title, company, place, F.get(dates, F.lit(0)), F.get(dates, F.lit(1)))).when(
                last.rlike(whole),
                made(title, company, place, F.regexp_extract(last, whole, 1), F.regexp_extract(last, whole, 2)),
            ),
        )

    in_words = made(*[F.regexp_extract(item, ROLE, i) for i in range(1, 6)])
    split = F.split(item, r" \| | · ")
    return F.when(F.size(split) > 1, let(split, in_columns)).when(_role_in_words(item), in_words)


def _role_in_words(item: Column) -> Column:
    return item.rlike(BEGUN) & item.rlike(ROLE) & ~_is_degree(item)


def role_rows(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Roles from list lines such as "- Title | Company | Place | 1998-10 to present", "* Title at Company
    (1998 – 2001)" or "1. Title, Company, Place, May 1998 - today".

    The name of the person is the first line. An absent place is "". A list line that could be a degree
    (two names and a year or years) counts as one unless it has " at " and a company.
    """
    # in the generator, whose columns are not worked out again for each use
    found = F.filter(F.transform(_list_items(F.col(text)), _role), lambda r: r.isNotNull())
    return df.select(*keys, strip(F.substring_index(text, "\n", 1)).alias("name"), F.inline(found))


def unread_items(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """(keys, item): the list lines of a text that name neither a role nor a degree."""
    left = F.filter(_list_items(F.col(text)), lambda item: ~_is_degree(item) & _role(item).isNull())
    return df.select(*keys, F.explode(left).alias("item"))


def role_date(raw: Column) -> Column:
    """A role date as "YYYY-MM", "present" or ""."""
    text = F.lower(strip(F.coalesce(raw, F.lit(""))))
    month_name = F.substring(F.regexp_extract(text, r"^([a-z]{3,9})\.? [0-9]{4}$", 1), 1, 3)
    month = F.array_position(literal_texts(MONTHS), month_name)
    year_last = F.regexp_extract(text, r"([0-9]{4})$", 1)
    return (
        F.when(text.isin(CURRENT_WORDS), "present")
        .when(text.rlike(r"^[0-9]{4}-(?:0[1-9]|1[0-2])$"), text)
        .when(text.rlike(r"^[0-9]{4}$"), F.concat(text, F.lit("-01")))
        .when(
            text.rlike(r"^(?:0[1-9]|1[0-2])/[0-9]{4}$"),
            F.concat(year_last, F.lit("-"), F.substring(text, 1, 2)),
        )
        .when(month > 0, F.concat(year_last, F.lit("-"), F.lpad(month.cast("string"), 2, "0")))
        .otherwise("")
    )


def role_dates(df: DataFrame, start: str, end: str) -> DataFrame:
    """Add the dates of a role in the fixed form, as dates and with a flag for a current role."""
    dated = df.withColumn("start_date", role_date(F.col(start))).withColumn(
        "end_date", role_date(F.col(end))
    )
    return (
        dated.withColumn("start_day", F.try_to_date(F.col("start_date"), "yyyy-MM"))
        .withColumn("end_day", F.try_to_date(F.col("end_date"), "yyyy-MM"))
        .withColumn("is_current", F.col("end_date") == "present")
    )


def group_skills(
    skills: DataFrame, categories: DataFrame, limit: int = SKILL_GROUP_LIMIT
) -> DataFrame:
    """Skills with the category to list them under, which is "" for people with up to `limit`."""
    counts = skills.groupBy("applicant_id").agg(F.count(F.lit(1)).alias("n_skills"))
    many = counts.filter(F.col("n_skills") > limit).select("applicant_id", F.lit(True).alias("many"))
    return (
        skills.join(many, "applicant_id", "left")
        .join(categories, "skill", "left")
        .select(
            "applicant_id",
            "skill",
            F.when(F.col("many"), or_default(F.col("category"), "Other"))
            .otherwise("")
            .alias("category"),
        )
    )


def order_sections(
    df: DataFrame, section: str, order: Sequence[str] = tuple(DEFAULT_SECTIONS)
) -> DataFrame:
    """Add the place of each section in the author's order; unknown sections come last."""
    place = F.array_position(literal_texts(list(order)), F.col(section))
    return df.withColumn("position", F.when(place > 0, place).otherwise(len(order) + 1))
