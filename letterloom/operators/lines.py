"""Postings read line by line: what kind each line is, the section it stands in, and what is left over.

Headings, list items, labelled values and plain text are told apart in many ways of writing (Markdown,
numbers, dashes, remarks behind a heading). The section of a line is that of the last heading or label
before it; plain text behind a list ends it. All of this is made inside the row, so nothing is shuffled.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterloom.constants import NOT_SPECIFIED
from letterloom.functions.text import let, or_default, sentences, strip, word_count

#: Wordings of the headings of sections, as patterns; case does not count.
HEADINGS = {
    "responsibility": "(?:Key |Main )?Responsibilities|What you(?:'|’| wi)ll do|Your tasks",
    "required": "(?:Required|Essential|Mandatory|Must[- ]have)(?: skills| qualifications)?|(?:Minimum )?Requirements",
    "preferred": "(?:Preferred|Desired|Nice[- ]to[- ]have)(?: skills| qualifications)?|Bonus|(?:A )?Plus",
    "about": "About(?: us| the company| the role)?|Who we are",
}
#: Wordings of labels, in lower case.
LABELS = {
    "title": ["title", "job title", "position", "role"],
    "company": ["company", "employer", "organisation", "organization"],
    "location": ["location", "place", "office"],
    "salary": ["salary", "salary range", "compensation", "pay", "pay range"],
    "team": ["team", "department"],
    "manager": ["hiring manager", "contact"],
    "about": ["about", "about us"],
}
#: What begins a list item: a dash, star, dot, or a number of up to two digits.
ITEM = r"^(?:[-*•–—]|\(?[0-9]{1,2}[.)])[ \t]+(.+)$"
MARKED = r"^(?:#{1,6}[ \t]+.*|\*\*.*\*\*:?|__.*__:?)$"
MARKUP = r"^#{1,6}[ \t]+|\*\*|__"
REMARK = r"[ \t]*(?:\([^()]*\))?[ \t]*:?[ \t]*(?:\([^()]*\))?[ \t]*$"
LABEL = r"^(\p{L}[\p{L} /&'-]{0,30}?)[ \t]*:(?:[ \t]+(.*))?$"
BETWEEN = r" (?:-|–|—|\||·) |, "
TITLE_AT = r"^(.+?) at (\p{Lu}.*)$"
PAY = r"[$€£] ?[0-9]|[0-9] ?(?:EUR|USD|GBP)\b"
TITLE_WORDS, COMPANY_WORDS, COMPANY_SENTENCES = 12, 10, 3


def _first(found: Column) -> Column:
    return F.get(found, F.lit(0))


def _heading(plain: Column) -> Column:
    """The section that a line opens by its wording, NULL for any other line."""
    bare = F.regexp_replace(plain, REMARK, "")
    return F.coalesce(*[F.when(bare.rlike(f"(?i)^(?:{p})$"), F.lit(name)) for name, p in HEADINGS.items()])


def _label(label: Column) -> Column:
    names = F.create_map(*[F.lit(v) for name, ways in LABELS.items() for way in ways for v in (way, name)])
    return F.try_element_at(names, F.lower(strip(label)))


def _line(raw: Column, number: Column) -> Column:
    """(no, kind, name, value) of a line; name is the section or label, value what it says."""
    line = strip(raw)
    plain = strip(F.regexp_replace(line, MARKUP, ""))
    item = strip(F.regexp_extract(line, ITEM, 1))
    section = _heading(plain)
    label, value = F.regexp_extract(plain, LABEL, 1), strip(F.regexp_extract(plain, LABEL, 2))
    known = F.when((label != "") & (value != ""), _label(label))
    opens = line.rlike(MARKED) | ((label != "") & (value == ""))

    def told(kind: str, name: Column, said: Column) -> Column:
        return F.struct(
            number.alias("no"), F.lit(kind).alias("kind"), name.cast("string").alias("name"), said.alias("value")
        )

    none = F.lit(None)
    return (
        F.when(plain == "", told("blank", none, F.lit("")))
        .when(item != "", told("item", none, item))
        .when(known.isNotNull(), told("label", known, value))
        .when(section.isNotNull(), told("heading", section, plain))
        .when(opens, told("heading", F.lit("other"), plain))
        .otherwise(told("text", none, plain))
    )


def posting_lines(text: Column) -> Column:
    """The lines of a text as (no from 1, kind, name, value, section), blank ones left out.

    kind is heading, label, item or text. A NULL text has no lines.
    """
    raw = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), "\n")
    lines = F.filter(F.transform(raw, lambda r, i: _line(r, i + 1)), lambda x: x["kind"] != "blank")

    def sectioned(seen: Column) -> Column:
        def opens(x: Column, i: Column) -> Column:
            ends = (x["kind"] == "text") & F.coalesce(F.get(seen, i - 1)["kind"] == "item", F.lit(False))
            return x["kind"].isin("heading", "label") | ends

        openers = F.filter(seen, opens)

        # headings are few, so looking for the last one is cheap for every line
        def by(known: Column) -> Column:
            def section(x: Column) -> Column:
                last = F.try_element_at(F.filter(known, lambda o: o["no"] <= x["no"]), F.lit(-1))
                return F.coalesce(last["name"], F.lit(""))

            return F.transform(seen, lambda x: x.withField("section", section(x)))

        return let(openers, by)

    return let(lines, sectioned)


def section_list(lines: Column, section: str) -> Column:
    """The items of a section in their order and wording."""
    own = F.filter(lines, lambda x: (x["kind"] == "item") & (x["section"] == section))
    return F.transform(own, lambda x: x["value"])


def _labelled(lines: Column, name: str) -> Column:
    """The value of the first line with a label, NULL if there is none."""
    return _first(F.filter(lines, lambda x: (x["kind"] == "label") & (x["name"] == name)))["value"]


def _opening(lines: Column) -> tuple[Column, Column, Column]:
    """Title, company and location from the first two lines, where no label gives the title."""
    first, second = F.get(lines, F.lit(0)), F.get(lines, F.lit(1))
    free = first["kind"].isin("heading", "text") & F.coalesce(first["name"] == "other", F.lit(True))
    whole = F.when(_labelled(lines, "title").isNull() & free & (word_count(first["value"]) <= TITLE_WORDS), first["value"])
    at = F.regexp_extract(whole, TITLE_AT, 2)
    title = F.when(at != "", F.regexp_extract(whole, TITLE_AT, 1)).otherwise(whole)
    brief = (second["kind"] == "text") & (word_count(second["value"]) <= COMPANY_WORDS) & ~second["value"].rlike("[.!?]$")
    parts = F.when(whole.isNotNull() & (at == "") & brief, F.split(second["value"], BETWEEN, 2))
    company = F.when(at != "", at).otherwise(F.get(parts, F.lit(0)))
    return strip(title), strip(company), strip(F.get(parts, F.lit(1)))


def _pay(lines: Column) -> Column:
    named = _labelled(lines, "salary")
    other = _first(F.filter(lines, lambda x: x["kind"].isin("text", "item") & x["value"].rlike(PAY)))["value"]
    return F.coalesce(named, other)


def _about(lines: Column) -> Column:
    told = F.filter(lines, lambda x: (x["kind"] == "text") & (x["section"] == "about"))
    said = F.array_join(F.transform(told, lambda x: x["value"]), " ")
    return F.coalesce(_labelled(lines, "about"), said)


def posting_facts(text: Column) -> Column:
    """What the lines of a posting say, as one struct; "" or an empty list where nothing does.

    Without a label the title is a short first line ("Title at Company" gives both), and a short second
    one names company and place. Without a label the pay is the first line with an amount of money.
    Preferred items that are required too are only required. `unread` holds the lines that none of
    this uses, as (no, value).
    """

    def rest(lines: Column, told: Column) -> Column:
        """The lines that are no heading, label, item of a known list, opening line or line of pay."""

        def used(x: Column, i: Column) -> Column:
            listed = (x["kind"] == "item") & x["section"].isin(*HEADINGS)
            about = (x["kind"] == "text") & (x["section"] == "about")
            opening = i < told["n_opening"]
            return x["kind"].isin("heading", "label") | listed | about | opening | (x["value"] == told["pay"])

        left = F.filter(lines, lambda x, i: ~used(x, i))
        return F.transform(left, lambda x: F.struct(x["no"].alias("no"), x["value"].alias("value")))

    def facts(lines: Column) -> Column:
        title, company, place = _opening(lines)
        n_opening = F.when(company.isNotNull() & place.isNotNull(), 2).otherwise(F.when(title.isNotNull(), 1).otherwise(0))
        told = F.struct(
            F.coalesce(_labelled(lines, "title"), title, F.lit("")).alias("title"),
            F.coalesce(_labelled(lines, "company"), company, F.lit("")).alias("company"),
            F.coalesce(_labelled(lines, "location"), place, F.lit("")).alias("location"),
            n_opening.alias("n_opening"),
            F.coalesce(_pay(lines), F.lit("")).alias("pay"),
            _about(lines).alias("about"),
            section_list(lines, "required").alias("required"),
        )
        return let(told, lambda t: record(lines, t))

    def record(lines: Column, told: Column) -> Column:
        return F.struct(
            told["title"].alias("job_title"),
            told["company"].alias("company_name"),
            told["location"].alias("location"),
            or_default(_labelled(lines, "team"), NOT_SPECIFIED).alias("team_or_department"),
            told["about"].alias("about"),
            strip(F.array_join(F.slice(sentences(told["about"]), 1, COMPANY_SENTENCES), "")).alias("company_description"),
            told["pay"].alias("pay"),
            F.coalesce(_labelled(lines, "manager"), F.lit("")).alias("manager"),
            section_list(lines, "responsibility").alias("responsibilities"),
            told["required"].alias("required"),
            F.array_except(section_list(lines, "preferred"), told["required"]).alias("preferred"),
            rest(lines, told).alias("unread"),
        )

    return let(posting_lines(text), facts)


def read_lines(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """One row a line: (keys, no, kind, name, value, section)."""
    rows = F.inline(posting_lines(F.col(text)))
    return df.select(*keys, rows).withColumn("name", F.coalesce("name", F.lit("")))


def unread_lines(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """(keys, no, value): the lines that give nothing to the record of a posting."""
    return df.select(*keys, F.inline(let(posting_facts(F.col(text)), lambda f: f["unread"])))
