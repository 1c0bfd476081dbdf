"""Routing, accepting and keying of incoming material."""

from collections.abc import Sequence
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterloom.constants import MIN_PAGE_CHARS, URL_KEY_CHARS
from letterloom.functions.ranking import top_rows
from letterloom.functions.text import find_all, let, slug, strip

URL_PARTS = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]*)?(/[^?#]*)?"
ESCAPED_IN_PATH = r'[^\x21-\x7E]|["<>`{}^]'
# Character references of the page text, replaced in this order
ENTITIES = [
    ("&nbsp;", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&amp;", "&"),
]
PAGE_NOISE = [
    r"(?s)<!--.*?-->",
    r"(?is)<script[^>]*>.*?</script>",
    r"(?is)<style[^>]*>.*?</style>",
    r"(?is)<nav[^>]*>.*?</nav>",
    r"(?s)<[^>]*>",
]
LIST_ITEM = r"(?i)<li\b[^>]*>"
LINE_TAGS = r"(?i)</?(?:br|p|div|h[1-6]|ul|ol|li|dl|dt|dd|tr|table|section|article|header|footer|main|title)\b[^>]*>"


def visible_only(df: DataFrame, name: str) -> DataFrame:
    return df.filter(~F.col(name).startswith("."))


def is_url(source: Column) -> Column:
    return source.startswith("http://") | source.startswith("https://")


def route_sources(df: DataFrame, source: str) -> DataFrame:
    return df.withColumn("route", F.when(is_url(F.col(source)), "url").otherwise("file"))


def accept_pages(df: DataFrame, min_chars: int = MIN_PAGE_CHARS) -> DataFrame:
    """Add `reject_reason`: NULL for an accepted page, else why it is turned away.

    A page without a status was never answered, so it is turned away too.
    """
    status = F.coalesce(F.col("status").cast("string"), F.lit("status unknown"))
    good = F.coalesce(F.col("status").between(200, 299), F.lit(False))
    short = F.coalesce(F.length(strip(F.col("body"))), F.lit(0)) < min_chars
    return df.withColumn(
        "reject_reason",
        F.when(~good, F.concat(F.lit("HTTP "), status))
        .when(short, "too short or empty"),
    )


def decoded(text: Column) -> Column:
    """Character references as characters: numbers, and the names that HTML 4 knows.

    `&nbsp;` is a plain space. Unknown names and numbers without a character stay as they are. What a
    decoded `&` makes together with the letters after it is not decoded again.
    """
    names = F.create_map(*[F.lit(v) for name, code in sorted(name2codepoint.items()) for v in (name, chr(code))])

    def character(reference: Column) -> Column:
        body = F.substring(reference, 2, 40)
        hexadecimal = F.conv(F.regexp_extract(body, "^#[xX]([0-9a-fA-F]{1,6});", 1), 16, 10)
        number = F.coalesce(F.nullif(F.regexp_extract(body, "^#([0-9]{1,7});", 1), F.lit("")), hexadecimal).try_cast("int")
        real = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        # a number as the four bytes of its character
        numbered = F.decode(F.unhex(F.lpad(F.hex(F.when(real, number)), 8, "0")), "UTF-32")
        named = F.try_element_at(names, F.regexp_replace(body, ";$", ""))
        return F.regexp_replace(F.coalesce(numbered, named, reference), "\u00a0", " ")

    found = F.array_distinct(find_all(text, "&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});"))
    pairs = F.transform(found, lambda r: F.struct(r.alias("reference"), character(r).alias("character")))

    def replaced(known: Column) -> Column:
        last = F.concat(
            F.filter(known, lambda p: p["character"] != "&"), F.filter(known, lambda p: p["character"] == "&")
        )
        return F.aggregate(last, text, lambda acc, p: F.replace(acc, p["reference"], p["character"]))

    return let(pairs, replaced)


def page_text(html: Column) -> Column:
    """The text of a page on one line. Only the references of `ENTITIES` are decoded, as is expected of it."""
    text = html
    for pattern in PAGE_NOISE:
        text = F.regexp_replace(text, pattern, " ")
    for reference, char in ENTITIES:
        text = F.replace(text, F.lit(reference), F.lit(char))
    return strip(F.regexp_replace(text, r"\s+", " "))


def page_lines(html: Column) -> Column:
    """The text of a page with its lines: blocks end a line, list items begin with "- ".

    All character references are decoded (see `decoded`)."""
    text = html
    for pattern in PAGE_NOISE[:-1]:
        text = F.regexp_replace(text, pattern, " ")
    text = F.regexp_replace(F.regexp_replace(text, r"\s+", " "), LIST_ITEM, "\n- ")
    text = F.regexp_replace(F.regexp_replace(text, LINE_TAGS, "\n"), PAGE_NOISE[-1], "")
    text = F.regexp_replace(decoded(text), r" *\n[ \n]*", "\n")
    # a block inside an item belongs to it; items without text go
    text = F.regexp_replace(text, r"\n-\n(?!-(?:[ \n]|$))", "\n- ")
    return strip(F.regexp_replace(text, r"\n-(?=\n|$)", ""))


def _escaped_path(path: Column) -> Column:
    """Percent-escape the characters that a parsed URL path never holds unescaped."""

    def escape(char: Column) -> Column:
        code = F.replace(F.url_encode(char), F.lit("+"), F.lit("%20"))
        return F.when(char.rlike(ESCAPED_IN_PATH), code).otherwise(char)

    return F.when(
        path.rlike(ESCAPED_IN_PATH), F.array_join(F.transform(F.split(path, ""), escape), "")
    ).otherwise(path)


def url_key(url: Column) -> Column:
    """Readable key of a URL: host and path only; a URL without a host is keyed by its hash."""
    host = F.lower(F.regexp_extract(url, URL_PARTS, 1))
    path = _escaped_path(F.regexp_extract(url, URL_PARTS, 2))
    place = F.regexp_replace(F.regexp_replace(F.concat(host, path), r"^www\.", ""), "/$", "")
    readable = F.regexp_replace(F.regexp_replace(place, "[^a-zA-Z0-9]+", "_"), "^_|_$", "")
    hashed = F.when(url.isNotNull(), F.concat(F.lit("fetched_job_"), F.lower(F.hex(F.xxhash64(url)))))
    return F.when(host != "", F.substring(readable, 1, URL_KEY_CHARS)).otherwise(hashed)


def posting_identity(url: Column, text: Column) -> Column:
    """What makes two postings one: the whole URL, or the text where there is no URL.

    `url_key` is only a readable name, which different postings can share.
    """
    return F.sha2(F.coalesce(F.concat(F.lit("url "), url), F.concat(F.lit("text "), text), F.lit("")), 256)


def posting_file(url: Column) -> Column:
    """The name under which a fetched posting is kept."""
    return F.concat(url_key(url), F.lit(".md"))


def job_slug(company: Column, title: Column) -> Column:
    """Slug of one (company, title); texts without a letter or digit share the name `unnamed`."""
    made = slug(F.concat(company, F.lit("_"), title))
    return F.when(made == "", "unnamed").otherwise(made)


def key_collisions(df: DataFrame, key: str, source: str) -> DataFrame:
    """Keys that stand for more than one source, which would overwrite each other."""
    return (
        df.groupBy(key)
        .agg(F.count_distinct(source).alias("n_sources"))
        .filter(F.col("n_sources") > 1)
    )


def all_postings(fetched: DataFrame, local: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One input from both origins, one row per key: a local file wins, then the first by `order`."""
    both = fetched.withColumn("origin", F.lit("url")).unionByName(local.withColumn("origin", F.lit("file")))
    return top_rows(both, [key], [F.col("origin").asc(), *[F.col(c).asc() for c in order]], 1)


def dedup_documents(df: DataFrame, keys: Sequence[str], text: str, order: str) -> DataFrame:
    """Identical texts of a group counted once: the first by `order` stays."""
    hashed = df.withColumn("text_hash", F.sha2(F.col(text), 256))
    return top_rows(hashed, [*keys, "text_hash"], [F.col(order).asc()], 1)


def dry_run_report(samples: DataFrame, postings: DataFrame, profiles: DataFrame) -> DataFrame:
    """Readiness of every request, before anything is spent on it.

    `postings(applicant_id, posting_found)` holds the requests, `samples(applicant_id, kind)` the
    documents and `profiles(applicant_id, is_valid)` the saved profiles.
    """
    counts = samples.groupBy("applicant_id").agg(
        F.count_if(F.col("kind") == "resume").alias("n_resumes"),
        F.count_if(F.col("kind") == "cover_letter").alias("n_cover_letters"),
    )
    joined = postings.join(counts, "applicant_id", "left").join(profiles, "applicant_id", "left")
    resumes = F.coalesce("n_resumes", F.lit(0))
    has_profile = F.col("is_valid").isNotNull()
    reason = (
        F.when(~F.col("posting_found"), "job posting not found")
        .when(~has_profile & (resumes == 0), "no profile and no resumes")
        .when(has_profile & ~F.col("is_valid"), "invalid profile")
        .otherwise("")
    )
    return joined.select(
        "applicant_id",
        resumes.alias("n_resumes"),
        F.coalesce("n_cover_letters", F.lit(0)).alias("n_cover_letters"),
        (reason == "").alias("ready"),
        reason.alias("reason"),
        (~has_profile & (resumes > 0)).alias("will_extract"),
    )
