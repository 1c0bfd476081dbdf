"""Joins and rankings that put applicants and postings together.

Common inputs: `applications(applicant_id, job_id)`, `requirements(job_id, skill, rnk, level)`,
`skills(applicant_id, skill)`, `roles(applicant_id, role_id, title, company, start_m, ...)` and
`bullets(role_id, bullet_no, text)`.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from letterloom.constants import (
    DEFAULT_RESUME_STRUCTURE,
    DEFAULT_SECTIONS,
    DEFAULT_TRANSITIONS,
    DEFAULT_VOICE,
    HOOKS,
    MAX_BULLETS,
    MAX_ROLES,
    MIN_BULLETS,
    MIN_HOOKS,
    MIN_ROLES,
    NO_REFRAME,
)
from letterloom.functions.ranking import top_rows
from letterloom.functions.text import (
    has_number,
    let,
    literal_texts,
    ngrams,
    normalised,
    tokens,
)
from letterloom.session import materialise, materialise_parts

PAIR = ["applicant_id", "job_id"]
#: A term with signs that its words leave out (C++, C#, .NET).
SIGNED = r"[+#]|^\."
#: Tasks that the people of one skill are dealt to.
COVER_SALTS = 16


def assemble(
    applications: DataFrame, jobs: DataFrame, profiles: DataFrame, styles: DataFrame
) -> DataFrame:
    """Job, profile and style side by side for every application; the style may be missing."""
    return (
        applications.join(jobs, "job_id")
        .join(profiles, "applicant_id")
        .join(styles, "applicant_id", "left")
    )


def default_style() -> Column:
    voice = F.struct(
        *[F.lit(value).alias(name) for name, value in DEFAULT_VOICE.items()],
        literal_texts(DEFAULT_TRANSITIONS).alias("common_transitions"),
        literal_texts([]).alias("forbidden_words"),
    )
    resume = F.struct(
        F.lit(DEFAULT_RESUME_STRUCTURE["bullet_style"]).alias("bullet_style"),
        literal_texts(DEFAULT_SECTIONS).alias("section_ordering"),
        F.lit(DEFAULT_RESUME_STRUCTURE["metric_usage"]).alias("metric_usage"),
        F.lit(DEFAULT_RESUME_STRUCTURE["density"]).alias("density"),
    )
    return F.struct(voice.alias("voice_profile"), resume.alias("resume_structure_preferences"))


def style_or_default(authors: DataFrame, styles: DataFrame, key: str = "author_id") -> DataFrame:
    """Every author with a style: the measured one, else the fixed default, which is flagged."""
    return authors.join(styles, key, "left").select(
        *authors.columns,
        F.coalesce("style", default_style()).alias("style"),
        F.col("style").isNull().alias("is_default"),
    )


def split_cached(
    df: DataFrame, cache: DataFrame, keys: list[str], reuse: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(rows whose saved record is reused, rows to work out again)."""
    if not reuse:
        return df.filter(F.lit(False)), df
    saved = cache.select(*keys).distinct()
    return df.join(saved, keys, "left_semi"), df.join(saved, keys, "left_anti")


def required(requirements: DataFrame) -> DataFrame:
    return requirements.filter(F.col("level") == "required")


def skill_match(applications: DataFrame, requirements: DataFrame, skills: DataFrame) -> DataFrame:
    """Listed skills that the applicant holds, by exact term. `skills` holds each skill once."""
    wanted = applications.join(requirements.select("job_id", "skill", "level"), "job_id")
    return wanted.join(skills, ["applicant_id", "skill"], "left_semi").select(*PAIR, "skill", "level")


def skill_gap(applications: DataFrame, requirements: DataFrame, skills: DataFrame) -> DataFrame:
    """Required skills that the applicant lacks, in the words of the posting."""
    wanted = applications.join(required(requirements).select("job_id", "skill"), "job_id")
    return wanted.join(skills, ["applicant_id", "skill"], "left_anti").select(*PAIR, "skill")


def coverage(applications: DataFrame, requirements: DataFrame, skills: DataFrame) -> DataFrame:
    """Matched and missing required skills of every application, counted in one pass.

    Where nothing is required the counts are 0 and the coverage is NULL.
    """
    wanted = applications.join(required(requirements).select("job_id", "skill"), "job_id", "left")
    held = skills.select("applicant_id", "skill").distinct().withColumn("held", F.lit(1))
    return (
        wanted.join(held, ["applicant_id", "skill"], "left")
        .groupBy(*PAIR)
        .agg(
            F.count("skill").alias("n_required"),
            F.count("held").alias("n_matched"),
        )
        .withColumn("n_missing", F.col("n_required") - F.col("n_matched"))
        .withColumn("coverage", F.round(F.try_divide("n_matched", "n_required"), 6))
    )


def transferable(gap: DataFrame, skills: DataFrame, related: DataFrame) -> DataFrame:
    """For every missing skill the related skill held (the first by name) and how many there are.

    `related(skill, topic)` is the caller's: skills with a common topic cover each other. The skills
    held are gathered by topic before the gaps are joined, so related skills are never paired; one
    held skill counts once however many topics it shares with the gap.
    """
    held = (
        skills.join(related, "skill")
        .groupBy("applicant_id", "topic")
        .agg(F.collect_set("skill").alias("held"))
    )
    found = (
        gap.join(related, "skill", "left")
        .join(held, ["applicant_id", "topic"], "left")
        .groupBy(*PAIR, "skill")
        .agg(F.array_distinct(F.flatten(F.collect_list("held"))).alias("held"))
        .withColumn("via", F.array_min("held"))
        .withColumn("n_via", F.size("held").cast("long"))
    )
    mitigation = F.when(
        F.col("via").isNotNull(),
        F.concat(F.lit("transferable from "), "via", F.lit(", covers "), "skill"),
    ).otherwise(NO_REFRAME)
    return found.select(
        *PAIR,
        F.col("skill").alias("missing_skill"),
        "n_via",
        mitigation.alias("mitigation"),
    )


def transferable_by_cover(gap: DataFrame, skills: DataFrame, covers: DataFrame, salts: int = COVER_SALTS) -> DataFrame:
    """As `transferable`, by a directed relation: `covers(skill, covers)` says that who holds the first
    can stand in for the second, not the other way round.

    Every missing skill of a person is looked up once, whatever number of jobs asks for it. A skill
    that many people hold or miss is dealt to `salts` tasks by person, beside a copy of its covers
    in each; what a person can stand in for is combined before it is shuffled.
    """
    salt = F.pmod(F.xxhash64("applicant_id"), F.lit(salts)).cast("int")
    missing = gap.select("applicant_id", "skill").distinct()
    relation = (
        covers.filter(F.col("skill") != F.col("covers"))
        .select("skill", "covers")
        .distinct()
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    # written, so that Spark knows its size: beside a small relation the skills held are not shuffled
    relation = materialise(relation, "covers")
    held = skills.select("applicant_id", "skill").distinct().withColumn("salt", salt)
    reach = (
        held.join(relation, ["skill", "salt"])
        .groupBy("applicant_id", "covers")
        .agg(F.count(F.lit(1)).alias("n_via"), F.min("skill").alias("via"))
    )
    found = missing.join(reach.withColumnRenamed("covers", "skill"), ["applicant_id", "skill"])
    mitigation = F.when(
        F.col("via").isNotNull(),
        F.concat(F.lit("transferable from "), "via", F.lit(", covers "), "skill"),
    ).otherwise(NO_REFRAME)
    return gap.join(found, ["applicant_id", "skill"], "left").select(
        *PAIR,
        F.col("skill").alias("missing_skill"),
        F.coalesce("n_via", F.lit(0)).alias("n_via"),
        mitigation.alias("mitigation"),
    )


def term_table(skills: DataFrame) -> DataFrame:
    """The distinct skills with their words in normal form, as a written table.

    What depends on a term alone is worked out here and not for every text that has it: the number
    of its words and whether it has signs (see `names_term`).
    """
    distinct = skills.select("skill").distinct().withColumn("term", normalised(F.col("skill")))
    return materialise(
        distinct.select(
            "*", F.size(F.split("term", " ")).alias("n_words"), F.col("skill").rlike(SIGNED).alias("signed")
        ),
        "terms",
    )


def term_runs(text: Column, terms: DataFrame) -> Column:
    """The different word runs of a text that are as long as some term."""
    lengths = terms.select("n_words").distinct().collect()
    runs = [ngrams(tokens(text), n) for n in sorted(r["n_words"] for r in lengths)]
    return F.array_distinct(F.concat(*runs)) if runs else F.array().cast("array<string>")


def names_term(text: Column, term: Column, signed: Column) -> Column:
    """Whether a text that holds the words of a term means that term; `signed`: the term has signs.

    Words leave signs out, so C, C++ and C# look alike. A term with signs must stand in the text as
    it is; one without must stand somewhere without a sign that would make it another term.
    """
    quoted = F.concat(F.lit(r"\Q"), F.lower(term), F.lit(r"\E"))
    exact = F.concat(F.lit(r"(?<![\p{L}\p{N}_])"), quoted, F.lit(r"(?![\p{L}\p{N}_+#])"))
    words = F.regexp_replace(normalised(term), " ", r"[^\\p{L}\\p{N}]+")
    bare = F.concat(F.lit(r"(?<![\p{L}\p{N}_])"), words, F.lit(r"(?![\p{L}\p{N}_+#])"))
    return (
        F.when(signed, F.rlike(F.lower(text), exact))
        .when(text.contains("+") | text.contains("#"), F.rlike(F.lower(text), bare))
        .otherwise(True)
    )


def link_bullets(bullets: DataFrame, requirements: DataFrame, distinct: bool = True) -> DataFrame:
    """Which required or preferred terms every bullet supports, by naming them word for word.

    Word runs of a bullet meet the distinct terms, never the postings, so that the result does not
    grow with the number of postings that ask for a term. The terms are written first: if the table
    of terms is small it is broadcast and the runs are not shuffled. Runs have the word counts that
    occur in the table. A term is linked once per bullet row; `distinct` also makes bullets that are listed twice count once, which callers that count terms do not need.
    """
    terms = term_table(requirements)
    runs = bullets.withColumn("term", F.explode(term_runs(F.col("text"), terms)))
    links = runs.join(terms, "term").filter(names_term(F.col("text"), F.col("skill"), F.col("signed"))).select(
        *bullets.columns, "skill", F.col("n_words").alias("overlap")
    )
    return links.distinct() if distinct else links


def top_roles(
    applications: DataFrame,
    requirements: DataFrame,
    links: DataFrame,
    roles: DataFrame,
    k: int = MAX_ROLES,
    minimum: int = MIN_ROLES,
) -> DataFrame:
    """The most relevant roles of every application: by linked requirements, then recency, then id.

    Roles of a person that link the same set of skills score alike for every posting, so only the
    `k` latest of each set can be among the best and the rest is left out before postings are
    joined. That keeps the result exact and holds for people with very many roles. What a role and a
    posting have in common is worked out where the two meet.
    """
    # the distinct terms of one role, at most as many as there are terms
    linked = links.groupBy("role_id").agg(F.array_sort(F.collect_set("skill")).alias("linked"))
    by_role = linked.join(roles.select("applicant_id", "role_id", "start_m"), "role_id")
    newest_first = [F.col("start_m").desc(), F.col("role_id").asc()]
    kept = top_rows(by_role, ["applicant_id", "linked"], newest_first, k)
    # the terms of a posting in one row, so that a role is scored in its row and no term is shuffled alone
    asked = requirements.groupBy("job_id").agg(F.collect_set("skill").alias("asked"))
    met = applications.select(*PAIR).distinct().join(kept, "applicant_id").join(asked, "job_id")
    scored = met.withColumn("shared", F.array_intersect("linked", "asked")).select(
        *PAIR,
        "role_id",
        "start_m",
        F.size("shared").cast("long").alias("score"),
        F.array_join("shared", ", ").alias("reason"),
    )
    # roles without a common term come last, so they are left out after the ranking
    best = top_rows(scored, PAIR, [F.col("score").desc(), *newest_first], k, rank="role_rank").filter("score > 0")
    n_roles = F.count(F.lit(1)).over(Window.partitionBy(*PAIR))  # over `k` rows at most
    return best.select(
        *PAIR, "role_rank", "role_id", "score", "reason", (n_roles < minimum).alias("below_minimum")
    )


def top_bullets(bullets: DataFrame, k: int = MAX_BULLETS) -> DataFrame:
    """The bullets of every role to show: those with numbers first, then by position."""
    numbered = bullets.withColumn("has_number", has_number(F.col("text")))
    order = [F.col("has_number").desc(), F.col("bullet_no").asc(), F.col("text").asc()]
    return top_rows(numbered, ["role_id"], order, k, rank="bullet_rank")


def hook_pairs(
    applications: DataFrame,
    requirements: DataFrame,
    links: DataFrame,
    roles: DataFrame,
    k: int = HOOKS,
) -> DataFrame:
    """The best (posting detail, applicant detail) pairs of every application.

    Longer shared terms first, then details with a number, then the order of the posting. The order
    within one term does not depend on the posting, so only the `k` best bullets of each (person,
    term) can be used; they are picked before postings are joined. A bullet that is listed twice
    counts once. Postings meet the terms of a person without the bullets, and tell which terms can be
    among the best; only bullets of these are joined.
    """
    detail = links.join(roles.select("applicant_id", "role_id"), "role_id").withColumn(
        "has_number", has_number(F.col("text"))
    )
    own_order = [
        F.col("role_id").asc(),
        F.col("bullet_no").asc(),
        F.col("text").asc(),
    ]
    strong_first = [F.col("overlap").desc(), F.col("has_number").desc()]
    strength = ["skill", "overlap", "has_number"]
    # equal rows have one dense rank
    place = F.dense_rank().over(Window.partitionBy("applicant_id", "skill").orderBy(*strong_first, *own_order))
    picked = detail.withColumn("__place", place).filter(F.col("__place") <= k)
    candidates = materialise(
        picked.select("applicant_id", *strength, "role_id", "bullet_no", "text").distinct(), "details"
    )
    # the terms of a person by strength, and those of a posting in order; both as long as there are terms
    gathered = candidates.groupBy("applicant_id").agg(F.collect_set(F.struct(*strength)).alias("held"))
    levels = F.array_distinct(F.transform("held", lambda h: F.struct(h["overlap"].alias("overlap"), h["has_number"].alias("has_number"))))

    def of_level(level: Column) -> Column:
        same = F.filter("held", lambda h: (h["overlap"] == level["overlap"]) & (h["has_number"] == level["has_number"]))
        return level.withField("terms", F.transform(same, lambda h: h["skill"]))

    held = gathered.select("applicant_id", F.transform(levels, of_level).alias("held"))
    asked = requirements.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("rnk", "skill"))).alias("asked"))
    met = applications.select(*PAIR).join(held, "applicant_id").join(asked, "job_id").select(
        *PAIR, "asked", F.inline("held")
    )
    # what comes after the k-th term of one strength has `k` better details
    first = F.slice(F.array_intersect("asked.skill", "terms"), 1, k)
    last = F.struct(F.get("asked", F.array_position("asked.skill", F.try_element_at(first, F.lit(-1))) - 1)["rnk"])
    usable = let(
        last, lambda at: F.filter("asked", lambda a: (F.struct(a["rnk"]) <= at) & F.array_contains("terms", a["skill"]))
    )
    entries = met.select(*PAIR, "overlap", "has_number", F.inline(usable))
    best = F.rank().over(Window.partitionBy(*PAIR).orderBy(*strong_first, F.col("rnk").asc()))
    wanted = entries.withColumn("__best", best).filter(F.col("__best") <= k).drop("__best")
    pairs = wanted.join(candidates, ["applicant_id", *strength])
    order = [*strong_first, F.col("rnk").asc(), *own_order]
    return top_rows(pairs, PAIR, order, k, rank="hook_rank").select(
        *PAIR,
        "hook_rank",
        F.col("skill").alias("posting_detail"),
        F.col("text").alias("applicant_detail"),
    )


def preferred_only(requirements: DataFrame) -> DataFrame:
    """Preferred skills that are not required as well.

    The level flags of a (job, skill) are combined in one aggregation, so it is a single shuffle.
    """
    return (
        requirements.groupBy("job_id", "skill")
        .agg(F.bool_or(F.col("level") == "required").alias("is_required"))
        .filter(~F.col("is_required"))
        .select("job_id", "skill")
    )


def skills_to_list(
    highlighted: DataFrame, applications: DataFrame, requirements: DataFrame, skills: DataFrame
) -> DataFrame:
    """Highlighted skills together with the required skills that the applicant holds."""
    held = skill_match(applications, required(requirements), skills)
    return highlighted.select(*PAIR, "skill").unionByName(held.select(*PAIR, "skill")).distinct()


def strategise(
    applications: DataFrame,
    requirements: DataFrame,
    skills: DataFrame,
    related: DataFrame,
    roles: DataFrame,
    bullets: DataFrame,
) -> DataFrame:
    """One strategy record per application.

    All parts are short: four roles of four bullets, the skills of one posting and three hooks. They
    are brought together as tagged items in one grouping instead of one join per part. The tables
    that several parts read are worked out once and written; all of them are narrow. The items of each
    part are written too, so that what it shuffled is gone from the disk before the next part begins.
    """
    applications = materialise(applications.select(*PAIR), "applications")
    requirements = materialise(requirements.select("job_id", "skill", "rnk", "level"), "requirements")
    skills = materialise(skills.select("applicant_id", "skill"), "skills")
    links = materialise(link_bullets(bullets, requirements, distinct=False), "links")
    texts = (
        top_bullets(bullets)
        .groupBy("role_id")
        .agg(F.array_sort(F.collect_list(F.struct("bullet_rank", "text"))).alias("picked"))
        .select("role_id", F.col("picked.text").alias("bullets"))
    )
    names = roles.select("role_id", "company", "title")
    chosen = (
        top_roles(applications, requirements, links, roles)
        .join(names, "role_id")
        .join(texts, "role_id")
        .select(
            *PAIR,
            F.struct(
                F.lit("role").alias("kind"),
                F.col("role_rank").cast("long").alias("rank"),
                F.col("title").alias("name"),
                "company",
                "reason",
                "bullets",
            ).alias("item"),
        )
    )

    def item(df: DataFrame, kind: str, rank: Column, name: Column, reason: Column) -> DataFrame:
        return df.select(
            *PAIR,
            F.struct(
                F.lit(kind).alias("kind"),
                rank.cast("long").alias("rank"),
                name.alias("name"),
                F.lit("").alias("company"),
                reason.alias("reason"),
                literal_texts([]).alias("bullets"),
            ).alias("item"),
        )

    matched = item(
        skill_match(applications, requirements, skills),
        "match",
        F.lit(0),
        F.col("skill"),
        F.lit(""),
    )
    gaps = item(
        transferable(skill_gap(applications, requirements, skills), skills, related),
        "gap",
        F.lit(0),
        F.col("missing_skill"),
        F.col("mitigation"),
    )
    hooks = item(
        hook_pairs(applications, requirements, links, roles),
        "hook",
        F.col("hook_rank"),
        F.col("posting_detail"),
        F.col("applicant_detail"),
    )
    parts = materialise_parts({"chosen": chosen, "matched": matched, "gaps": gaps, "hooks": hooks})
    every = reduce(DataFrame.unionByName, parts)
    grouped = every.groupBy(*PAIR).agg(F.array_sort(F.collect_list("item")).alias("items"))

    def of_kind(kind: str) -> Column:
        return F.filter(F.coalesce("items", F.array()), lambda i: i["kind"] == kind)

    return applications.join(grouped, PAIR, "left").select(
        *PAIR,
        F.transform(
            of_kind("role"),
            lambda i: F.struct(
                i["company"].alias("company"),
                i["name"].alias("title"),
                i["reason"].alias("reason"),
                i["bullets"].alias("bullets_to_highlight"),
            ),
        ).alias("experiences_to_emphasize"),
        F.transform(of_kind("match"), lambda i: i["name"]).alias("skills_to_highlight"),
        F.transform(
            of_kind("gap"),
            lambda i: F.struct(i["name"].alias("missing_skill"), i["reason"].alias("mitigation")),
        ).alias("skills_gap_strategy"),
        F.transform(
            of_kind("hook"), lambda i: F.concat(i["name"], F.lit(" <- "), i["reason"])
        ).alias("cover_letter_hooks"),
    )


def cardinality_check(strategies: DataFrame) -> DataFrame:
    """Strategies whose parts are too few or too many, one row per broken rule."""
    roles = F.col("experiences_to_emphasize")
    rules = {
        f"{MIN_ROLES}-{MAX_ROLES} roles": F.size(roles).between(MIN_ROLES, MAX_ROLES),
        f"{MIN_BULLETS}-{MAX_BULLETS} bullets per role": F.forall(
            roles, lambda r: F.size(r["bullets_to_highlight"]).between(MIN_BULLETS, MAX_BULLETS)
        ),
        f"{MIN_HOOKS}-{HOOKS} hooks": F.size("cover_letter_hooks").between(MIN_HOOKS, HOOKS),
    }
    broken = F.array(*[F.when(~ok, F.lit(rule)) for rule, ok in rules.items()])
    return strategies.select(
        *PAIR, F.explode(F.filter(broken, lambda rule: rule.isNotNull())).alias("rule")
    )
