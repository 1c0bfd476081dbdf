"""Matching and rankings against brute force, with one person who holds most of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from letterloom.operators import matching

NAMES = ["red pipe", "blue pipe", "red wire", "wire", "big red pipe"]


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(7)
    people = [0] * 6 + list(range(1, 8))
    roles = [(rng.choice(people), r, f"t{r}", f"c{r % 3}", rng.randrange(100)) for r in range(120)]
    bullets = set()
    for r in range(120):
        for b in range(rng.randrange(6)):
            number = f"{rng.randrange(9)} of " if rng.random() < 0.5 else ""
            bullets.add((r, b, f"Did {number}{rng.choice(NAMES)} work"))
    requirements = []
    for j in range(6):
        for i, s in enumerate(rng.sample(NAMES, 4)):
            requirements.append((j, s, i + 1, "required" if i < 3 else "preferred"))
    skills = {(p, s) for p in set(people) for s in NAMES if rng.random() < 0.5}
    applications = {(rng.choice(people), rng.randrange(6)) for _ in range(40)}
    return {
        "roles": sorted(roles),
        "bullets": sorted(bullets),
        "requirements": requirements,
        "skills": sorted(skills),
        "applications": sorted(applications),
    }


@pytest.fixture(scope="module")
def tables(spark, world):
    schemas = {
        "roles": "applicant_id int, role_id int, title string, company string, start_m int",
        "bullets": "role_id int, bullet_no int, text string",
        "requirements": "job_id int, skill string, rnk int, level string",
        "skills": "applicant_id int, skill string",
        "applications": "applicant_id int, job_id int",
    }
    return {n: spark.createDataFrame(world[n], s).repartition(4) for n, s in schemas.items()}


def names(text, skill):
    return f" {skill} " in f" {text.lower()} "


def test_links(tables, world):
    got = {(r["role_id"], r["bullet_no"], r["skill"]) for r in matching.link_bullets(tables["bullets"], tables["requirements"]).collect()}
    asked = {r[1] for r in world["requirements"]}
    assert got == {(r, b, s) for r, b, t in world["bullets"] for s in asked if names(t, s)}


def test_top_roles(tables, world):
    links = matching.link_bullets(tables["bullets"], tables["requirements"])
    got = matching.top_roles(tables["applications"], tables["requirements"], links, tables["roles"], k=3)
    wanted = set()
    for person, job in world["applications"]:
        asked = {s for j, s, _, _ in world["requirements"] if j == job}
        scored = []
        for owner, role, _, _, start in world["roles"]:
            hit = {s for r, _, t in world["bullets"] if r == role for s in asked if names(t, s)}
            if owner == person and hit:
                scored.append((-len(hit), -start, role))
        for rank, (score, _, role) in enumerate(sorted(scored)[:3], 1):
            wanted.add((person, job, rank, role, -score, len(scored) < 2))
    assert {
        (r["applicant_id"], r["job_id"], r["role_rank"], r["role_id"], r["score"], r["below_minimum"])
        for r in got.collect()
    } == wanted


def test_hooks(tables, world):
    links = matching.link_bullets(tables["bullets"], tables["requirements"])
    got = matching.hook_pairs(tables["applications"], tables["requirements"], links, tables["roles"])
    owner = {r: p for p, r, *_ in world["roles"]}
    wanted = set()
    for person, job in world["applications"]:
        found = []
        for j, skill, rank, _ in world["requirements"]:
            for role, no, text in world["bullets"]:
                if j == job and owner[role] == person and names(text, skill):
                    numbered = any(c.isdigit() for c in text)
                    found.append((-len(skill.split()), not numbered, rank, role, no, text, skill))
        for place, f in enumerate(sorted(found)[:3], 1):
            wanted.add((person, job, place, f[6], f[5]))
    assert {tuple(r) for r in got.collect()} == wanted


def test_matched_and_missing_make_up_the_required(tables, world):
    a, r, s = tables["applications"], tables["requirements"], tables["skills"]
    matched = {tuple(x) for x in matching.skill_match(a, matching.required(r), s).select("applicant_id", "job_id", "skill").collect()}
    missing = {tuple(x) for x in matching.skill_gap(a, r, s).collect()}
    required = {(p, j, sk) for p, j in world["applications"] for jj, sk, _, lv in world["requirements"] if jj == j and lv == "required"}
    assert matched.isdisjoint(missing)
    assert matched | missing == required
    counted = {(c["applicant_id"], c["job_id"]): c["n_missing"] for c in matching.coverage(a, r, s).collect()}
    assert sum(counted.values()) == len(missing)


def test_transferable(spark, tables):
    gap = spark.createDataFrame([(1, 1, "x"), (1, 2, "x"), (2, 1, "x"), (2, 1, "y")], "applicant_id int, job_id int, skill string")
    held = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "applicant_id int, skill string")
    topics = [("a", "t"), ("b", "t"), ("x", "t"), ("c", "u"), ("z", "u")]
    related = spark.createDataFrame(topics, "skill string, topic string")
    got = {(r["applicant_id"], r["job_id"], r["missing_skill"]): (r["n_via"], r["mitigation"]) for r in matching.transferable(gap, held, related).collect()}
    assert got[(1, 1, "x")] == got[(1, 2, "x")] == (2, "transferable from a, covers x")
    assert got[(2, 1, "x")] == got[(2, 1, "y")] == (0, "no credible reframe")


def test_strategies_hold_every_application_once(spark, tables, world):
    related = spark.createDataFrame([("red wire", "t"), ("wire", "t")], "skill string, topic string")
    made = matching.strategise(
        tables["applications"], tables["requirements"], tables["skills"], related, tables["roles"], tables["bullets"]
    )
    rows = made.collect()
    assert sorted((r["applicant_id"], r["job_id"]) for r in rows) == world["applications"]
    assert all(len(r["experiences_to_emphasize"]) <= 4 and len(r["cover_letter_hooks"]) <= 3 for r in rows)
    broken = {(r["applicant_id"], r["job_id"]) for r in matching.cardinality_check(made).collect() if r["rule"] == "2-4 roles"}
    assert broken == {(r["applicant_id"], r["job_id"]) for r in rows if len(r["experiences_to_emphasize"]) < 2}


def test_preferred_skills_that_are_required_too_are_left_out(spark):
    rows = [(1, "a", "required"), (1, "a", "preferred"), (1, "b", "preferred"), (2, "a", "preferred")]
    df = spark.createDataFrame(rows, "job_id int, skill string, level string")
    assert {tuple(r) for r in matching.preferred_only(df).collect()} == {(1, "b"), (2, "a")}


def test_cached_rows_are_split(spark):
    df = spark.range(5).withColumnRenamed("id", "k")
    cache = spark.createDataFrame([(1,), (1,), (3,)], "k long")
    reused, again = matching.split_cached(df, cache, ["k"])
    assert (sorted(r[0] for r in reused.collect()), sorted(r[0] for r in again.collect())) == ([1, 3], [0, 2, 4])
    none, everything = matching.split_cached(df, cache, ["k"], reuse=False)
    assert (none.count(), everything.count()) == (0, 5)


def test_authors_without_a_style_get_the_default_one(spark):
    authors = spark.createDataFrame([("a",), ("b",)], "author_id string")
    styles = authors.filter("author_id = 'a'").withColumn("style", matching.default_style())
    rows = {r["author_id"]: r for r in matching.style_or_default(authors, styles).collect()}
    assert rows["a"]["is_default"] is False
    assert rows["b"]["is_default"] is True
    assert rows["b"]["style"]["voice_profile"]["common_transitions"] == ["Additionally", "Furthermore"]


def test_broken_cardinalities(spark):
    role = F.struct(F.array(*[F.lit("b")] * 5).alias("bullets_to_highlight"))
    df = spark.range(1).select(
        F.lit(1).alias("applicant_id"), F.lit(1).alias("job_id"), F.array(role, role).alias("experiences_to_emphasize"),
        F.array(F.lit("h")).alias("cover_letter_hooks"),
    )
    rules = {r["rule"] for r in matching.cardinality_check(df).collect()}
    assert rules == {"2-4 bullets per role", "2-3 hooks"}


def test_skills_held_are_not_shuffled_beside_a_small_relation(spark):
    gap = spark.createDataFrame([(1, 7, "b"), (2, 7, "b")], "applicant_id int, job_id int, skill string")
    held = spark.range(1000).select(F.col("id").cast("int").alias("applicant_id"), F.lit("a").alias("skill"))
    covers = spark.createDataFrame([("a", "b"), ("b", "b")], "skill string, covers string")
    found = matching.transferable_by_cover(gap, held, covers)
    assert {tuple(r)[:4] for r in found.collect()} == {(1, 7, "b", 1), (2, 7, "b", 1)}
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert any("Join" in line and "Broadcast" in line and "salt" in line for line in plan.splitlines())
