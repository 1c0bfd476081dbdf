"""Roles and hooks are chosen where a person and a posting meet, not from one shuffled row a term."""

import contextlib
import io
import random

from pyspark.sql import functions as F

from letterloom.operators import matching


def plan_of(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain()
    return text.getvalue().split("Initial Plan")[-1]


def world(spark):
    rng = random.Random(5)
    names = [f"{a} {b}" for a in ("red", "blue") for b in ("pipe", "wire", "box")] + ["pipe", "wire", "big red pipe"]
    roles = [(rng.randrange(5), r, rng.randrange(9)) for r in range(60)]
    links = []
    for r in range(60):
        for no in range(rng.randrange(5)):
            skill = rng.choice(names)
            text = f"Did {rng.choice(['3 of ', ''])}{skill}"
            links += [(r, no % 2, text, skill, len(skill.split()))] * rng.choice([1, 1, 2])
    # places of a posting are shared, and some terms are listed twice
    asked = [(j, s, rng.randrange(3)) for j in range(8) for s in rng.sample(names, 5)]
    asked += [row for row in asked if row[2] == 1]
    applications = [(p, j) for p in range(6) for j in range(9) if rng.random() < 0.7]
    tables = (
        spark.createDataFrame(applications, "applicant_id int, job_id int"),
        spark.createDataFrame(asked, "job_id int, skill string, rnk int"),
        spark.createDataFrame(links, "role_id int, bullet_no int, text string, skill string, overlap int"),
        spark.createDataFrame(roles, "applicant_id int, role_id int, start_m int"),
    )
    return tables, applications, asked, links, roles


def test_roles_by_terms_in_common(spark):
    tables, applications, asked, links, roles = world(spark)
    got = matching.top_roles(*tables, k=2)
    expected = set()
    for person, job in applications:
        terms = {s for j, s, _ in asked if j == job}
        scored = []
        for owner, role, start in roles:
            both = {link[3] for link in links if link[0] == role} & terms
            if owner == person and both:
                scored.append((-len(both), -start, role, ", ".join(sorted(both))))
        for place, (score, _, role, reason) in enumerate(sorted(scored)[:2], 1):
            expected.add((person, job, place, role, -score, reason, len(scored) < 2))
    assert len(expected) > 30
    assert {tuple(r) for r in got.collect()} == expected
    # a term is shuffled alone once, when the terms of a posting are gathered
    assert plan_of(got).count("SortMergeJoin [applicant_id#") + plan_of(got).count("hashpartitioning(applicant_id#") > 0
    assert "skill#" not in "".join(line for line in plan_of(got).splitlines() if "Join [" in line)


def test_hooks_with_shared_places_and_double_listings(spark):
    tables, applications, asked, links, roles = world(spark)
    for k in (1, 3):
        got = matching.hook_pairs(*tables, k=k)
        owner = {role: person for person, role, _ in roles}
        expected, n_twice = [], 0
        for person, job in applications:
            found = []
            for j, skill, place in asked:
                # the `k` best bullets of a term, once each
                mine = sorted({
                    (-len(skill.split()), not any(c.isdigit() for c in t), role, no, t)
                    for role, no, t, s, _ in links if s == skill and owner[role] == person
                })[:k]
                found += [(a, b, place, *rest, skill) for a, b, *rest in mine if j == job]
            found.sort()
            n_twice += len(found) - len(set(found))
            # where two terms of a place have one bullet, either may come first
            expected += [(person, job, n, f[5]) for n, f in enumerate(found[:k], 1)]
        assert n_twice > 0
        rows = got.select("applicant_id", "job_id", "hook_rank", "applicant_detail").collect()
        assert sorted(tuple(r) for r in rows) == sorted(expected)


def test_only_bullets_of_usable_terms_meet_postings(spark):
    n = 40
    links = spark.range(n).select(
        F.lit(1).alias("role_id"), F.col("id").cast("int").alias("bullet_no"), F.concat(F.lit("Did t"), "id").alias("text"),
        F.concat(F.lit("t"), "id").alias("skill"), F.lit(1).alias("overlap"),
    )
    asked = spark.range(n).select(F.lit(7).alias("job_id"), F.concat(F.lit("t"), "id").alias("skill"), F.col("id").alias("rnk"))
    roles = spark.createDataFrame([(1, 1, 1)], "applicant_id int, role_id int, start_m int")
    hooks = matching.hook_pairs(spark.createDataFrame([(1, 7)], "applicant_id int, job_id int"), asked, links, roles)
    assert [r["posting_detail"] for r in hooks.orderBy("hook_rank").collect()] == ["t0", "t1", "t2"]
    assert "array_intersect" in plan_of(hooks)


def test_shared_tables_of_strategies_are_written_once(spark, monkeypatch):
    (applications, asked, links, roles), *_ = world(spark)
    written, write = [], matching.materialise
    monkeypatch.setattr(matching, "materialise", lambda df, purpose: (written.append(purpose), write(df, purpose))[1])
    skills = links.join(roles, "role_id").select("applicant_id", "skill").distinct()
    matching.strategise(
        applications,
        asked.withColumn("level", F.lit("required")),
        skills,
        skills.select("skill", F.col("skill").alias("topic")).distinct(),
        roles.select("*", F.lit("t").alias("title"), F.lit("c").alias("company")),
        links.select("role_id", "bullet_no", "text"),
    )
    assert sorted(written) == ["applications", "details", "links", "requirements", "skills", "terms"]
