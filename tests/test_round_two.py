"""Cases that once gave a crash, a wrong answer or lost rows."""

import pytest
from pyspark.sql import functions as F

from letterloom.constants import FILLER_WORDS
from letterloom.operators import checks, extract, intake, matching, profile, templates
from letterloom.plans import phases


def test_an_author_without_a_finished_sentence_has_no_means(spark):
    rows = [("a", "cover_letter", 1, "no end mark"), ("b", "cover_letter", 2, "One two. Three four.")]
    styles = phases.calibrate(spark.createDataFrame(rows, "author_id string, kind string, doc_id long, text string"))
    found = {r["author_id"]: r["mean_words"] for r in styles.collect()}
    assert found["a"] is None and found["b"] == 2.0


def test_two_spellings_of_one_key(spark):
    df = spark.sql("SELECT 'x {{SKILL}}' AS text, map('SKILL', 'a', '{{SKILL}}', 'b') AS variables")
    assert templates.inject(df).first()["filled"] == "x a"
    assert templates.template_contract(df).first()["extra_keys"] == []


def test_long_phrases_are_found(spark):
    outputs = spark.createDataFrame([(1, "x", "I am passionate about this. I am passionate about that")], "id long, author_id string, text string")
    lists = spark.createDataFrame([("x", w) for w in FILLER_WORDS], "author_id string, phrase string")
    found = checks.forbidden_by_author(outputs, lists).collect()
    assert [(r["phrase"], r["n"]) for r in found] == [("I am passionate about", 2)]


def test_long_terms_and_signs(spark):
    terms = spark.createDataFrame([(t,) for t in ("C", "C++", "C#", ".NET", "amazon web services lambda")], "skill string")
    texts = {1: "wrote C code", 2: "wrote C++ code", 3: "C# and .NET", 4: "on Amazon Web Services Lambda.", 5: "C++, C"}
    bullets = spark.createDataFrame(list(texts.items()), "role_id long, text string")
    linked = {(r["role_id"], r["skill"]) for r in matching.link_bullets(bullets, terms).collect()}
    wanted = {(1, "C"), (2, "C++"), (3, "C#"), (3, ".NET"), (4, "amazon web services lambda"), (5, "C++"), (5, "C")}
    assert linked == wanted
    mentions = profile.skill_mentions(bullets, terms, ["role_id"]).collect()
    assert {(r["role_id"], r["skill"]) for r in mentions} == wanted


def test_one_held_skill_counts_once(spark):
    gap = spark.createDataFrame([(1, 2, "s")], "applicant_id long, job_id long, skill string")
    held = spark.createDataFrame([(1, "t")], "applicant_id long, skill string")
    related = spark.createDataFrame([(s, p) for s in "st" for p in "xy"], "skill string, topic string")
    row = matching.transferable(gap, held, related).first()
    assert (row["n_via"], row["mitigation"]) == (1, "transferable from t, covers s")


def test_postings_with_one_name_are_kept(spark):
    long = "https://a.example/" + "p" * 90
    urls = ["https://a.example/?id=1", "https://a.example/?id=2", long + "1", long + "2", None, None]
    rows = [(u, i, f"text {i}") for i, u in enumerate(urls)] + [(urls[0], 9, "again")]
    df = spark.createDataFrame(rows, "url string, page_id long, text string")
    keyed = df.withColumn("identity", intake.posting_identity(F.col("url"), F.col("text")))
    every = intake.all_postings(keyed, keyed.limit(0), "identity", ["page_id"])
    assert sorted(r["page_id"] for r in every.collect()) == [0, 1, 2, 3, 4, 5]


def test_years_are_no_phone_number(spark):
    df = spark.createDataFrame([("2019 - 2023\n+49 30 1234567",), ("2019 - 2023",)], "text string")
    assert [r["phone"] for r in profile.contacts(df).collect()] == ["+49 30 1234567", ""]


@pytest.mark.parametrize(
    ("pay", "low", "high"),
    [
        ("$120.5k - $150.5k", 120500.0, 150500.0),
        ("$45.50 - $60.25", 45.5, 60.25),
        ("$120,000 - 150,000", 120000.0, 150000.0),
        ("€1.200.000", 1200000.0, None),
    ],
)
def test_pay(spark, pay, low, high):
    df = spark.createDataFrame([(1, f"Salary: {pay}\n")], "id long, text string")
    row = extract.salary_range(df, ["id"]).first()
    assert (row["salary_low"], row["salary_high"]) == (low, high)


def test_terms_are_found_as_words(spark):
    outputs = spark.createDataFrame([(1, 1, "Javascript and django, C++")], "id long, job_id long, text string")
    wanted = spark.createDataFrame([(1, s, "required") for s in ("Java", "Go", "C++")], "job_id long, skill string, level string")
    row = checks.ats_coverage(outputs, wanted, ["id"]).first()
    assert (row["n_terms"], row["n_found"]) == (3, 1)


def test_coverage_without_requirements(spark):
    applications = spark.createDataFrame([(1, 1), (1, 2)], "applicant_id long, job_id long")
    wanted = spark.createDataFrame([(1, "s", "required")], "job_id long, skill string, level string")
    held = spark.createDataFrame([(1, "s"), (1, "s")], "applicant_id long, skill string")
    found = {r["job_id"]: (r["n_required"], r["n_matched"], r["coverage"]) for r in matching.coverage(applications, wanted, held).collect()}
    assert found == {1: (1, 1, 1.0), 2: (0, 0, None)}


def test_a_person_is_one_header_and_one_record_a_role(spark):
    rows = [(1, "name", "", "Ann", ""), *[(1, "skill", "", f"s{i}", "") for i in range(31)]]
    rows += [(1, "role", "7", "Planner", ""), (1, "bullet", "7", "Did it", ""), (1, "role", "8", "Lead", "")]
    items = spark.createDataFrame(rows, "applicant_id int, section string, ref string, item string, detail string")
    got = {r["ref"]: r["profile"] for r in phases.profile_records(items).collect()}
    assert set(got) == {"", "7", "8"}
    assert got[""]["name"] == "Ann" and len(got[""]["skills"]) == 31
    assert [b["text"] for b in got["7"]["bullets"]] == ["Did it"] and got["8"]["bullets"] == []


def test_letters_of_unknown_jobs_are_kept_and_break_the_rule(spark):
    letters = spark.sql("SELECT 1 AS id, 9 AS job_id, 'we like java' AS text")
    asked = spark.sql("SELECT 2 AS job_id, 'java' AS skill, 'required' AS level")
    found = checks.ats_coverage(letters, asked, ["id"]).first()
    assert (found["n_terms"], found["n_found"], found["share"]) == (0, 0, None)
    jobs = spark.sql("SELECT 2 AS job_id, 'Acme' AS company_name, array('java') AS details")
    assert checks.company_specific(letters, jobs, ["id"]).first()["ok"] is False


@pytest.mark.parametrize(
    ("heading", "kind"),
    [
        ("Requirements:", "required"),
        ("Must have", "required"),
        ("Required:", "required"),
        ("Nice to have:", "preferred"),
        ("Preferred qualifications:", "preferred"),
        ("Responsibilities:", "responsibility"),
    ],
)
def test_wordings_and_signs_of_lists(spark, heading, kind):
    text = f"Title: Planner\n{heading}\n\n* Java\n- C++\n\n  • Go\nApply: now\n- later"
    df = spark.createDataFrame([(1, text)], "id long, text string")
    found = [(r["kind"], r["position"], r["item"]) for r in extract.section_items(df, ["id"]).collect()]
    assert found == [(kind, 1, "Java"), (kind, 2, "C++"), (kind, 3, "Go")]


def test_a_heading_with_a_value_is_no_list(spark):
    df = spark.createDataFrame([(1, "Required: 3 years\nRequired:\n- Java")], "id long, text string")
    assert [r["item"] for r in extract.section_items(df, ["id"]).collect()] == ["Java"]


def test_a_crawled_posting_gives_a_record(spark):
    body = (
        "<html><title>Jobs</title><nav>Menu</nav><script>x</script><p><b>Title</b>: Senior Planner</p>"
        "<div>Company: Acme &amp; Sons<br>Location: Oslo</div><h2>Requirements</h2><ul><li><p>Java</p></li>\n"
        "<li></li><li>5 &lt;li&gt; tags</li></ul><h3>Nice to have</h3><ol><li>Go</li></ol></html>"
    )
    fetched = spark.createDataFrame([("https://a.example/1", 200, body + f"<!--{'x' * 600}-->")], "url string, status int, body string")
    record = phases.ingest_pages(fetched).first()["job_context"]
    assert (record["job_title"], record["company_name"], record["location"]) == ("Senior Planner", "Acme & Sons", "Oslo")
    assert record["required_skills"] == ["Java", "5 <li> tags"] and record["preferred_skills"] == ["Go"]
