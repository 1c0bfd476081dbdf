import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from letterloom.operators.matching import default_style
from letterloom.schemas import AUTHOR_STYLE
from letterloom.session import tune
from letterloom.sources import files, sinks


def write(folder, **texts):
    folder.mkdir(exist_ok=True)
    for name, text in texts.items():
        (folder / name.replace("__", ".")).write_text(text, encoding="utf-8")
    return str(folder)


def test_read_samples(spark, tmp_path):
    folder = write(tmp_path / "letters", a__md="one\ntwo\n\nthree", B__txt="für")
    (tmp_path / "letters" / ".hidden").write_text("no")
    rows = {r["file_name"]: r for r in files.read_samples(spark, folder, "cover_letter").collect()}
    assert set(rows) == {"a.md", "B.txt"}
    assert rows["a.md"]["text"] == "one\ntwo\n\nthree"
    assert rows["B.txt"]["kind"] == "cover_letter"
    assert rows["B.txt"]["modified_at"] is not None


def test_read_samples_with_a_decoder(spark, tmp_path):
    folder = write(tmp_path / "mixed", a__md="plain", b__PDF="%coded")
    read = files.read_samples(spark, folder, "resume", decoder=lambda raw: raw.decode().strip("%"))
    assert {(r["file_name"], r["text"]) for r in read.collect()} == {("a.md", "plain"), ("b.PDF", "coded")}


def test_an_empty_folder_is_an_error(spark, tmp_path):
    folder = write(tmp_path / "empty")
    (tmp_path / "empty" / ".hidden").write_text("no")
    with pytest.raises(ValueError, match="No documents found"):
        files.read_samples(spark, folder, "resume")


def test_a_missing_posting_is_an_error(spark, tmp_path):
    with pytest.raises(AnalysisException):
        files.read_postings(spark, str(tmp_path / "nowhere")).collect()


def test_templates_are_optional(spark, tmp_path):
    assert files.read_templates(spark, None).count() == 0
    folder = write(tmp_path / "templates", resume__tex="{{SUMMARY}}")
    assert files.read_templates(spark, folder).first()["text"] == "{{SUMMARY}}"


def test_read_profiles(spark, tmp_path):
    good = {"name": "A", "email": "", "summary": "", "skills": [], "experience": [], "education": [], "x": 1}
    folder = write(tmp_path / "profiles", a__json=json.dumps(good), b__json="{}", c__json="nothing")
    valid, invalid = files.read_profiles(spark, folder)
    assert [r["profile"]["name"] for r in valid.collect()] == ["A"]
    assert {r["file_name"]: len(r["violations"]) for r in invalid.collect()} == {"b.json": 6, "c.json": 1}


def test_saved_styles_are_checked(spark, tmp_path):
    styles = spark.createDataFrame([("a",), ("b",)], "author_id string").withColumn("style", default_style())
    cut = F.col("style").withField("voice_profile", F.col("style.voice_profile").dropFields("tone"))
    folder = str(tmp_path / "styles")
    styles.withColumn("style", F.when(F.col("author_id") == "b", F.to_json(cut)).otherwise(F.to_json("style"))).write.parquet(folder)
    saved = files.read_style_cache(spark, folder)
    typed = saved.withColumn("style", F.from_json("style", AUTHOR_STYLE))
    good, bad = files.check_styles(typed)
    assert [r["author_id"] for r in good.collect()] == ["a"]
    assert [(r["author_id"], r["violations"][0]["path"]) for r in bad.collect()] == [("b", "$.voice_profile.tone")]


def test_state_versions(spark, tmp_path):
    first = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    second = spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string")
    old, new = str(tmp_path / "v1"), str(tmp_path / "v2")
    sinks.write_state(first, old, ["k"])
    sinks.write_state(second, new, ["k"], previous=old)
    assert sorted(tuple(r) for r in sinks.read_state(spark, new).collect()) == [(1, "a"), (2, "B"), (3, "c")]
    assert sorted(tuple(r) for r in sinks.read_state(spark, old).collect()) == [(1, "a"), (2, "b")]


def test_profile_copies(spark, tmp_path):
    df = spark.range(3).select("id", F.struct(F.lit("x").alias("name")).alias("profile"))
    editable, debug = str(tmp_path / "json"), str(tmp_path / "parquet")
    sinks.write_profile(df, editable, debug)
    assert spark.read.json(editable).count() == spark.read.parquet(debug).count() == 3


def test_outputs_replace_only_their_slug(spark, tmp_path):
    path = str(tmp_path / "outputs")
    rows = [("a", "1"), ("a", "2"), ("b", "3")]
    sinks.write_outputs(spark.createDataFrame(rows, "job_slug string, text string"), path)
    sinks.write_outputs(spark.createDataFrame([("a", "new")], "job_slug string, text string"), path)
    assert {(r["job_slug"], r["text"]) for r in spark.read.parquet(path).collect()} == {("a", "new"), ("b", "3")}


def test_posting_cache_keeps_one_text_per_posting(spark, tmp_path):
    one, two = str(tmp_path / "c1"), str(tmp_path / "c2")
    schema = "identity string, text string"
    sinks.write_posting_cache(spark.createDataFrame([("k", "old"), ("l", "x")], schema), one)
    sinks.write_posting_cache(spark.createDataFrame([("k", "new")], schema), two, previous=one)
    assert {tuple(r) for r in spark.read.parquet(two).collect()} == {("k", "new"), ("l", "x")}


def test_pretty_json_is_json_without_null_fields(spark):
    df = spark.createDataFrame([(1, None, ["x"])], "a int, b string, c array<string>")
    text = sinks.to_pretty_json(df.select(F.struct("*").alias("r")), "r").first()["json"]
    assert json.loads(text) == {"a": 1, "c": ["x"]}
    assert "\n" in text


def test_folders_are_listed_by_few_tasks(spark, tmp_path):
    """A folder a row, read back whole, without a listing task for each of them."""
    default = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    tune(spark)
    assert int(spark.conf.get(default)) <= max(32, 4 * spark.sparkContext.defaultParallelism)
    rows = spark.range(100).select("id", F.concat(F.lit("a\n\né "), F.col("id").cast("string")).alias("text"))
    rows.write.partitionBy("id").text(str(tmp_path / "texts"))
    stages = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("listing", "listing")
    try:
        read = files.read_texts(spark, str(tmp_path / "texts")).select("id", "text")
        widths = [
            stages.getStageInfo(s).numTasks
            for j in stages.getJobIdsForGroup("listing")
            for s in stages.getJobInfo(j).stageIds
        ]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert widths and max(widths) <= max(32, 4 * spark.sparkContext.defaultParallelism)
    assert sorted(map(tuple, read.collect())) == [(i, f"a\n\né {i}\n") for i in range(100)]
