from letterloom.streaming.postings import incremental_postings, posting_stream

TEXT = "Title: Planner\nCompany: Acme\nRequired:\n- x"


def test_every_posting_is_taken_in_once(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def arrive(*urls):
        rows = [(u, TEXT) for u in urls]
        spark.createDataFrame(rows, "url string, text string").write.mode("append").parquet(source)

    def run():
        incremental_postings(posting_stream(spark, source), out, state).awaitTermination()
        return sorted(r["url_key"] for r in spark.read.parquet(out).collect())

    arrive("https://a.example/1", "https://a.example/2", "https://a.example/1")
    assert run() == ["a_example_1", "a_example_2"]
    assert run() == ["a_example_1", "a_example_2"]
    # another query is another posting, though both have one name
    arrive("https://a.example/2?id=7", "https://a.example/1", "https://a.example/3")
    assert run() == ["a_example_1", "a_example_2", "a_example_2", "a_example_3"]
    assert {r["job_slug"] for r in spark.read.parquet(out).collect()} == {"acme_planner"}


def test_ten_batches_hold_no_state_and_drop_late_copies(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for day in range(10):
        rows = [(f"https://a.example/{i}", TEXT) for i in (day * 2, day * 2 + 1, 0)]  # the first one comes every day
        spark.createDataFrame(rows, "url string, text string").write.mode("append").parquet(source)
        run = incremental_postings(posting_stream(spark, source), out, state)
        run.awaitTermination()
        assert sum(s.numRowsTotal for p in run.recentProgress for s in p.stateOperators) == 0
    assert spark.read.parquet(out).count() == 20
    assert spark.read.parquet(out).select("identity").distinct().count() == 20


def test_a_batch_that_is_run_again_writes_the_same(spark, tmp_path, monkeypatch):
    from letterloom.streaming import postings

    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = [(f"https://a.example/{i}", TEXT) for i in range(5)]
    spark.createDataFrame(rows, "url string, text string").write.parquet(source)
    kept = postings.update_store

    def lost(*args):
        kept(*args)
        raise RuntimeError("lost after the store was written")

    monkeypatch.setattr(postings, "update_store", lost)
    try:
        incremental_postings(posting_stream(spark, source), out, state).awaitTermination()
    except Exception as problem:
        assert "lost after" in str(problem)
    monkeypatch.setattr(postings, "update_store", kept)
    incremental_postings(posting_stream(spark, source), out, state).awaitTermination()
    assert spark.read.parquet(out).count() == 5
