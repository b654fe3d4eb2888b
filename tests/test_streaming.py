"""Streams against the batch meaning of the same rows."""

from corpusmill.streaming import state


def _drain(frame, path, mode="append"):
    name = "t" + str(abs(hash(str(path))))
    q = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    return frame.sparkSession.table(name)


def test_failure_latch(spark, tmp_path):
    rows = [("a", False, 1), ("a", False, 2), ("a", True, 3), ("a", False, 4), ("b", False, 1), ("b", False, 2)]
    spark.createDataFrame(rows, "k string, ok boolean, at long").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, ok boolean, at long").parquet(f"{tmp_path}/in")
    got = {r.k: (r.failures, r.latched) for r in _drain(state.failure_latch(stream, "k", 2), tmp_path, "update").collect()}
    assert got == {"a": (1, False), "b": (2, True)}


def test_job_states(spark, tmp_path):
    spark.createDataFrame([("j", "PENDING", 1), ("j", "DONE", 30), ("i", "RUNNING", 5)], "k string, state string, s long").selectExpr("k", "state", "timestamp_seconds(s) at").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, state string, at timestamp").parquet(f"{tmp_path}/in").withWatermark("at", "1 minute")
    got = {(r.k, r.state, r.attempts, r.expired) for r in _drain(state.job_states(stream, "k"), tmp_path, "update").collect()}
    assert ("j", "DONE", 2, False) in got and ("i", "RUNNING", 1, False) in got


def test_first_seen_and_windows(spark, tmp_path):
    spark.createDataFrame([("u", 1), ("u", 2), ("v", 3)], "k string, s long").selectExpr("k", "timestamp_seconds(s) at").coalesce(1).write.parquet(f"{tmp_path}/in")
    read = lambda: spark.readStream.schema("k string, at timestamp").parquet(f"{tmp_path}/in")
    assert sorted(r.k for r in _drain(state.first_seen(read(), ["k"], "at"), tmp_path / "a").collect()) == ["u", "v"]
    counts = _drain(state.windowed_counts(read(), "at", "k", "1 hour", "1 hour"), tmp_path / "b", "update")
    assert sorted((r.k, r.n) for r in counts.collect()) == [("u", 2), ("v", 1)]
