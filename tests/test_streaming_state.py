"""State of streams: sums over batches and restarts, forgotten after their time."""

import datetime as dt

from pyspark.sql import functions as F

from glintmark.streaming import incremental

DAY = dt.datetime(2024, 1, 1)


def run(spark, tmp_path, build, name):
    """Runs a stream over the files in `in` to the end of what is there; returns its rows and how many keys its state has."""
    stream = spark.readStream.schema("credential_key string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = []
    q = build(stream).writeStream.outputMode("update").foreachBatch(lambda b, _: got.extend(b.collect())).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return got, sum(x["numRowsTotal"] for x in q.lastProgress["stateOperators"]) if q.lastProgress else None


def put(spark, tmp_path, *rows):
    spark.createDataFrame([(k, DAY + dt.timedelta(days=d)) for k, d in rows], "credential_key string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def test_exposure_goes_on_after_a_restart_and_expires(spark, tmp_path):
    build = lambda x: incremental.exposure_stream(x, late="1 day", keep="10 days")
    put(spark, tmp_path, ("a", 0), ("a", 2), ("b", 1), *[("hot", 0)] * 5000)
    got, _ = run(spark, tmp_path, build, "cp")
    assert {(r.credential_key, (r.first_seen - DAY).days, (r.last_seen - DAY).days, r.n) for r in got} == {("a", 0, 2, 2), ("b", 1, 1, 1), ("hot", 0, 0, 5000)}
    put(spark, tmp_path, ("a", 4), ("b", 3), (None, 3))
    got, _ = run(spark, tmp_path, build, "cp")  # another query from the same checkpoint
    assert {(r.credential_key, (r.first_seen - DAY).days, (r.last_seen - DAY).days, r.n) for r in got} == {("a", 0, 4, 3), ("b", 1, 3, 2), (None, 3, 3, 1)}
    put(spark, tmp_path, ("c", 40))
    run(spark, tmp_path, build, "cp")
    put(spark, tmp_path, ("a", 41), ("c", 41))
    got, kept = run(spark, tmp_path, build, "cp")
    assert {(r.credential_key, (r.first_seen - DAY).days, r.n) for r in got} == {("a", 41, 1), ("c", 40, 2)}
    put(spark, tmp_path, ("d", 90))
    run(spark, tmp_path, build, "cp")
    put(spark, tmp_path, ("d", 91))
    _, left = run(spark, tmp_path, build, "cp")
    assert left < kept


def test_seen_set_expires(spark, tmp_path):
    build = lambda x: incremental.first_seen(x, late="2 days")
    put(spark, tmp_path, ("a", 0), ("a", 1), ("b", 1))
    got, _ = run(spark, tmp_path, build, "seen")
    assert sorted(r.credential_key for r in got) == ["a", "b"]
    put(spark, tmp_path, ("a", 2), ("c", 2))
    got, _ = run(spark, tmp_path, build, "seen")
    assert [r.credential_key for r in got] == ["c"]
    put(spark, tmp_path, ("z", 50))
    run(spark, tmp_path, build, "seen")
    put(spark, tmp_path, ("a", 50), ("z", 50))
    got, kept = run(spark, tmp_path, build, "seen")
    assert [r.credential_key for r in got] == ["a"] and kept <= 2


def test_batch_form(spark):
    rows = spark.createDataFrame([("a", DAY), ("a", DAY + dt.timedelta(days=1))], "credential_key string, ts timestamp")
    r = incremental.exposure_stream(rows).select("n", F.datediff("last_seen", "first_seen").alias("d")).first()
    assert (r.n, r.d) == (2, 1)
