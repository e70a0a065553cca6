import os

import pytest
from pyspark.sql import functions as F

from lookback.sources import keyed
from lookback.streaming import incremental

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def stream(spark, tmp_path):
    if not os.path.isdir(SF):
        pytest.skip("the shared tables aren't here")
    path = f"{tmp_path}/in"
    spark.read.parquet(f"{SF}/events.parquet").repartition(2).write.parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def test_upserts_equal_the_batch(spark, stream, tmp_path):
    for _ in range(2):  # the second run finds nothing new
        incremental.upsert_stream(stream.select("event_id", "user_id", "ts"), f"{tmp_path}/out", ["user_id"], "event_id", f"{tmp_path}/cp").awaitTermination()
    batch = spark.read.parquet(f"{SF}/events.parquet").groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    got = keyed.read(spark, f"{tmp_path}/out").select("user_id", "event_id")
    assert got.exceptAll(batch).count() == 0 and got.count() == batch.count()


def test_first_sightings_stay(spark, stream, tmp_path):
    for _ in range(2):
        incremental.first_sightings(stream.select("event_id", "user_id", "ts"), f"{tmp_path}/out", ["user_id"], "ts", f"{tmp_path}/cp").awaitTermination()
    batch = spark.read.parquet(f"{SF}/events.parquet").groupBy("user_id").agg(F.min("ts").alias("ts"))
    got = keyed.read(spark, f"{tmp_path}/out").select("user_id", "ts")
    assert got.exceptAll(batch).count() == 0 and got.count() == batch.count()


def test_weeks_close(spark, stream, tmp_path):
    q = incremental.weekly_counts(stream, "ts", ["event_type"]).writeStream.format("memory").queryName("weeks").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = spark.read.parquet(f"{SF}/events.parquet").groupBy(F.to_date(F.date_trunc("WEEK", "ts")).alias("week"), "event_type").count()
    got = spark.table("weeks")
    assert got.count() > 0 and got.select("week", "event_type", "n").exceptAll(batch.toDF("week", "event_type", "n")).count() == 0


def test_a_batch_writes_only_its_buckets(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    frame = lambda rows: spark.createDataFrame(rows, "k string, v int, n int")
    everything = [(f"k{i}", i, 0) for i in range(200)] + [(None, -1, 0)]
    assert len(keyed.upsert(spark, path, frame(everything), ["k"], "n", 16)) == 16
    first = keyed.manifest(spark, path)
    touched = keyed.upsert(spark, path, frame([("k7", 70, 1), ("k7", 71, 2), ("k7", 69, 2), ("new", 5, 1)]), ["k"], "n", 16)
    now = keyed.manifest(spark, path)
    assert len(touched) <= 2 and {b for b in now if now[b] != first[b]} == set(touched)
    got = {r["k"]: r["v"] for r in keyed.read(spark, path).collect()}
    assert len(got) == 202 and got["k7"] == 71 and got["new"] == 5 and got["k8"] == 8
    assert keyed.read(spark, path).filter("k IS NULL").count() == 1
    assert keyed.delete(spark, path, spark.createDataFrame([("k7",), ("k7",), ("absent",)], "k string"), ["k"], 16) == 1
    assert "k7" not in {r["k"] for r in keyed.read(spark, path).collect()} and keyed.read(spark, path).count() == 201


def test_firsts_stay_and_a_lost_change_leaves_the_table(spark, tmp_path):
    from lookback.sources import folders

    path = f"file://{tmp_path}/t"
    frame = lambda rows: spark.createDataFrame(rows, "k string, t int, v string")
    keyed.add_first(spark, path, frame([("a", 5, "x"), ("a", 3, "y"), ("b", 4, "z")]), ["k"], "t", 4)
    keyed.add_first(spark, path, frame([("a", 1, "late"), ("c", 9, "w")]), ["k"], "t", 4)
    rows = lambda: sorted(tuple(r) for r in keyed.read(spark, path).select("k", "t", "v").collect())
    assert rows() == [("a", 3, "y"), ("b", 4, "z"), ("c", 9, "w")]
    keyed.add_first(spark, path, frame([("d", 1, "lost")]), ["k"], "t", 4)
    folders.remove(spark, f"{path}/manifest/00000003/_SUCCESS")
    assert rows() == [("a", 3, "y"), ("b", 4, "z"), ("c", 9, "w")]
    keyed.add_first(spark, path, frame([("e", 1, "kept")]), ["k"], "t", 4)
    assert [r[0] for r in rows()] == ["a", "b", "c", "e"]
