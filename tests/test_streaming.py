import pytest
from pyspark.sql import functions as F

from loftline.streaming import states

EVENTS = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events"))
    rows = spark.read.parquet(EVENTS).where("user_id < 8").orderBy("ts")
    rows.where("event_id % 2 = 0 or true").repartitionByRange(3, "ts").sortWithinPartitions("ts").write.mode("overwrite").parquet(path)
    return path


def drain(spark, df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def test_stream_equals_batch(spark, folder):
    rows = states.read_events(spark, folder, files_per_batch=100)
    got = drain(spark, states.filter_stream(rows), "filtered").toPandas().sort_values("seq").reset_index(drop=True)
    table = spark.read.parquet(folder)
    seconds = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) / 1e6")
    base = table.select(F.col("user_id").alias("track_id"), F.col("event_id").alias("seq"), seconds.alias("t"), F.col("value").alias("x"),
                        F.regexp_extract("props", r"\"k\": *(-?[0-9.]+)", 1).cast("double").alias("y"))
    want = states.filter_batch(base).toPandas().sort_values("seq").reset_index(drop=True)
    assert len(got) == len(want) > 0
    assert (got["rejected"] == want["rejected"]).all()
    assert ((got["fx"] - want["fx"]).abs().fillna(0) < 1e-9).all()


def test_windowed_counts(spark, folder):
    rows = states.read_events(spark, folder)
    got = drain(spark, states.state_counts(rows), "counts", "complete").agg(F.sum("count")).first()[0]
    assert got == spark.read.parquet(folder).count()
