import datetime as dt

from pyspark.sql import functions as F

from voxelane.streaming import live


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def events(spark, first, n):
    start = dt.datetime(2024, 1, 1)
    rows = [(k % 3, start + dt.timedelta(minutes=(k // 3) * 7 + (45 if k // 3 % 5 == 4 else 0)), float(k)) for k in range(first, first + n)]
    return spark.createDataFrame(rows, "user_id long, ts timestamp, value double")


def test_a_stream_gives_what_the_batch_gives(spark, tmp_path):
    source, whole = str(tmp_path / "in"), events(spark, 0, 90)
    events(spark, 0, 60).write.parquet(source)
    stream = lambda: live.watch(spark, source, whole.schema, files_a_batch=1)
    means = lambda df: live.window_means(df, "30 minutes", ("user_id",), late="365 days")
    runs = lambda df: live.bursts(df, "20 minutes", ("user_id",), late="365 days")
    for name, use in (("means", means), ("runs", runs)):
        live.latest(use(stream()), str(tmp_path / name), str(tmp_path / f"{name}-state"))
        assert rows_of(spark.read.parquet(str(tmp_path / name))) == rows_of(use(events(spark, 0, 60)))
    events(spark, 60, 30).write.mode("append").parquet(source)
    for name, use in (("means", means), ("runs", runs)):
        live.latest(use(stream()), str(tmp_path / name), str(tmp_path / f"{name}-state"))
        assert rows_of(spark.read.parquet(str(tmp_path / name))) == rows_of(use(whole))


def test_ingested_rows_arrive_once(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = events(spark, 0, 1).schema
    for first in (0, 30):
        events(spark, first, 30).write.mode("append").parquet(source)
        for _ in range(2):
            live.ingest(live.watch(spark, source, schema), target, state, lambda df: df.withColumn("value", F.col("value") * 2))
    got = spark.read.parquet(target)
    assert got.count() == 60 and got.agg(F.sum("value")).first()[0] == 2 * sum(range(60))
