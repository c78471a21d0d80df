"""Streams run to the end of their input give the batch answer."""

import datetime
from pyspark.sql import functions as F

from tidefold.operators import lattice as L
from tidefold.streaming import merge as S


def drained(df, tmp_path, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.sql(f"select * from {name}")


def source(spark, tmp_path, rows, schema):
    path = str(tmp_path / "in")
    half = len(rows) // 2
    for part in (rows[:half], rows[half:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_counters_equal_batch(spark, tmp_path):
    rows = [("k", "a", 3), ("k", "a", 5), ("k", "b", 2), ("j", "a", 1), ("k", "a", 4), ("k", "b", 2)]
    got = drained(S.counters(source(spark, tmp_path, rows, "k string, replica string, count long"), ["k"]), tmp_path, "counters", "complete")
    want = L.per_replica_max(spark.createDataFrame(rows, "k string, replica string, count long"), ["k"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_in_order_release(spark, tmp_path):
    rows = [("a", 2, "2"), ("a", 1, "1"), ("b", 3, "3"), ("a", 1, "again"), ("b", 1, "1"), ("a", 4, "4"), ("a", 3, "3")]
    got = drained(S.in_order(source(spark, tmp_path, rows, "sender string, seq long, payload string")), tmp_path, "ordered", "append")
    assert sorted(map(tuple, got.collect())) == [("a", 1, "1"), ("a", 2, "2"), ("a", 3, "3"), ("a", 4, "4"), ("b", 1, "1")]


def test_tail_drops_repeats(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [(1, t), (2, t), (1, t), (3, t), (2, t)]
    got = drained(S.tail(source(spark, tmp_path, rows, "id long, ts timestamp"), ["id"], "ts"), tmp_path, "tail", "append")
    assert sorted(r["id"] for r in got.collect()) == [1, 2, 3]


def test_threshold_and_presence(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [("a", 1, "x", t), ("b", 1, "y", t), ("a", 2, None, t), ("a", 2, "x", t)]
    stream = source(spark, tmp_path, rows, "replica string, clock long, value string, ts timestamp")
    q = S.until(stream.groupBy().agg(F.count("*").alias("n")), lambda df: df.first()["n"] >= 2, str(tmp_path / "until"), "until")
    q.awaitTermination(120)
    assert q.reached["at"] == 0
    got = drained(S.presence(stream.withWatermark("ts", "1 minute"), 60_000), tmp_path, "presence", "update").collect()
    assert ("a", 2, True) in set(map(tuple, got)) and ("b", 1, True) in set(map(tuple, got))


def test_presence_departs_after_silence(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [("quiet", 1, "x", t), ("talks", 1, "x", t), ("talks", 2, "x", t + datetime.timedelta(hours=1)), ("talks", 3, "x", t + datetime.timedelta(hours=1, seconds=1))]
    stream = source(spark, tmp_path, rows, "replica string, clock long, value string, ts timestamp")
    got = set(map(tuple, drained(S.presence(stream.withWatermark("ts", "1 minute"), 60_000), tmp_path, "silence", "update").collect()))
    assert ("quiet", 1, True) in got and ("quiet", 1, False) in got
    assert ("talks", 3, True) in got and ("talks", 3, False) not in got


def test_pairing_stream(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    at = lambda s: t + datetime.timedelta(seconds=s)
    rows = [("pair", 1, at(0)), ("alone", 1, at(0)), ("pair", 2, at(5)), ("pair", 1, at(8)), ("tick", 1, at(3600)), ("tick", 3, at(3601)), ("pair", 3, at(3602)), ("tick", 1, at(3603))]
    got = drained(S.pairing(source(spark, tmp_path, rows, "session string, members long, ts timestamp").withWatermark("ts", "1 second"), 2, 10_000), tmp_path, "pairing", "append")
    assert sorted(map(tuple, got.collect())) == [("alone", "NeverPaired", 1), ("pair", "Paired", None), ("tick", "Paired", None)]


def test_changes_stream(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    values = [("k", "1"), ("k", "1"), ("j", None), ("k", "2"), ("k", "2"), ("j", None), ("k", "1"), ("j", "x")]
    rows = [(k, v, t + datetime.timedelta(seconds=i)) for i, (k, v) in enumerate(values)]
    got = drained(S.changes(source(spark, tmp_path, rows, "k string, v string, ts timestamp"), "k", "v"), tmp_path, "changes", "append").collect()
    assert [tuple(r) for r in got if r["k"] == "k"] == [("k", "1"), ("k", "2"), ("k", "1")] and [tuple(r) for r in got if r["k"] == "j"] == [("j", None), ("j", "x")]
