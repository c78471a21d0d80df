"""Append-only archives of frames: (offset, end_offset, arrived_at, insert_dots, ops), and a registry of named sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class SourceRegistry:
    """Symbolic source names; a name is registered once."""

    def __init__(self):
        self._open: dict[str, Callable[[SparkSession], DataFrame]] = {}

    def register(self, name: str, opener: Callable[[SparkSession], DataFrame]) -> None:
        if name in self._open:
            raise ValueError(f"source {name} is registered already")
        self._open[name] = opener

    def open(self, spark: SparkSession, name: str) -> DataFrame:
        return self._open[name](spark)


def append(frames: DataFrame, path: str) -> None:
    """Add frames to the archive; files are sorted by offset, so that their statistics prune replays."""
    frames.sortWithinPartitions("offset").write.mode("append").parquet(path)


def replay(frames: DataFrame) -> DataFrame:
    return frames.orderBy("offset")


def replay_from(frames: DataFrame, offset: int) -> DataFrame:
    """What ends after the cursor."""
    return frames.filter(F.col("end_offset") > offset)


def replay_arrived(frames: DataFrame, since, until) -> DataFrame:
    """Arrival in [since, until)."""
    return frames.filter((F.col("arrived_at") >= since) & (F.col("arrived_at") < until))


def replay_above(frames: DataFrame, floor: DataFrame) -> DataFrame:
    """Frames with an insert dot above the version vector; an author without an entry has floor 0."""
    dots = frames.select("offset", F.explode("insert_dots").alias("d")).select("offset", "d.replica", "d.seq")
    above = dots.join(floor, "replica", "left").filter(F.col("seq") > F.coalesce("upto", F.lit(0))).select("offset")
    return frames.join(above, "offset", "left_semi")


def verdict(frames: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per archive the end of the clean part and where the first gap starts (null: a clean tail)."""
    by = by or []
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("offset")
    rows = frames.withColumn("prev_end", F.lag("end_offset").over(w))
    gap = F.col("prev_end").isNotNull() & (F.col("offset") != F.col("prev_end"))
    return rows.groupBy(*by).agg(F.min(F.when(gap, F.col("prev_end"))).alias("gap_from"), F.max("end_offset").alias("last_end"), F.count(F.when(gap, 1)).alias("gaps"))


def publish(incoming: DataFrame, archived: DataFrame, on: list[str]) -> DataFrame:
    """Each op once: neither twice in the batch nor again after it is in the archive."""
    return incoming.dropDuplicates(on).join(archived.select(*on), on, "left_anti")


def state_digest(rows: DataFrame, *columns: str) -> DataFrame:
    """An order-insensitive root of a relation; maps are put in canonical order first."""
    def canon(name: str):
        kind = dict(rows.dtypes)[name]
        return F.to_json(F.array_sort(F.map_entries(name))) if kind.startswith("map") else F.coalesce(F.col(name).cast("string"), F.lit("\0"))

    h = F.conv(F.substring(F.md5(F.concat_ws("\x1f", *map(canon, columns))), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("root"), F.count(F.lit(1)).alias("n"))
