"""Causal merges of dotted states, frontiers and gap-free prefixes.

A dot is (replica, seq). A state has facts (state_id, key..., replica, seq, value) and a context: a version vector
(state_id, replica, upto) and out-of-order dots (state_id, replica, seq).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def causal_merge(facts: DataFrame, vv: DataFrame, cloud: DataFrame, keys: list[str]) -> DataFrame:
    """The dots that survive: a dot stays if every state that has seen it still holds it.

    Two steps, both keyed and shuffle-only: holders by dot, and seers by a join on the replica with seq <= upto,
    plus those that saw the dot out of order.
    """
    dots = facts.groupBy("replica", "seq").agg(F.countDistinct("state_id").alias("holders"))
    seen_vv = dots.select("replica", "seq").join(vv.select("state_id", "replica", "upto"), "replica").filter(F.col("seq") <= F.col("upto")).select("replica", "seq", "state_id")
    seen_cloud = dots.select("replica", "seq").join(cloud.select("state_id", "replica", "seq"), ["replica", "seq"]).select("replica", "seq", "state_id")
    seers = seen_vv.unionByName(seen_cloud).unionByName(facts.select("replica", "seq", "state_id")).groupBy("replica", "seq").agg(F.countDistinct("state_id").alias("seers"))
    kept = dots.join(seers, ["replica", "seq"]).filter("holders = seers").select("replica", "seq")
    values = [c for c in facts.columns if c not in ("state_id", "replica", "seq", *keys)]
    first = facts.groupBy(*keys, "replica", "seq").agg(*(F.min(c).alias(c) for c in values)) if values else facts.select(*keys, "replica", "seq").distinct()
    return first.join(kept, ["replica", "seq"], "left_semi")


def or_set(facts: DataFrame, vv: DataFrame, cloud: DataFrame, key: str) -> DataFrame:
    """Add-wins set: keys with a surviving dot."""
    return causal_merge(facts, vv, cloud, [key]).select(key).distinct()


def mv_register(facts: DataFrame, vv: DataFrame, cloud: DataFrame, keys: list[str], value: str) -> DataFrame:
    """All concurrent values of each register, sorted."""
    return causal_merge(facts, vv, cloud, keys).groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias("values"))


def or_map_sum(facts: DataFrame, vv: DataFrame, cloud: DataFrame, key: str) -> DataFrame:
    """Add-wins map of additive values: the surviving contributions of each key, summed."""
    return causal_merge(facts, vv, cloud, [key]).groupBy(key).agg(F.sum("value").alias("value"))


def or_map_lww(facts: DataFrame, vv: DataFrame, cloud: DataFrame, key: str) -> DataFrame:
    """Add-wins map of registers: the surviving contribution with the greatest (ts, origin)."""
    return causal_merge(facts, vv, cloud, [key]).groupBy(key).agg(F.max_by("value", F.struct("ts", "origin")).alias("value"))


def contiguous(dots: DataFrame, floors: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """Per author the end of the longest gap-free run above the floor (0 without one)."""
    by = by or ["replica"]
    rows = dots.select(*by, "seq").distinct()
    if floors is not None:
        rows = rows.join(floors.select(*by, "floor"), by, "left").withColumn("floor", F.coalesce("floor", F.lit(0)))
    else:
        rows = rows.withColumn("floor", F.lit(0))
    rows = rows.filter(F.col("seq") > F.col("floor"))
    no = F.row_number().over(Window.partitionBy(*by).orderBy("seq"))
    return rows.withColumn("no", no).filter(F.col("seq") - F.col("no") == F.col("floor")).groupBy(*by).agg(F.max("seq").alias("upto"))


def compact_context(dots: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """A dot set as version vector and cloud."""
    vv = contiguous(dots, by=by)
    cloud = dots.select(*by, "seq").distinct().join(vv, by, "left").filter(F.col("seq") > F.coalesce("upto", F.lit(0))).drop("upto")
    return vv, cloud


def dominates(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row `dominates`: a's vector is pointwise at least b's."""
    both = b.select("replica", F.col("upto").alias("theirs")).join(a.select("replica", F.col("upto").alias("ours")), "replica", "left")
    return both.agg(F.coalesce(F.bool_and(F.coalesce("ours", F.lit(0)) >= F.col("theirs")), F.lit(True)).alias("dominates"))


def universal_ack(peers: DataFrame, acks: DataFrame) -> DataFrame:
    """The least sequence that all peers acknowledged; a silent peer counts as 0."""
    low = acks.groupBy("peer").agg(F.max("acked").alias("acked"))
    return peers.join(low, "peer", "left").agg(F.min(F.coalesce("acked", F.lit(0))).alias("acked"))
