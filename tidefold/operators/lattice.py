"""Lattice aggregates: state and delta rows share one schema, so a merge is a union and a grouped join (least upper bound).

Each of them is commutative, associative and idempotent, hence order-free, repeatable and split by Spark into a partial
aggregate before and a final one after the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def piece(*states: DataFrame) -> DataFrame:
    """The rows of all states; every aggregate below takes its result."""
    return reduce(DataFrame.unionByName, states)


def per_replica_max(states: DataFrame, keys: list[str], count: str = "count") -> DataFrame:
    return states.groupBy(*keys, "replica").agg(F.max(count).alias(count))


def gcounter(states: DataFrame, keys: list[str], count: str = "count") -> DataFrame:
    """Grow-only counter: the largest count of each replica, summed."""
    return per_replica_max(states, keys, count).groupBy(*keys).agg(F.sum(count).alias("value"))


def pncounter(states: DataFrame, keys: list[str]) -> DataFrame:
    """Counter with increments (sign 1) and decrements (sign -1)."""
    held = states.groupBy(*keys, "replica", "sign").agg(F.max("count").alias("count"))
    return held.groupBy(*keys).agg(F.sum(F.col("sign") * F.col("count")).alias("value"))


def gcounter_double(states: DataFrame, keys: list[str], count: str = "count") -> DataFrame:
    """Counter of doubles, added in the replicas' order so that the sum does not depend on the partitioning."""
    held = per_replica_max(states, keys, count)
    ordered = F.array_sort(F.collect_list(F.struct("replica", F.col(count).alias("c"))))
    return held.groupBy(*keys).agg(ordered.alias("r")).select(*keys, F.aggregate("r", F.lit(0.0), lambda a, x: a + x["c"]).alias("value"))


def bounded_quota(initial: DataFrame, spends: DataFrame, transfers: DataFrame) -> DataFrame:
    """replica, quota = initial + received - given - spent, from per-replica cumulative states.

    initial: replica, amount; spends: replica, amount; transfers: replica (giver), to_replica, amount.
    """
    first = initial.groupBy("replica").agg(F.max("amount").alias("v"))
    spent = spends.groupBy("replica").agg((-F.max("amount")).alias("v"))
    moved = transfers.filter(F.col("replica") != F.col("to_replica")).groupBy("replica", "to_replica").agg(F.max("amount").alias("a"))
    given = moved.select("replica", (-F.col("a")).alias("v"))
    got = moved.select(F.col("to_replica").alias("replica"), F.col("a").alias("v"))
    return piece(first, spent, given, got).groupBy("replica").agg(F.sum("v").alias("quota"))


def within_quota(requests: DataFrame, quota: DataFrame) -> DataFrame:
    """Spend requests with `accepted`: refused when the amount is over the replica's quota."""
    return requests.join(quota, "replica", "left").withColumn("accepted", F.col("amount") <= F.coalesce("quota", F.lit(0)))


def lww(writes: DataFrame, keys: list[str], value: str = "value", ts: str = "ts", origin: str = "origin") -> DataFrame:
    """Last writer wins: the greatest (timestamp, origin). A null value is a tombstone and wins like any other write."""
    top = F.max_by(F.struct(F.col(value).alias("v")), F.struct(ts, origin)).alias("top")
    return writes.groupBy(*keys).agg(top).select(*keys, F.col("top.v").alias(value))


def lww_map(writes: DataFrame, keys: list[str], value: str = "value", ts: str = "ts", origin: str = "origin") -> DataFrame:
    """The live entries: tombstones go only after they have won."""
    return lww(writes, keys, value, ts, origin).filter(F.col(value).isNotNull())


def gauge(writes: DataFrame, keys: list[str]) -> DataFrame:
    """LWW of finite doubles; other values are not taken in."""
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != F.lit(float("inf")))
    return lww(writes.filter(finite), keys)


def gset(*states: DataFrame) -> DataFrame:
    return piece(*states).distinct()


def two_phase_set(added: DataFrame, removed: DataFrame, on: list[str]) -> DataFrame:
    """Added and never removed; a removed element does not come back."""
    return added.select(*on).distinct().join(removed.select(*on).distinct(), on, "left_anti")


def ephemeral(states: DataFrame, keys: list[str]) -> DataFrame:
    """The greatest clock wins; at equal clocks a live value beats a departure (null)."""
    rank = F.struct(F.col("clock"), F.col("value").isNotNull())
    top = states.groupBy(*keys).agg(F.max_by(F.struct("clock", "value"), rank).alias("top"))
    return top.select(*keys, "top.clock", "top.value")


def live(entries: DataFrame, received: DataFrame, keys: list[str], now: int, ttl: int) -> DataFrame:
    """Entries with a value whose local receipt lies less than ttl back; never received is not live."""
    return entries.join(received, keys).filter(F.col("value").isNotNull() & (F.lit(now) - F.col("received") < ttl)).select(*entries.columns)


def vv_ceil(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Pointwise maximum of version vectors given as rows (replica, upto)."""
    return vectors.groupBy(*keys, "replica").agg(F.max("upto").alias("upto")).filter("upto > 0")


def vv_floor(vectors: DataFrame, keys: list[str], peer: str, n_peers: Column | int) -> DataFrame:
    """Pointwise minimum over n_peers; an author that one of them lacks counts as 0 there and drops out."""
    n = F.lit(n_peers) if isinstance(n_peers, int) else n_peers
    low = vectors.filter("upto > 0").groupBy(*keys, "replica").agg(F.min("upto").alias("upto"), F.countDistinct(peer).alias("peers"))
    return low.filter(F.col("peers") == n).drop("peers")


def fedavg(updates: DataFrame) -> DataFrame:
    """Per peer the greatest (epoch, samples, weights); then the sample-weighted mean of each coordinate.

    updates: peer, epoch, samples, weights. Raises when dimensions differ. Gives i, weight.
    """
    held = updates.groupBy("peer").agg(F.max(F.struct("epoch", "samples", "weights")).alias("u")).select("peer", "u.*")
    sized = held.withColumn("dim", F.size("weights"))
    total = sized.agg(F.sum("samples").alias("n"), F.min("dim").alias("low"), F.max("dim").alias("high"))
    total = total.select(F.when(F.col("low") == F.col("high"), F.col("n")).otherwise(F.raise_error(F.lit("weights differ in dimension")).cast("long")).alias("n"))
    each = sized.select("samples", F.posexplode("weights").alias("i", "w"))
    summed = each.groupBy("i").agg(F.sum((F.col("w").cast("double") * F.col("samples"))).alias("s"))
    return summed.join(F.broadcast(total)).select("i", (F.col("s") / F.col("n")).alias("weight"))  # the total is one row


def gradient_step(rows: DataFrame, x: str, y: str, w: float, b: float, rate: float) -> DataFrame:
    """One linear-regression step: the new weight and bias."""
    err = F.lit(w) * F.col(x) + F.lit(b) - F.col(y)
    sums = rows.agg(F.sum(err * F.col(x)).alias("gx"), F.sum(err).alias("g"), F.count(F.lit(1)).alias("n"))
    return sums.select((F.lit(w) - rate * F.col("gx") / F.col("n")).alias("w"), (F.lit(b) - rate * F.col("g") / F.col("n")).alias("b"))


def apply_once(commands: DataFrame) -> DataFrame:
    """Commands with `applied`: a request id over the running maximum of its client, in the log's order; a null client always applies."""
    before = Window.partitionBy("client").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.col("client").isNull() | (F.col("request_id") > F.coalesce(F.max("request_id").over(before), F.lit(-(1 << 62))))
    return commands.withColumn("applied", fresh)


def furthest(states: DataFrame, keys: list[str], progress: list[str], value: str) -> DataFrame:
    """GSet union in which the furthest progress wins, ties by the value's order."""
    return states.groupBy(*keys).agg(F.max(F.struct(*progress, value)).alias("top")).select(*keys, "top.*")
