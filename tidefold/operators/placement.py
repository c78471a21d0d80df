"""Placement: affinity predicates, hash rings, winners."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefold.functions.hashing import ring


@dataclass(frozen=True)
class Affinity:
    """A predicate over capability columns: tokens (array) and attrs (map). Missing tokens or attributes do not match, so their negation does."""

    build: object

    def __call__(self, tokens: Column, attrs: Column) -> Column:
        return self.build(tokens, attrs)

    def __and__(self, other):
        return Affinity(lambda t, a: self(t, a) & other(t, a))

    def __or__(self, other):
        return Affinity(lambda t, a: self(t, a) | other(t, a))

    def __invert__(self):
        return Affinity(lambda t, a: ~self(t, a))


def has(token: str) -> Affinity:
    return Affinity(lambda t, a: F.coalesce(F.array_contains(t, token), F.lit(False)))


def attr(key: str, value: str) -> Affinity:
    return Affinity(lambda t, a: F.coalesce(F.try_element_at(a, F.lit(key)).eqNullSafe(F.lit(value)), F.lit(False)))


ANYWHERE = Affinity(lambda t, a: F.lit(True))


def eligible(peers: DataFrame, caps: DataFrame, affinity: Affinity) -> DataFrame:
    """Peers whose capabilities match; a peer without any has empty ones."""
    both = peers.join(caps, "peer", "left")
    return both.filter(affinity(F.coalesce("tokens", F.array().cast("array<string>")), F.coalesce("attrs", F.create_map().cast("map<string,string>")))).select("peer")


def ring_points(peers: DataFrame, vnodes: int = 150) -> DataFrame:
    """position, peer: vnodes points for each peer; a shared position goes to the least peer."""
    each = peers.select("peer", F.explode(F.sequence(F.lit(0), F.lit(vnodes - 1))).alias("v"))
    return each.select("peer", ring(F.concat("peer", F.lit("#"), F.col("v").cast("string"))).alias("position")).groupBy("position").agg(F.min("peer").alias("peer"))


def owners(tasks: DataFrame, points: DataFrame, task: str = "task") -> DataFrame:
    """task, peer: the first point at or after the task's position, wrapping around.

    An as-of join by key ranges: positions are cut into equal arcs, the tasks and points of one arc are put in one order
    and each task takes the last point seen from above; tasks beyond the last point of their arc take the first point of
    the next arc that has one. So the work grows with tasks plus points, and neither side is broadcast: the size of the
    points is not known to the planner, which sees their peers only.
    """
    arcs = 4096
    arc = lambda c: F.floor(F.col(c) / ((1 << 31) // arcs)).cast("int")
    firsts = points.groupBy(arc("position").alias("arc")).agg(F.min(F.struct("position", "peer")).alias("first"))
    # at most arcs rows, so one ordered list of them is small
    table = firsts.agg(F.array_sort(F.collect_list(F.struct("arc", "first"))).alias("ring"))
    asked = tasks.select(task).distinct().select(task, ring(F.col(task)).alias("p"), F.lit(True).alias("__asks"), F.lit(None).cast(points.schema["peer"].dataType).alias("__peer"))
    held = points.select(F.lit(None).cast(tasks.schema[task].dataType).alias(task), F.col("position").alias("p"), F.lit(False).alias("__asks"), F.col("peer").alias("__peer"))
    above = Window.partitionBy("arc").orderBy(F.col("p").desc(), "__asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = asked.unionByName(held).withColumn("arc", arc("p")).withColumn("near", F.last("__peer", ignorenulls=True).over(above)).filter("__asks")
    after = F.filter("ring", lambda x: x["arc"] > F.col("arc"))
    wrap = F.when(F.size(after) > 0, F.get(after, F.lit(0))["first"]["peer"]).otherwise(F.get("ring", F.lit(0))["first"]["peer"])
    return near.join(F.broadcast(table)).select(task, F.coalesce("near", wrap).alias("peer"))


def winners(claims: DataFrame, present: DataFrame, task: str = "task") -> DataFrame:
    """The least claimant of each task that is on the roster."""
    return claims.join(present.select("peer"), "peer", "left_semi").groupBy(task).agg(F.min("peer").alias("peer"))


def last_visible(rows: DataFrame, by: list[str], order: str, n: int, visible: str = "visible") -> DataFrame:
    """The rows from the n-th last visible one on; the leading prefix goes, tombstones included."""
    w = Window.partitionBy(*by).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("__after", F.coalesce(F.sum(F.col(visible).cast("int")).over(w), F.lit(0))).filter(F.col("__after") < n).drop("__after")


def sample_peers(peers: DataFrame, k: int, seed: int) -> DataFrame:
    """A reproducible k-subset."""
    return peers.orderBy(F.md5(F.concat("peer", F.lit(f"|{seed}"))), "peer").limit(k)


def view_size(n: int) -> int:
    """How many peers of n to talk to: enough that the graph of random choices stays connected."""
    return max(4, math.ceil(math.log(n)) + 2) if n > 0 else 4


def partial_view(peers: DataFrame, own: str, spares: int, k: int | None = None) -> DataFrame:
    """peer, role: a peer's 'active' neighbours and then its 'spare' ones, an order of its own over all others."""
    others = peers.filter(F.col("peer") != own)
    active = view_size(peers.count()) if k is None else k
    drawn = others.select("peer", F.md5(F.concat("peer", F.lit(f"|{own}"))).alias("draw")).orderBy("draw", "peer").limit(active + spares)
    ranked = drawn.withColumn("n", F.row_number().over(Window.orderBy("draw", "peer")))  # a few rows
    return ranked.select("peer", F.when(F.col("n") <= active, "active").otherwise("spare").alias("role"))
