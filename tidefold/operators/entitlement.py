"""Actions on a fair-share ledger - delegate, release, transfer, retire - judged as one batch, and the bounds of its fairness.

Relations are those of the ledger module. An action is judged against the ledger as it is given, so one call admits one
action a pocket (a group and a replica): the first by id that is in form; the others are to be put again ('later').
Accepted actions become absolute counter and transfer rows, which merge by their maximum like all others.
"""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefold.operators.ledger import checked, edge_totals, holdings, lifecycles, lineage, slots

_LIVE = ("ACTIVE", "CLOSED")


def inbound(edges: DataFrame) -> DataFrame:
    """grp, live, edge, parent: for each group under an edge the number of its live inbound edges, and the one if it is alone."""
    each = edges.select("edge", "parent", "child").distinct().join(lifecycles(edges), "edge").withColumn("is_live", F.col("lifecycle").isin(*_LIVE))
    alone = F.max(F.when(F.col("is_live"), F.struct("edge", "parent")))
    counted = each.groupBy(F.col("child").alias("grp")).agg(F.count_if("is_live").alias("live"), alone.alias("one"))
    one = F.when(F.col("live") == 1, F.col("one"))
    return counted.select("grp", "live", one["edge"].alias("edge"), one["parent"].alias("parent"))


def quarantined(edges: DataFrame) -> DataFrame:
    """grp: the groups with no single live way up to the root."""
    ways = inbound(edges)
    broken = ways.filter("live <> 1").select("grp")
    clear = ways.filter("live = 1").select("edge", "parent", F.col("grp").alias("child"))
    above = lineage(clear).select("grp", "edge").join(clear.select("edge", F.col("parent").alias("up")), "edge")
    return broken.unionByName(above.join(broken.select(F.col("grp").alias("up")), "up", "left_semi").select("grp")).distinct()


def judged(actions: DataFrame, minted: DataFrame, edges: DataFrame, counters: DataFrame, transfers: DataFrame, root: str | None = None) -> DataFrame:
    """The actions (id, kind, replica, place, receiver, amount) with grp, path and reason, null where they are accepted.

    place is the edge of a delegate or release and the group of a transfer. Refused are: amounts under 1 and transfers to oneself
    ('malformed'), unknown edges, delegations down an edge that is not ACTIVE, releases up another than the child's one live edge,
    anything where a lineage is contested, and amounts beyond the pocket's holdings ('insufficient').
    """
    ends = edges.select(F.col("edge").alias("place"), "parent", "child").distinct().join(lifecycles(edges).withColumnRenamed("edge", "place"), "place")
    ways = inbound(edges)
    at = actions.join(ends, "place", "left")
    delegate, release = F.col("kind") == "delegate", F.col("kind") == "release"
    at = at.withColumn("grp", F.when(delegate, F.col("parent")).when(release, F.col("child")).otherwise(F.col("place")))
    at = at.join(ways.select("grp", F.col("edge").alias("way")), "grp", "left")
    shut = quarantined(edges)
    at = at.join(shut.select("grp", F.lit(True).alias("shut")), "grp", "left").join(shut.select(F.col("grp").alias("child"), F.lit(True).alias("child_shut")), "child", "left")
    form = (
        F.when((F.col("amount") < 1) | ((F.col("kind") == "transfer") & F.col("receiver").eqNullSafe(F.col("replica"))), "malformed")
        .when((delegate | release) & F.col("parent").isNull(), "unknown edge").when(delegate & (F.col("lifecycle") != "ACTIVE"), "not active")
        .when(F.col("shut") | (delegate & F.col("child_shut")), "contested lineage").when(release & ~F.col("way").eqNullSafe(F.col("place")), "not the live edge")
    )
    held = holdings(minted, edges, counters, transfers, root)
    at = at.withColumn("form", form).join(held, ["grp", "replica"], "left")
    turn = F.row_number().over(Window.partitionBy("grp", "replica", F.col("form").isNull()).orderBy("id"))
    reason = F.when(F.col("form").isNotNull(), F.col("form")).when(turn > 1, "later").when(F.col("amount") > F.coalesce("held", F.lit(0)), "insufficient")
    return at.withColumn("reason", reason).select("id", "kind", "replica", "place", "receiver", "amount", "grp", F.coalesce("way", F.lit("")).alias("path"), "reason")


def counter_patch(decided: DataFrame, counters: DataFrame) -> DataFrame:
    """edge, replica, kind, amount: the slots that accepted delegations and releases raise, at their new values."""
    more = decided.filter("reason is null and kind in ('delegate', 'release')").select(F.col("place").alias("edge"), "replica", F.when(F.col("kind") == "delegate", "issued").otherwise("returned").alias("kind"), F.col("amount").alias("more"))
    return more.groupBy("edge", "replica", "kind").agg(F.sum("more").alias("more")).join(slots(counters), ["edge", "replica", "kind"], "left").select("edge", "replica", "kind", (F.coalesce("amount", F.lit(0)) + F.col("more")).alias("amount"))


def transfer_patch(decided: DataFrame, transfers: DataFrame) -> DataFrame:
    """path, sender, receiver, amount: the rows that accepted transfers raise, at their new values."""
    now = transfers.groupBy("path", "sender", "receiver").agg(F.max("amount").alias("now"))
    more = decided.filter("reason is null and kind = 'transfer'").select("path", F.col("replica").alias("sender"), "receiver", F.col("amount").alias("more"))
    return more.join(now, ["path", "sender", "receiver"], "left").select("path", "sender", "receiver", (F.coalesce("now", F.lit(0)) + F.col("more")).alias("amount"))


def retirement(wanted: DataFrame, edges: DataFrame, counters: DataFrame) -> DataFrame:
    """edge, reason: an edge retires (null) if it is closing and all that went down has come back or was spent."""
    left = edge_totals(counters).select("edge", (F.col("issued") - F.col("returned") - F.col("leaf") - F.col("rollup")).alias("left"))
    at = wanted.select("edge").distinct().join(lifecycles(edges), "edge", "left").join(left, "edge", "left")
    return at.select("edge", F.when(F.col("lifecycle").isNull(), "unknown edge").when(F.col("lifecycle") != "CLOSED", "not closing").when(F.coalesce("left", F.lit(0)) != 0, "outstanding").alias("reason"))


def gauged_service(edges: DataFrame, counters: DataFrame, gauges: DataFrame) -> DataFrame:
    """edge, num, den: floor + (issued - folded) / weight - returned / weight, reduced. gauges: edge, floor_num, floor_den, folded.

    An edge's gauges merge to the greatest floor and the greatest fold, each by itself; without one both are 0. Only base
    slots count, not relocated ones.
    """
    base = slots(counters).filter("kind in ('issued', 'returned')").groupBy("edge").agg(*(F.sum(F.when(F.col("kind") == k, F.col("amount"))).alias(k) for k in ("issued", "returned")))
    joined = gauges.groupBy("edge").agg(F.collect_set(F.concat_ws("/", "floor_num", "floor_den")).alias("floors"), F.max("folded").alias("folded"))
    every = edges.select("edge", "weight_num", "weight_den").distinct().join(base, "edge", "left").join(joined, "edge", "left").fillna(0, ["issued", "returned", "folded"])
    every = every.withColumn("floors", F.coalesce("floors", F.array(F.lit("0"))))

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                x = checked(max(map(Fraction, r.floors)) + Fraction(int(r.issued) - int(r.folded) - int(r.returned)) * int(r.weight_den) / int(r.weight_num))
                out.append((r.edge, x.numerator, x.denominator))
            yield pd.DataFrame(out, columns=["edge", "num", "den"])

    return every.mapInPandas(run, "edge string, num long, den long")


def bound_metrics(edges: DataFrame, counters: DataFrame, held: DataFrame, roster: DataFrame, demanding: DataFrame, most: int, quantum: int) -> DataFrame:
    """parent, worst, bound, deviation: the three pieces of the temporary fairness error at each parent.

    worst is n * most + quantum for a roster (replica) of n; bound is what the roster holds at the parent now, plus the quantum, at most
    worst; deviation is the largest gap between a demanding active child's service and its share by weight, rounded up. held: holdings().
    """
    n = max(1, roster.select("replica").distinct().count())
    worst = n * most + quantum
    steer = held.join(roster.select("replica").distinct(), "replica", "left_semi").groupBy(F.col("grp").alias("parent")).agg(F.sum(F.greatest("held", F.lit(0))).alias("steer"))
    total = edge_totals(counters).select("edge", (F.col("issued") - F.col("returned")).alias("service"))
    child = edges.select("edge", "parent", "weight_num", "weight_den").distinct().join(lifecycles(edges).filter("lifecycle = 'ACTIVE'"), "edge", "left_semi")
    child = child.join(demanding.select("edge").distinct(), "edge", "left_semi").join(total, "edge", "left").fillna(0, ["service"])

    def partly(batches):
        for pdf in batches:
            parts: dict = {}
            for r in pdf.itertuples(index=False):
                w, v = parts.get(r.parent, (Fraction(0), 0))
                parts[r.parent] = w + Fraction(int(r.weight_num), int(r.weight_den)), v + int(r.service)
            yield pd.DataFrame([(p, str(w), v) for p, (w, v) in parts.items()], columns=["parent", "w", "v"])

    def wholly(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(pdf["parent"].iloc[0], str(sum(map(Fraction, pdf["w"]))), int(pdf["v"].sum()))], columns=["parent", "w", "v"])

    def gaps(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                share = Fraction(int(r.weight_num), int(r.weight_den)) / Fraction(r.w) * int(r.v)
                out.append((r.parent, -(-abs(share - int(r.service)) // 1)))
            yield pd.DataFrame(out, columns=["parent", "gap"])

    # exact fractions are summed for each batch first, so no task sees all children of a parent
    sums = child.mapInPandas(partly, "parent string, w string, v long").groupBy("parent").applyInPandas(wholly, "parent string, w string, v long")
    most_apart = child.join(sums, "parent").mapInPandas(gaps, "parent string, gap long").groupBy("parent").agg(F.max("gap").alias("gap"))
    every = edges.select("parent").distinct().join(steer, "parent", "left").join(most_apart, "parent", "left")
    bound: Column = F.least(F.lit(worst), F.coalesce("steer", F.lit(0)) + quantum)
    return every.select("parent", F.lit(worst).cast("long").alias("worst"), bound.cast("long").alias("bound"), F.coalesce("gap", F.lit(0)).cast("long").alias("deviation"))
