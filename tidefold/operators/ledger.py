"""Fair-share entitlement ledgers: credit, holdings, virtual service, conflicts, and the earliest-eligible-deadline scheduler.

Relations: minted(id, holder, amount); edges(edge, parent, child, weight_num, weight_den, lifecycle);
counters(edge, replica, kind, amount) with kind in issued, returned, leaf, rollup, and for what a relocation moved
issued_in, leaf_in, leaf_out, rollup_in, rollup_out - each slot merges by its maximum;
transfers(path, sender, receiver, amount), path '' at the root, else the inbound edge.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.sources.staging import staged

LIFECYCLE = ("PREPARED", "ACTIVE", "CLOSED", "RETIRED")
_LONG = (1 << 63) - 1


def checked(x: Fraction) -> Fraction:
    """An exact rational whose reduced parts fit 64 bits; more is an error, never a rounding."""
    if abs(x.numerator) > _LONG or x.denominator > _LONG:
        raise OverflowError(f"{x} leaves 64-bit rationals")
    return x


def mints(minted: DataFrame) -> DataFrame:
    """One record for each id: the greatest."""
    return minted.groupBy("id").agg(F.max(F.struct("holder", "amount")).alias("m")).select("id", "m.*")


def slots(counters: DataFrame) -> DataFrame:
    return counters.groupBy("edge", "replica", "kind").agg(F.max("amount").alias("amount"))


def effective(counters: DataFrame) -> DataFrame:
    """The slots with relocated amounts counted where they went: kind in issued, returned, leaf, rollup."""
    sign = F.when(F.col("kind").endswith("_out"), -F.col("amount")).otherwise(F.col("amount"))
    return slots(counters).groupBy("edge", "replica", F.substring_index("kind", "_", 1).alias("kind")).agg(F.sum(sign).alias("amount"))


def lifecycles(marks: DataFrame) -> DataFrame:
    """A max-register over PREPARED < ACTIVE < CLOSED < RETIRED."""
    rank = F.array_position(F.array(*map(F.lit, LIFECYCLE)), F.col("lifecycle"))
    return marks.groupBy("edge").agg(F.max_by("lifecycle", rank).alias("lifecycle"))


def holdings(minted: DataFrame, edges: DataFrame, counters: DataFrame, transfers: DataFrame, root: str | None = None) -> DataFrame:
    """grp, replica, held: credit in, plus transfers, less what went to children and leaf spending.

    Mints are credited to the root: the one group without an inbound edge unless given. Several such groups are an error.
    """
    slot = effective(counters)
    net = slot.filter("kind in ('issued', 'returned')").groupBy("edge", "replica").agg(F.sum(F.when(F.col("kind") == "issued", F.col("amount")).otherwise(-F.col("amount"))).alias("net"))
    ends = edges.select("edge", "parent", "child").distinct()
    if root is None:
        tops = ends.select(F.col("parent").alias("grp")).distinct().join(ends.select(F.col("child").alias("grp")).distinct(), "grp", "left_anti")
        tops = [r["grp"] for r in tops.limit(2).collect()]
        if len(tops) > 1:
            raise ValueError(f"several roots, among them {tops}: name the ledger's")
        root = tops[0] if tops else None
    roots = ends.sparkSession.createDataFrame([(root,)] if root is not None else [], "grp string")
    credit = mints(minted).crossJoin(F.broadcast(roots)).select("grp", F.col("holder").alias("replica"), F.col("amount").alias("v"))  # one root a ledger
    inflow = net.join(ends, "edge").select(F.col("child").alias("grp"), "replica", F.col("net").alias("v"))
    outflow = net.join(ends, "edge").select(F.col("parent").alias("grp"), "replica", (-F.col("net")).alias("v"))
    leaf = slot.filter("kind = 'leaf'").join(ends, "edge").select(F.col("child").alias("grp"), "replica", (-F.col("amount")).alias("v"))
    moved = transfers.groupBy("path", "sender", "receiver").agg(F.max("amount").alias("amount"))
    place = ends.select(F.col("edge").alias("path"), F.col("child").alias("grp")).unionByName(roots.select(F.lit("").alias("path"), "grp"))
    at = moved.join(place, "path")
    got = at.select("grp", F.col("receiver").alias("replica"), F.col("amount").alias("v"))
    given = at.select("grp", F.col("sender").alias("replica"), (-F.col("amount")).alias("v"))
    every = credit.unionByName(inflow).unionByName(outflow).unionByName(leaf).unionByName(got).unionByName(given)
    return every.groupBy("grp", "replica").agg(F.sum("v").alias("held"))


def lineage(edges: DataFrame) -> DataFrame:
    """grp, edge, level: every edge on the way up from a group to the root, however deep; a cycle is an error.

    Doubling joins: after step i the paths of up to 2**i edges are known, so depth d takes log d steps. Each step is
    written to the shared folder, and the walk ends when a step adds nothing. A path longer than there are edges goes round.
    """
    up = edges.select(F.col("child").alias("grp"), "edge", F.col("parent").alias("next")).distinct()
    out = staged(up.withColumn("level", F.lit(0).cast("long")), "lineage")
    jump, width, most = staged(up.select("grp", "next").distinct(), "lineage-jump"), 1, edges.select("edge").distinct().count()
    while not jump.isEmpty():
        if width > most:
            raise ValueError("the edges close a cycle")
        far = jump.select(F.col("grp").alias("mid"), F.col("next").alias("start"))
        more = far.join(out, far["start"] == out["grp"]).select(F.col("mid").alias("grp"), "edge", "next", (F.col("level") + width).alias("level"))
        hop = jump.select(F.col("grp").alias("g2"), F.col("next").alias("n2"))
        out = staged(out.unionByName(more), "lineage")
        jump = staged(jump.join(hop, jump["next"] == hop["g2"]).select("grp", F.col("n2").alias("next")).distinct(), "lineage-jump")
        width *= 2
    return out.select("grp", "edge", "level")


def spend_rollup(spends: DataFrame, edges: DataFrame) -> DataFrame:
    """edge, replica, kind, amount: each spend charges its leaf edge and rolls up to all edges above."""
    return spends.join(lineage(edges), "grp").select("edge", "replica", F.when(F.col("level") == 0, "leaf").otherwise("rollup").alias("kind"), "amount").groupBy("edge", "replica", "kind").agg(F.sum("amount").alias("amount"))


def edge_totals(counters: DataFrame) -> DataFrame:
    kinds = ("issued", "returned", "leaf", "rollup")
    return effective(counters).groupBy("edge").agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("amount"))), F.lit(0)).alias(k) for k in kinds))


def gcd(a: Column, b: Column) -> Column:
    """The greatest common divisor of two longs by Euclid's steps, of which there are at most five a digit of the smaller number, and one to swap."""
    start = F.struct(F.abs(a).alias("a"), F.abs(b).alias("b"))
    step = lambda x, _: F.when(x["b"] == 0, x).otherwise(F.struct(x["b"].alias("a"), (x["a"] % F.when(x["b"] == 0, F.lit(1).cast("long")).otherwise(x["b"])).alias("b")))
    most = F.length(F.least(F.abs(a), F.abs(b)).cast("string")) * 5 + 1
    return F.aggregate(F.sequence(F.lit(1), most), start, step, lambda x: x["a"])


def virtual_service(edges: DataFrame, counters: DataFrame) -> DataFrame:
    """edge, num, den: (issued - returned) / weight as a reduced fraction. Parts beyond 64 bits are an error."""
    net = edges.join(edge_totals(counters), "edge", "left").select("edge", (F.coalesce("issued", F.lit(0)) - F.coalesce("returned", F.lit(0))).cast("long").alias("n"), F.col("weight_num").cast("long").alias("w"), F.col("weight_den").cast("long").alias("d"))
    # reduced across before the product, so that only a result too large can overflow
    div = lambda x, y: F.expr(f"{x} div {y}")
    parts = net.select("edge", "n", "w", "d", gcd(F.col("n"), F.col("w")).alias("a")).select("edge", div("n", "a").alias("n"), div("w", "a").alias("w"), "d")
    parts = parts.select("edge", "n", "w", "d", gcd(F.col("d"), F.col("w")).alias("b")).select("edge", "n", div("w", "b").alias("w"), div("d", "b").alias("d"))
    num = F.col("n").cast("decimal(38,0)") * F.col("d").cast("decimal(20,0)")
    fits = F.when(F.abs(num) > _LONG, F.raise_error("a virtual service leaves 64-bit rationals").cast("long")).otherwise(num.cast("long"))
    return parts.select("edge", fits.alias("num"), F.col("w").alias("den"))


def _fenced(finals: DataFrame, counters: DataFrame) -> DataFrame:
    """finals with the standing relocations of each slot, n (net inflow), lsp and rsp (effective spending), and why a slot cannot move."""
    standing = ("returned", "issued_in", "leaf_in", "leaf_out", "rollup_in", "rollup_out")
    now = slots(counters).groupBy("edge", "replica").agg(*(F.max(F.when(F.col("kind") == k, F.col("amount"))).alias(f"now_{k}") for k in standing))
    both = finals.join(now, ["edge", "replica"], "left").fillna(0, [f"now_{k}" for k in standing])
    each = both.withColumns({
        "iss": F.col("issued") + F.col("now_issued_in"), "lsp": F.col("leaf") + F.col("now_leaf_in") - F.col("now_leaf_out"), "rsp": F.col("rollup") + F.col("now_rollup_in") - F.col("now_rollup_out"),
    }).withColumn("n", F.col("iss") - F.greatest("returned", "now_returned"))
    return each.withColumn("bad", F.when((F.col("lsp") < 0) | (F.col("rsp") < 0), "negative spend").when(F.col("n") < 0, "net negative")).withColumn("moves", (F.col("n") != 0) | (F.col("lsp") + F.col("rsp") != 0))


def relocation_outcomes(finals: DataFrame, counters: DataFrame, transfers: DataFrame) -> DataFrame:
    """live, outcome, reason: moved, nothing or refused for each live edge. finals: live, edge, replica, issued, returned, leaf, rollup.

    A move is refused as a whole when a slot spends or nets below zero, when a fenced edge carries transfers, or when
    a replica's fenced edges together do not cover what it spent through them. Replicas without finals stay as they are.
    """
    slot = _fenced(finals, counters)
    tangled = finals.select("live", F.col("edge").alias("path")).distinct().join(transfers.select("path").distinct(), "path", "left_semi").groupBy("live").agg(F.lit(True).alias("tangled"))
    move = F.col("moves")
    by_replica = slot.groupBy("live", "replica").agg(
        F.min_by("bad", F.when(F.col("bad").isNotNull(), F.struct("edge", "replica"))).alias("bad"), F.min(F.when(F.col("bad").isNotNull(), F.struct("edge", "replica"))).alias("bad_at"), F.max("moves").alias("moves"),
        (F.coalesce(F.sum(F.when(move, F.col("n"))), F.lit(0)) < F.coalesce(F.sum(F.when(move, F.col("lsp") + F.col("rsp"))), F.lit(0))).alias("uncovered"),
    )
    whole = by_replica.groupBy("live").agg(F.min_by("bad", "bad_at").alias("bad"), F.max("moves").alias("moves"), F.max("uncovered").alias("uncovered")).join(tangled, "live", "left")
    reason = F.when(F.col("bad").isNotNull(), F.col("bad")).when(~F.col("moves"), None).when(F.col("tangled"), "transfers").when(F.col("uncovered"), "uncovered")
    return whole.select("live", F.when(reason.isNotNull(), "refused").when(F.col("moves"), "moved").otherwise("nothing").alias("outcome"), reason.alias("reason"))


def relocation_patch(finals: DataFrame, counters: DataFrame, transfers: DataFrame) -> DataFrame:
    """Counter rows that drain the fenced edges of every move that is not refused and credit its live edge. Merge by piece."""
    allowed = relocation_outcomes(finals, counters, transfers).filter("outcome = 'moved'").select("live")
    slot = _fenced(finals, counters).filter("moves").join(allowed, "live", "left_semi")
    drained = {
        "returned": F.col("iss"), "issued": F.col("issued"), "leaf": F.col("leaf"), "rollup": F.col("rollup"), "issued_in": F.col("now_issued_in"), "leaf_in": F.col("now_leaf_in"), "rollup_in": F.col("now_rollup_in"),
        "leaf_out": F.col("now_leaf_out") + F.col("lsp"), "rollup_out": F.col("now_rollup_out") + F.col("rsp"),
    }
    rows = lambda cols: F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.cast("long").alias("amount")) for k, v in cols.items()))).alias("x")
    out = slot.select("edge", "replica", rows(drained))
    credit = slot.groupBy(F.col("live").alias("edge"), "replica").agg(F.sum("n").alias("issued_in"), F.sum("lsp").alias("leaf_in"), F.sum("rsp").alias("rollup_in"))
    credit = credit.select("edge", "replica", rows({k: F.col(k) for k in ("issued_in", "leaf_in", "rollup_in")})).select("edge", "replica", "x.*")
    now = slots(counters).withColumnRenamed("amount", "now")
    credit = credit.join(now, ["edge", "replica", "kind"], "left").select("edge", "replica", "kind", (F.col("amount") + F.coalesce("now", F.lit(0))).alias("amount"))
    return out.select("edge", "replica", "x.*").unionByName(credit)


def validate(minted: DataFrame, edges: DataFrame, counters: DataFrame, transfers: DataFrame) -> DataFrame:
    """kind, subject of each conflict, sorted."""
    total = edge_totals(counters)
    named = lambda df, kind, subject: df.select(F.lit(kind).alias("kind"), subject.cast("string").alias("subject"))
    state = lifecycles(edges)
    ends = edges.select("edge", "parent", "child").distinct()
    held = holdings(minted, edges, counters, transfers)
    out = [
        named(total.filter("leaf + rollup + returned > issued"), "PerEdgeSafety", F.col("edge")),
        named(total.filter("leaf < 0 or rollup < 0"), "NegativeEffectiveSpend", F.col("edge")),
        named(total.join(state, "edge").filter("lifecycle = 'RETIRED' and issued - returned - leaf - rollup <> 0"), "ClosureViolation", F.col("edge")),
        named(edges.select("edge", "parent", "child", "weight_num", "weight_den").distinct().groupBy("edge").count().filter("count > 1"), "RecordDivergence", F.col("edge")),
        named(ends.join(state.filter("lifecycle = 'ACTIVE'"), "edge").groupBy("child").agg(F.countDistinct("edge").alias("n")).filter("n >= 2"), "DualActiveInbound", F.col("child")),
        named(held.filter("held < 0"), "PersistentNegativeHoldings", F.concat_ws("/", "grp", "replica")),
        named(transfers.filter("path <> ''").select("path").distinct().join(ends.select(F.col("edge").alias("path")), "path", "left_anti"), "OrphanedTransferPath", F.col("path")),
    ]
    spent = effective(counters).filter("kind = 'leaf'").agg(F.coalesce(F.sum("amount"), F.lit(0)).alias("spent"))
    supply = mints(minted).agg(F.coalesce(F.sum("amount"), F.lit(0)).alias("supply"))
    out.append(named(spent.crossJoin(supply).filter("spent > supply"), "ConservationViolation", F.lit("*")))  # one row each
    every = out[0]
    for df in out[1:]:
        every = every.unionByName(df)
    return every.orderBy("kind", "subject")


@dataclass
class Edge:
    """A child as the scheduler sees it."""

    id: str
    weight: Fraction
    service: Fraction
    outstanding: int
    target: int
    most: int


def quantum_for(e: Edge, quantum: int, cap: int | None, held: int) -> int:
    need = e.target - e.outstanding
    if need <= 0:
        return 0
    return min([quantum, need, e.most, held] + ([] if cap is None else [cap - e.outstanding]))


def mean_service(edges: list[Edge]) -> Fraction:
    return checked(sum((e.weight * e.service for e in edges), Fraction(0)) / sum((e.weight for e in edges), Fraction(0)))


def front(edges: list[Edge]) -> Fraction | None:
    """The parent's virtual time: the weighted mean of the demanding children, or the greatest of all when none demands."""
    if not edges:
        return None
    demanding = [e for e in edges if e.target > e.outstanding]
    return mean_service(demanding) if demanding else max(e.service for e in edges)


def pick(edges: list[Edge], quantum: int, cap: int | None, held: int) -> tuple[str, int] | None:
    """Of the children that can take a grant and are not ahead of the mean, the earliest deadline; ties by id."""
    if held == 0:
        return None
    able = [(e, q) for e in edges if (q := quantum_for(e, quantum, cap, held)) > 0]
    if not able:
        return None
    mean = mean_service([e for e, _ in able])
    e, q = min(((e, q) for e, q in able if e.service <= mean), key=lambda x: (checked(x[0].service + x[1] / x[0].weight), x[0].id))
    return e.id, q


def schedule(children: DataFrame, quantum: int, cap: int | None = None) -> DataFrame:
    """parent, step, edge, amount: picks repeated until nothing applies. Sequential for each parent, parallel over parents.

    children: parent, edge, weight_num, weight_den, service (long), outstanding, target, most, held (the parent's).
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        edges = {r.edge: Edge(r.edge, Fraction(int(r.weight_num), int(r.weight_den)), Fraction(int(r.service)) * int(r.weight_den) / int(r.weight_num), int(r.outstanding), int(r.target), int(r.most)) for r in pdf.itertuples(index=False)}
        held, out = int(pdf["held"].iloc[0]), []
        while (grant := pick(list(edges.values()), quantum, cap, held)) is not None:
            name, amount = grant
            e = edges[name]
            e.outstanding += amount
            e.service = checked(e.service + amount / e.weight)
            held -= amount
            out.append((pdf["parent"].iloc[0], len(out), name, amount))
        return pd.DataFrame(out, columns=["parent", "step", "edge", "amount"])

    return children.groupBy("parent").applyInPandas(run, "parent string, step long, edge string, amount long")


def _joiners(pdf: pd.DataFrame) -> list[tuple[object, Edge, Fraction, bool, bool]]:
    """parent, edge (service with its offset), raw service, whether unseated, whether it wakes."""
    out = []
    for r in pdf.itertuples(index=False):
        weight = Fraction(int(r.weight_num), int(r.weight_den))
        raw, demanding = Fraction(int(r.issued)) / weight, r.target > r.outstanding
        e = Edge(r.edge, weight, raw + Fraction(int(r.offset_num), int(r.offset_den)), int(r.outstanding), int(r.target), 0)
        out.append((r.parent, e, raw, not r.seated, bool(demanding and r.was_demanding is not None and not pd.isna(r.was_demanding) and not r.was_demanding)))
    return out


def fronts(children: DataFrame) -> DataFrame:
    """parent, num, den: the virtual time of each parent's children that are not joining; no row where all are.

    Exact fractions are summed for each batch first, so no task sees all children of a parent.
    """

    def partly(batches):
        for pdf in batches:
            parts: dict = {}
            for parent, e, _, fresh, wakes in _joiners(pdf):
                if not fresh and not wakes:
                    v, w, top = parts.get(parent, (Fraction(0), Fraction(0), e.service))
                    v, w = (v + e.weight * e.service, w + e.weight) if e.target > e.outstanding else (v, w)
                    parts[parent] = v, w, max(top, e.service)
            yield pd.DataFrame([(p, *map(str, x)) for p, x in parts.items()], columns=["parent", "v", "w", "top"])

    def wholly(pdf: pd.DataFrame) -> pd.DataFrame:
        v, w, top = (list(map(Fraction, pdf[c])) for c in ("v", "w", "top"))
        at = checked(sum(v) / sum(w) if sum(w) else max(top))
        return pd.DataFrame([(pdf["parent"].iloc[0], at.numerator, at.denominator)], columns=["parent", "num", "den"])

    kind = children.schema["parent"].dataType.simpleString()
    return children.mapInPandas(partly, f"parent {kind}, v string, w string, top string").groupBy("parent").applyInPandas(wholly, f"parent {kind}, num long, den long")


def settle_joiners(children: DataFrame, sleeper_credit: int = 0) -> DataFrame:
    """parent, edge, seat_num, seat_den, offset_num, offset_den: seats of newborn children, and offsets after waking ones are clamped.

    children: parent, edge, weight_num, weight_den, issued, outstanding, target, seated, was_demanding (null: not seen before),
    offset_num, offset_den. A newborn is seated at the front, or where its own service puts it if that is further (the origin
    without a front); a waking child's offset lifts it to the front, less the credit that sleepers keep, and never falls.
    """
    at = fronts(children).select(F.col("parent").alias("of"), F.col("num").alias("front_num"), F.col("den").alias("front_den"))
    kinds = {f.name: f.dataType.simpleString() for f in children.schema.fields}

    def run(batches):
        for pdf in batches:
            out = []
            for (parent, e, raw, fresh, wakes), num, den in zip(_joiners(pdf), pdf["front_num"], pdf["front_den"]):
                front_at = None if num is None else Fraction(int(num), int(den))
                seat = checked(max(front_at or Fraction(0), raw)) if fresh else None
                offset = e.service - raw
                if wakes and front_at is not None:
                    offset = checked(max(offset, front_at - raw - sleeper_credit / e.weight))
                out.append((parent, e.id, None if seat is None else seat.numerator, None if seat is None else seat.denominator, offset.numerator, offset.denominator))
            made = pd.DataFrame(out, columns=["parent", "edge", "seat_num", "seat_den", "offset_num", "offset_den"])
            yield made.astype({"seat_num": "Int64", "seat_den": "Int64"})

    joined = children.join(at, children["parent"] == at["of"], "left").withColumns({c: F.col(c).cast("string") for c in ("front_num", "front_den")})
    return joined.mapInPandas(run, f"parent {kinds['parent']}, edge {kinds['edge']}, seat_num long, seat_den long, offset_num long, offset_den long")


def demand_fold(boards: DataFrame) -> DataFrame:
    """Pointwise maximum of the live demand boards."""
    return boards.groupBy("edge").agg(F.max("target").alias("target"), F.max("most").alias("most"))


def enrolled_at(transitions: DataFrame, index: int) -> DataFrame:
    """Members as of a log index: the last transition decides."""
    return transitions.filter(F.col("idx") <= index).groupBy("member").agg(F.max_by("enrolled", "idx").alias("enrolled")).filter("enrolled").select("member")


def reservations(events: DataFrame) -> DataFrame:
    """account, charged, earmarked from reserve/complete/cancel events: a reservation ends once, by its first completion or cancellation; unknown ids do nothing."""
    made = events.filter("kind = 'reserve'").groupBy("account", "id").agg(F.min_by("amount", "idx").alias("amount"))
    ended = events.filter("kind <> 'reserve'").groupBy("account", "id").agg(F.min_by("kind", "idx").alias("end"))
    both = made.join(ended, ["account", "id"], "left")
    return both.groupBy("account").agg(F.coalesce(F.sum(F.when(F.col("end") == "complete", F.col("amount"))), F.lit(0)).alias("charged"), F.coalesce(F.sum(F.when(F.col("end").isNull(), F.col("amount"))), F.lit(0)).alias("earmarked"))
