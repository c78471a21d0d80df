"""Causal stamps of each replica's log, the order of committed turns, and the deadline by which a session must pair."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _turns(log: DataFrame) -> DataFrame:
    """replica, turn, idx (of its tick, else null), seen: what each tick, and the open end of a log, has before it.

    log: replica, idx, kind ('tick', 'observe', 'clear'), from_replica, from_seq. A turn is the events after one tick up to
    the next. A clear forgets what came before it, the own last dot included.
    """
    before = Window.partitionBy("replica").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    ticks = F.coalesce(F.sum((F.col("kind") == "tick").cast("long")).over(before), F.lit(0).cast("long"))
    numbered = log.withColumn("turn", ticks)
    key = ["replica", "turn"]
    at = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("idx")))
    ends = numbered.groupBy(*key).agg(at("tick").alias("idx"), at("clear").alias("cleared"))
    dots = numbered.filter("kind = 'observe'").groupBy(*key, "from_replica", "from_seq").agg(F.max("idx").alias("last"))
    seen = dots.join(ends, key).filter(F.col("cleared").isNull() | (F.col("last") > F.col("cleared")))
    seen = seen.groupBy(*key).agg(F.collect_set(F.struct(F.col("from_replica").alias("replica"), F.col("from_seq").alias("seq"))).alias("seen"))
    none = F.array().cast("array<struct<replica:string,seq:bigint>>")
    own = F.when((F.col("turn") > 0) & F.col("cleared").isNull(), F.array(F.struct("replica", F.col("turn").alias("seq")))).otherwise(none)
    whole = F.array_sort(F.array_union(F.coalesce(F.col("seen"), none), own))
    return ends.join(seen, key, "left").select(*key, "idx", whole.alias("seen"))


def causal_stamps(log: DataFrame) -> DataFrame:
    """replica, idx, seq, predecessors: the dot of each tick, and the dots that were the frontier when it came."""
    return _turns(log).filter("idx is not null").select("replica", "idx", (F.col("turn") + 1).alias("seq"), F.col("seen").alias("predecessors"))


def causal_frontier(log: DataFrame) -> DataFrame:
    """replica, frontier: the dots that the next tick of each replica would name."""
    ticks = log.groupBy("replica").agg(F.count(F.when(F.col("kind") == "tick", 1)).alias("turn"))
    # a log that ends in a tick has no open turn: its own last dot is the frontier
    own = F.array(F.struct("replica", F.col("turn").alias("seq"))).cast("array<struct<replica:string,seq:bigint>>")
    return ticks.join(_turns(log), ["replica", "turn"], "left").select("replica", F.coalesce("seen", own).alias("frontier"))


def stamped(spans: DataFrame, stamps: DataFrame) -> DataFrame:
    """spans with the stamps (replica, idx, seq, predecessors) of their ticks; a span that has a stamp keeps it."""
    given = stamps.select("replica", "idx", F.col("seq").alias("__seq"), F.col("predecessors").alias("__predecessors"))
    joined = spans.join(given, ["replica", "idx"], "left")
    has = F.col("seq").isNotNull()
    return joined.withColumns({"predecessors": F.when(has, F.col("predecessors")).otherwise(F.col("__predecessors")), "seq": F.coalesce("seq", "__seq")}).select(*spans.columns)


def turn_events(entries: DataFrame) -> DataFrame:
    """idx, event, action, applied: what a committed log tells its consumer, in the log's order.

    entries: idx, kind ('internal', 'entry', 'install'), client, request_id, action. Internal entries are not told. An
    install resets the consumer, its table of served requests too; an entry applies once for each request.
    """
    told = entries.filter("kind in ('entry', 'install')").select("idx", "kind", "client", "request_id", "action")
    none = F.lit(-(1 << 62)).cast("long")
    # an entry's era is the last install up to it: found within its stretch of the log, else carried over from the stretches before, so no task orders the log and no entry looks at every install
    stretches = 4096
    ends = told.agg(F.min("idx").cast("double").alias("lo"), ((F.max("idx").cast("double") - F.min("idx").cast("double")) / stretches + 1).alias("width"))  # one row
    install = F.when(F.col("kind") == "install", F.col("idx"))
    cut = told.crossJoin(F.broadcast(ends)).withColumn("stretch", F.floor((F.col("idx").cast("double") - F.col("lo")) / F.col("width")).cast("int")).drop("lo", "width")
    lasts = cut.groupBy("stretch").agg(F.max(install).alias("last"))  # at most stretches rows, and one of entries without an idx
    before = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select("stretch", F.max("last").over(before).alias("carried"))
    within = Window.partitionBy("stretch").orderBy("idx").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    each = cut.withColumn("own", F.max(install).over(within)).join(F.broadcast(carried), "stretch", "left").withColumn("era", F.coalesce("own", "carried", none))
    # entries of a null client always apply, and installs too: each is dealt alone, not all to one task
    asks = (F.col("kind") == "entry") & F.col("client").isNotNull()
    served = Window.partitionBy("client", "era", "lone").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    judged = each.withColumn("lone", F.when(~asks, F.col("idx"))).withColumn("top", F.max("request_id").over(served))
    applied = F.when(asks, F.col("top").isNull() | (F.col("request_id") > F.col("top"))).otherwise(True)
    return judged.select("idx", F.when(F.col("kind") == "install", "Reset").otherwise("Committed").alias("event"), "action", applied.alias("applied")).orderBy("idx")


def pairing(sessions: DataFrame, rosters: DataFrame, minimum: int, deadline: int, now: int) -> DataFrame:
    """session, event, at, observed: one verdict for each session that has one by now.

    sessions: session, armed. rosters: session, at, members. A roster of the minimum before the deadline is Paired, once
    and for good; else the deadline passes as NeverPaired, with the size that was last observed (0: none was).
    """
    if minimum < 2 or deadline <= 0:
        raise ValueError("a pair takes two members and a deadline that lies ahead")
    timely = sessions.join(rosters, "session", "left").filter(F.col("at").isNull() | (F.col("at") < F.col("armed") + deadline) & (F.col("at") <= now))
    seen = timely.groupBy("session").agg(
        F.min(F.when(F.col("members") >= minimum, F.col("at"))).alias("paired"), F.max_by("members", "at").alias("observed"))
    whole = sessions.join(seen, "session", "left").withColumn("ends", F.col("armed") + deadline)
    paired = F.col("paired").isNotNull()
    verdict = whole.filter(paired | (F.col("ends") <= now))
    return verdict.select(
        "session", F.when(paired, "Paired").otherwise("NeverPaired").alias("event"), F.when(paired, F.col("paired")).otherwise(F.col("ends")).alias("at"),
        F.when(~paired, F.coalesce("observed", F.lit(0))).cast("long").alias("observed"),
    )
