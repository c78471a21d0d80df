"""The catalogue of registered queries, one or more for each operator, with DuckDB SQL that gives the same rows.

Fixtures derive from the provided tables by deterministic expressions only: an event's replica is user_id % 4, its
sequence number counts the replica's events, two overlapping snapshots cut the events at two thirds and at the end.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidefold.functions import hashing as H
from tidefold.functions import rational as R
from tidefold.operators import causal as C
from tidefold.operators import entitlement as E
from tidefold.operators import lattice as L
from tidefold.operators import ledger as G
from tidefold.operators import placement as P
from tidefold.operators import sequence as Q
from tidefold.operators import sketches as K
from tidefold.operators import speculation as X
from tidefold.operators import stamps as S
from tidefold.operators import telemetry as T
from tidefold.plans import draft as D
from tidefold.sources import archive as A
from tidefold.sources.ship import ensure_on_workers
from tidefold.sources.staging import shared_dir

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


class Tables:
    """The provided tables of one folder, opened when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def rows(self, data: list, schema: str) -> DataFrame:
        return self.spark.createDataFrame(data, schema)


def query(name: str, sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_on_workers(spark)
            return f(Tables(spark, sf_dir))

        _QUERIES[name] = run
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---- fixtures -------------------------------------------------------------------------------------------------


def dotted(t: Tables) -> DataFrame:
    """events with replica and seq (from 1 in each replica)."""
    r = t.events.withColumn("replica", F.concat(F.lit("r"), (F.col("user_id") % 4).cast("string")))
    return r.withColumn("seq", F.row_number().over(Window.partitionBy("replica").orderBy("event_id")).cast("long"))


DOTTED = "dotted AS (SELECT *, 'r' || (user_id % 4) AS replica, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS seq FROM events)"


def snapshots(t: Tables, value: str = "1") -> DataFrame:
    """Cumulative per-replica counts per event type at two cuts; the later one covers the earlier."""
    e = t.events.withColumn("replica", F.concat(F.lit("r"), (F.col("user_id") % 4).cast("string")))
    top = e.agg(F.max("event_id").alias("top"))
    e = e.crossJoin(F.broadcast(top))  # one row
    cut = lambda c: e.filter(c).groupBy("event_type", "replica").agg(F.sum(F.expr(value)).alias("count"))
    return L.piece(cut(F.col("event_id") * 3 <= F.col("top") * 2), cut(F.lit(True)))


def lww_writes(t: Tables) -> DataFrame:
    """Writes per user: every seventh is a tombstone."""
    return t.events.select("user_id", F.unix_micros(F.date_trunc("hour", F.col("ts")).cast("timestamp")).alias("ts"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("origin"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))


LWW = "w AS (SELECT user_id, epoch_us(date_trunc('hour', ts)) AS ts, lpad(event_id::VARCHAR, 12, '0') AS origin, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events)"


def states(t: Tables, value: str = "value"):
    """Two states of a causal collection over events: both saw seq <= 40 of each author, A saw all of r0 and r1, B all of r2 and r3; A dropped the multiples of 5, B those of 7."""
    d = dotted(t)
    a = d.filter("(seq <= 40 or replica in ('r0', 'r1')) and seq % 5 <> 0").withColumn("state_id", F.lit("A"))
    b = d.filter("(seq <= 40 or replica in ('r2', 'r3')) and seq % 7 <> 0").withColumn("state_id", F.lit("B"))
    facts = L.piece(a, b)
    ends = d.groupBy("replica").agg(F.max("seq").alias("top"))
    both = ends.crossJoin(t.rows([("A", 0), ("B", 2)], "state_id string, lo int"))  # four authors
    own = F.substring("replica", 2, 1).cast("int").between(F.col("lo"), F.col("lo") + 1)
    vv = both.select("state_id", "replica", F.when(own, F.col("top")).otherwise(F.least("top", F.lit(40).cast("long"))).alias("upto"))
    cloud = t.rows([], "state_id string, replica string, seq long")
    return facts, vv, cloud


#: The survivors: seen by both means held by both, seen by one means held by that one.
SURVIVORS = f"""{DOTTED},
surv AS (SELECT * FROM dotted WHERE CASE WHEN seq <= 40 THEN seq % 5 <> 0 AND seq % 7 <> 0 WHEN replica IN ('r0', 'r1') THEN seq % 5 <> 0 ELSE seq % 7 <> 0 END)"""


def frames(t: Tables) -> DataFrame:
    d = dotted(t)
    return d.select(F.col("event_id").alias("offset"), (F.col("event_id") + 1).alias("end_offset"), F.col("ts").alias("arrived_at"), F.array(F.struct("replica", "seq")).alias("insert_dots"), F.col("event_type").alias("op"))


# ---- hashes in SQL, over the bytes of ASCII strings -------------------------------------------------------------


def _codes(text: str, kind: str) -> str:
    return f"list_transform(string_split({text}, ''), lambda c: unicode(c)::{kind})"


def _mod32(x: str) -> str:
    return f"(({x}) % 4294967296::UBIGINT)"


def _rot32(x: str, r: int) -> str:
    return _mod32(f"(({x}) << {r}) | (({x}) >> {32 - r})")


def _fmix_sql(h: str) -> str:
    """The avalanche of the 32-bit hash that column h of a subquery holds, as nested subqueries' arithmetic."""
    a = _mod32(f"xor({h}, {h} >> 16) * 2246822507::UBIGINT")
    b = _mod32(f"xor({a}, {a} >> 13) * 3266489909::UBIGINT")
    return f"xor({b}, {b} >> 16)"


def _murmur_sql(text: str, seed: int) -> str:
    """Murmur3 of a text: whole blocks of four bytes folded, then the tail."""
    block = lambda i, n: "(" + " + ".join(f"(b[{i} + {j}] << {8 * (j - 1)})" for j in range(1, n + 1)) + ")"
    mixed = lambda k: _mod32(_rot32(_mod32(f"{k} * 3432918353::UBIGINT"), 15) + " * 461845907::UBIGINT")
    blocks = f"list_transform(range(0, len(b) // 4), lambda i: {block('4 * i', 4)})"
    step = _mod32(_rot32(f"xor(h, {mixed('k')})", 13) + " * 5::UBIGINT + 3864292196::UBIGINT")
    body = f"list_reduce(list_prepend({seed}::UBIGINT, {blocks}), lambda h, k: {step})"
    at = "(len(b) // 4 * 4)"
    tail = "CASE len(b) % 4 " + " ".join(f"WHEN {n} THEN xor(h, {mixed(block(at, n))})" for n in (1, 2, 3)) + " ELSE h END"
    return f"(SELECT {_fmix_sql('h')}::BIGINT FROM (SELECT xor({tail}, len(b)::UBIGINT) AS h FROM (SELECT b, {body} AS h FROM (SELECT {_codes(text, 'UBIGINT')} AS b))))"


def _fnv_sql(text: str) -> str:
    fold = f"list_reduce(list_prepend(14695981039346656037::HUGEINT, {_codes(text, 'HUGEINT')}), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616::HUGEINT)"
    return f"(SELECT (CASE WHEN h >= 9223372036854775808::HUGEINT THEN h - 18446744073709551616::HUGEINT ELSE h END)::BIGINT FROM (SELECT {fold} AS h))"


def _ring_sql(text: str) -> str:
    fold = f"list_reduce(list_prepend(0::UBIGINT, {_codes(text, 'UBIGINT')}), lambda h, b: {_mod32('31 * h + b')})"
    return f"(SELECT CASE WHEN m = 2147483648 THEN -2147483648 WHEN m > 2147483648 THEN 4294967296 - m ELSE m END FROM (SELECT {_fmix_sql('h')}::BIGINT AS m FROM (SELECT {fold} AS h)))"


# ---- sources, sinks, persistence ------------------------------------------------------------------------------


@query("s1_source", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(t):
    registry = A.SourceRegistry()
    registry.register("events", lambda spark: t.events)
    return registry.open(t.spark, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("s3_replay_all", "SELECT event_id AS \"offset\", event_id + 1 AS end_offset, event_type AS op FROM events")
def _(t):
    return A.replay(frames(t)).select("offset", "end_offset", "op")


@query("s4_replay_from", "SELECT event_id AS \"offset\", event_type AS op FROM events WHERE event_id + 1 > 500")
def _(t):
    return A.replay_from(frames(t), 500).select("offset", "op")


@query("s5_replay_arrived", "SELECT event_id AS \"offset\", event_type AS op FROM events WHERE ts >= TIMESTAMP '2024-01-01 06:00:00' AND ts < TIMESTAMP '2024-01-02 00:00:00'")
def _(t):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return A.replay_arrived(frames(t), at("2024-01-01 06:00:00"), at("2024-01-02 00:00:00")).select("offset", "op")


@query("s6_replay_above", f"WITH {DOTTED} SELECT event_id AS \"offset\", event_type AS op FROM dotted WHERE seq > CASE replica WHEN 'r0' THEN 100 WHEN 'r1' THEN 10 ELSE 0 END")
def _(t):
    floor = t.rows([("r0", 100), ("r1", 10)], "replica string, upto long")
    return A.replay_above(frames(t), floor).select("offset", "op")


@query("s7_verdict", """
WITH f AS (SELECT event_id, user_id % 4 AS part, event_id AS o, event_id + 1 AS e FROM events WHERE event_id % 500 <> 499),
g AS (SELECT o, e, o // 1000 AS seg, lag(e) OVER (PARTITION BY o // 1000 ORDER BY o) AS p FROM f)
SELECT seg, min(CASE WHEN p IS NOT NULL AND o <> p THEN p END) AS gap_from, max(e) AS last_end, count(CASE WHEN p IS NOT NULL AND o <> p THEN 1 END) AS gaps FROM g GROUP BY seg""")
def _(t):
    f = frames(t).filter("offset % 500 <> 499").withColumn("seg", F.floor(F.col("offset") / 1000))
    return A.verdict(f, ["seg"])


@query("s8_publish", "SELECT event_id, event_type FROM events WHERE event_id % 3 <> 0")
def _(t):
    e = t.events.select("event_id", "event_type")
    return A.publish(L.piece(e, e.filter("event_id % 2 = 0")), e.filter("event_id % 3 = 0"), ["event_id"])


@query("s9_op_kinds", "SELECT CASE WHEN event_type = 'error' THEN 'remove' ELSE 'insert' END AS kind, count(*) AS n FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy(F.when(F.col("event_type") == "error", "remove").otherwise("insert").alias("kind")).agg(F.count("*").alias("n"))


_LOGS_SQL = "logs AS (SELECT event_id AS record_id, epoch_us(ts) * 1000 AS ts_ns, (user_id % 24 + 1)::INTEGER AS severity, event_type AS body, md5((event_id // 4)::VARCHAR) AS trace_id, event_id // 256 AS batch FROM events)"


def logs(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("event_id").alias("record_id"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns"), (F.col("user_id") % 24 + 1).cast("int").alias("severity"), F.col("event_type").alias("body"),
        F.md5(F.expr("cast(event_id div 4 as string)")).alias("trace_id"), F.expr("event_id div 256").alias("batch"),
    )


@query("s12_otlp_json", f"""WITH {_LOGS_SQL} SELECT batch, count(*) AS n,
to_json({{'resourceLogs': [{{'scopeLogs': [{{'logRecords': list({{'timeUnixNano': ts_ns::VARCHAR, 'severityNumber': severity, 'body': {{'stringValue': body}}, 'traceId': trace_id}} ORDER BY ts_ns, record_id)}}]}}]}})::VARCHAR AS body
FROM logs GROUP BY batch""")
def _(t):
    return T.otlp_logs(logs(t), "batch")


@query("s13_pull", "SELECT user_id % 4 AS log, event_id AS record_id, row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) AS pos FROM events")
def _(t):
    e = t.events.withColumn("log", F.col("user_id") % 4)
    by_log = Window.partitionBy("log").orderBy("ts", "event_id")
    ops = e.select(F.col("log").alias("doc"), F.lit("insert").alias("kind"), F.row_number().over(by_log).cast("long").alias("lamport"), F.lit("r").alias("replica"), F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("value"))
    prev = Window.partitionBy("doc").orderBy("lamport")
    ops = ops.withColumns({"after_lamport": F.lag("lamport").over(prev), "after_replica": F.lag("replica").over(prev), "after_seq": F.lag("seq").over(prev)})
    return Q.rga_materialize(ops).select(F.col("doc").alias("log"), F.col("value").cast("long").alias("record_id"), (F.col("pos") + 1).alias("pos"))


@query("s13_pull_logs", "SELECT user_id, event_id AS record_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events")
def _(t):
    by_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ops = t.events.select(F.col("user_id").alias("doc"), F.lit("insert").alias("kind"), F.row_number().over(by_user).cast("long").alias("lamport"), F.lit("r").alias("replica"), F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("value"))
    prev = Window.partitionBy("doc").orderBy("lamport")
    ops = ops.withColumns({"after_lamport": F.lag("lamport").over(prev), "after_replica": F.lag("replica").over(prev), "after_seq": F.lag("seq").over(prev)})
    return Q.rga_materialize(ops).select(F.col("doc").alias("user_id"), F.col("value").cast("long").alias("record_id"), (F.col("pos") + 1).alias("pos"))


@query("s16_digest", """WITH m AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
j AS (SELECT user_id::VARCHAR || chr(31) || to_json(list({'key': event_type, 'value': n} ORDER BY event_type))::VARCHAR AS c FROM m GROUP BY user_id)
SELECT sum(('0x' || substr(md5(c), 1, 15))::BIGINT)::VARCHAR AS root, count(*) AS n FROM j""")
def _(t):
    m = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return A.state_digest(m, "user_id", "m")


# ---- projection, filter, predicates ---------------------------------------------------------------------------


def pipeline_registry(t: Tables) -> D.Registry:
    r = D.Registry()
    r.source("docs", lambda: t.documents)
    r.source("lines", lambda: t.lineitem)
    r.map("length", lambda df: df.withColumn("len", F.char_length("text").cast("long")), {"len"})
    r.map("bucket", lambda df: df.withColumn("bucket", F.expr("doc_id % 8")), {"bucket"})
    r.filter("english", F.col("lang") == "en", {"lang"})
    r.filter("long", F.col("len") > 200, {"len"})
    r.barrier("count", lambda df: df.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("len").alias("chars")))
    r.barrier("by_flag", lambda df: df.groupBy("l_returnflag").agg(F.count("*").alias("n")))
    return r


@query("p1_p3_draft", "SELECT doc_id % 8 AS bucket, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents WHERE lang = 'en' AND length(text) > 200 GROUP BY 1")
def _(t):
    r = pipeline_registry(t)
    draft = D.Draft.shuttle("docs").map("length").map("bucket").filter("english").filter("long").embroider("count")
    return r.lower(D.optimized(draft, r))[0]


@query("p4_monotone_map", "SELECT event_type, count(*) >= 100 AS reached FROM events GROUP BY event_type")
def _(t):
    return L.gcounter(snapshots(t), ["event_type"]).select("event_type", (F.col("value") >= 100).alias("reached"))


@query("p5_p6_affinity", "SELECT s_name AS peer FROM supplier WHERE s_suppkey % 5 <> 0 AND (s_nationkey % 2 = 0 AND s_suppkey % 3 = 1 OR NOT s_nationkey % 2 = 0 AND s_acctbal > 0) UNION ALL SELECT s_name FROM supplier WHERE s_suppkey % 5 = 0 AND FALSE")
def _(t):
    s = t.supplier
    caps = s.filter("s_suppkey % 5 <> 0").select(F.col("s_name").alias("peer"), F.when(F.col("s_nationkey") % 2 == 0, F.array(F.lit("gpu"), F.lit("ssd"))).otherwise(F.array(F.lit("ssd"))).alias("tokens"), F.create_map(F.lit("zone"), (F.col("s_suppkey") % 3).cast("string"), F.lit("credit"), (F.col("s_acctbal") > 0).cast("string")).alias("attrs"))
    want = (P.has("gpu") & P.attr("zone", "1")) | (~P.has("gpu") & P.attr("credit", "true"))
    return P.eligible(s.select(F.col("s_name").alias("peer")), caps, want)


@query("p7_capture_gate", f"WITH {_LOGS_SQL} SELECT record_id FROM logs WHERE severity >= 9 AND record_id % 10 NOT IN (1, 4)")
def _(t):
    sampled = F.when(F.col("record_id") % 10 == 0, None).otherwise(~(F.col("record_id") % 10).isin(1, 4))
    return T.capture_gate(logs(t).withColumn("sampled", sampled), 9).select("record_id")


@query("p8_attributes", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'own' ELSE event_type END AS logger, props AS detail FROM events")
def _(t):
    attrs = F.when(F.col("event_id") % 5 == 0, F.create_map(F.lit("logger"), F.lit("own"), F.lit("detail"), F.col("props"))).otherwise(F.create_map(F.lit("detail"), F.col("props")))
    m = T.mapped_attributes(attrs, F.col("event_type"))
    return t.events.select("event_id", m["logger"].alias("logger"), m["detail"].alias("detail"))


_PRESENCE = "p AS (SELECT user_id, max(event_id) AS clock, arg_max(CASE WHEN event_type <> 'error' THEN value END IS NOT NULL, event_id) AS alive, arg_max(epoch_us(ts) // 1000, event_id) AS received FROM events GROUP BY user_id)"


def presence_states(t: Tables):
    e = t.events.select("user_id", F.col("event_id").alias("clock"), F.when(F.col("event_type") != "error", F.col("value")).alias("value"), F.unix_millis(F.col("ts").cast("timestamp")).alias("received"))
    return e, e.groupBy("user_id").agg(F.max_by("received", "clock").alias("received"))


@query("p9_live", f"WITH {_PRESENCE} SELECT user_id, clock FROM p WHERE alive AND 1704153600000 - received < 3600000")
def _(t):
    e, received = presence_states(t)
    return L.live(L.ephemeral(e.select("user_id", "clock", "value"), ["user_id"]), received, ["user_id"], 1704153600000, 3600000).select("user_id", "clock")


@query("p10_dominates", f"WITH {DOTTED}, a AS (SELECT replica, max(seq) AS u FROM dotted GROUP BY 1), b AS (SELECT replica, max(seq) AS u FROM dotted WHERE event_id < 500 GROUP BY 1) SELECT bool_and(coalesce(a.u, 0) >= b.u) AS dominates FROM b LEFT JOIN a USING (replica)")
def _(t):
    d = dotted(t)
    vv = lambda df: df.groupBy("replica").agg(F.max("seq").alias("upto"))
    return C.dominates(vv(d), vv(d.filter("event_id < 500")))


def _points_sql(where: str = "TRUE") -> str:
    return f"pts AS (SELECT position, min(peer) AS peer FROM (SELECT peer, {_ring_sql('k')} AS position FROM (SELECT s_name AS peer, s_name || '#' || v AS k FROM supplier, range(150) r(v) WHERE {where})) GROUP BY 1)"


def _owners_sql(where: str = "TRUE") -> str:
    """The first point at or after each task's position, else the ring's first."""
    return f"""WITH {_points_sql(where)}, tk AS (SELECT task, {_ring_sql('task')} AS p FROM (SELECT DISTINCT p_name AS task FROM part))
SELECT task, coalesce(near.peer, (SELECT arg_min(peer, position) FROM pts)) AS peer FROM tk ASOF LEFT JOIN pts near ON tk.p <= near.position"""


# ---- joins ----------------------------------------------------------------------------------------------------


@query("j1_causal_merge", f"WITH {SURVIVORS} SELECT replica, seq, event_id FROM surv")
def _(t):
    facts, vv, cloud = states(t)
    return C.causal_merge(facts.select("state_id", "event_id", "replica", "seq"), vv, cloud, ["event_id"])


def spans(t: Tables) -> DataFrame:
    """A span per event; its tree parent is event_id - 1 of the same four, its predecessors are two earlier dots."""
    d = dotted(t)
    pre = F.filter(F.array(F.struct("replica", (F.col("seq") - 1).alias("seq")), F.struct("replica", (F.col("seq") - 3).alias("seq")), F.struct(F.lit("gone").alias("replica"), F.col("seq"))), lambda x: x["seq"] > 0)
    return d.select(F.col("event_id").alias("span_id"), F.when(F.col("event_id") % 4 != 0, F.col("event_id") - 1).alias("parent_span_id"), "replica", "seq", pre.alias("predecessors"))


@query("j2_causal_links", f"""WITH {DOTTED}
SELECT a.event_id AS from_span, b.event_id AS to_span FROM dotted a JOIN dotted b ON a.replica = b.replica AND b.seq IN (a.seq - 1, a.seq - 3)
WHERE (CASE WHEN a.event_id % 4 <> 0 THEN a.event_id - 1 END) IS DISTINCT FROM b.event_id""")
def _(t):
    return T.causal_links(spans(t))


@query("j3_drain", "SELECT event_id AS record_id, event_type FROM events WHERE event_id % 4 <> 1")
def _(t):
    e = t.events.select(F.col("event_id").alias("record_id"), "event_type")
    return T.drain(e, e.filter("record_id % 4 = 1"), "record_id")


@query("j4_drain_metrics", "SELECT event_type AS name, count(*) AS version FROM events GROUP BY 1 HAVING count(*) % 2 = 0 OR event_type IN ('click', 'error')")
def _(t):
    m = t.events.groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("version"))
    digest = m.filter("name not in ('click', 'error')").select("name", (F.col("version") - F.when(F.col("version") % 2 == 0, 1).otherwise(0)).alias("version"))
    return T.drain_metrics(m, digest, ["name"])


@query("j5_links_of_drained", f"""WITH {DOTTED}
SELECT a.event_id AS from_span, b.event_id AS to_span FROM dotted a JOIN dotted b ON a.replica = b.replica AND b.seq IN (a.seq - 1, a.seq - 3)
WHERE (CASE WHEN a.event_id % 4 <> 0 THEN a.event_id - 1 END) IS DISTINCT FROM b.event_id AND a.event_id % 10 = 3""")
def _(t):
    fresh = t.events.filter("event_id % 10 = 3").select(F.col("event_id").alias("from_span"))
    return T.causal_links(spans(t)).join(fresh, "from_span", "left_semi")


@query("j6_ring_owner", _owners_sql())
def _(t):
    return P.owners(t.part.select(F.col("p_name").alias("task")).distinct(), P.ring_points(t.supplier.select(F.col("s_name").alias("peer"))))


@query("j7_ring_successor", _owners_sql("s_suppkey % 7 <> 0"))
def _(t):
    others = t.supplier.filter("s_suppkey % 7 <> 0").select(F.col("s_name").alias("peer"))
    return P.owners(t.part.select(F.col("p_name").alias("task")).distinct(), P.ring_points(others))


@query("j8_winners", "SELECT l_orderkey AS task, min(s_name) AS peer FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal > 0 GROUP BY 1")
def _(t):
    claims = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_orderkey").alias("task"), F.col("s_name").alias("peer"))
    return P.winners(claims, t.supplier.filter("s_acctbal > 0").select(F.col("s_name").alias("peer")))


@query("j11_lineage", "SELECT 'nation-' || n_name AS grp, 'e-n-' || n_name AS edge, 0::BIGINT AS level FROM nation UNION ALL SELECT 'nation-' || n_name, 'e-r-' || r_name, 1 FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'region-' || r_name, 'e-r-' || r_name, 0 FROM region")
def _(t):
    return G.lineage(ledger_edges(t))


@query("j12_zip", "SELECT (SELECT count(*) FROM events) AS a, (SELECT count(DISTINCT user_id) FROM events) AS b")
def _(t):
    return t.events.agg(F.count("*").alias("a")).crossJoin(t.events.select("user_id").distinct().agg(F.count("*").alias("b")))  # one row each


# ---- exact lattice aggregates ---------------------------------------------------------------------------------


@query("a1_gcounter", "SELECT event_type, count(*) AS value FROM events GROUP BY event_type")
def _(t):
    return L.gcounter(snapshots(t), ["event_type"])


@query("a2_gcounter_double", "SELECT event_type, sum(floor(value))::DOUBLE AS value FROM events GROUP BY event_type")
def _(t):
    return L.gcounter_double(snapshots(t, "floor(value)").withColumn("count", F.col("count").cast("double")), ["event_type"])


@query("a3_pncounter", "SELECT l_suppkey, sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity::BIGINT ELSE l_quantity::BIGINT END)::BIGINT AS value FROM lineitem GROUP BY 1")
def _(t):
    s = t.lineitem.groupBy("l_suppkey", (F.col("l_orderkey") % 4).alias("replica"), F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("sign")).agg(F.sum(F.col("l_quantity").cast("long")).alias("count"))
    return L.pncounter(L.piece(s, s), ["l_suppkey"])


@query("a4_resettable_counter", f"WITH {SURVIVORS} SELECT event_type, sum(floor(value)::BIGINT)::BIGINT AS value FROM surv GROUP BY 1")
def _(t):
    facts, vv, cloud = states(t)
    return C.or_map_sum(facts.select("state_id", "event_type", "replica", "seq", F.floor("value").alias("value")), vv, cloud, "event_type")


_BOUNDED = """
i AS (SELECT 'n' || n_nationkey AS replica, 1000::BIGINT AS v FROM nation),
s AS (SELECT 'n' || c_nationkey AS replica, -count(*)::BIGINT AS v FROM customer GROUP BY 1),
x AS (SELECT 'n' || n_nationkey AS a, 'n' || ((n_nationkey + 1) % 25) AS b, (n_nationkey * 10)::BIGINT AS v FROM nation),
q AS (SELECT replica, sum(v)::BIGINT AS quota FROM (SELECT * FROM i UNION ALL SELECT * FROM s UNION ALL SELECT a, -v FROM x UNION ALL SELECT b, v FROM x) GROUP BY 1)"""


def bounded(t: Tables) -> DataFrame:
    name = lambda c: F.concat(F.lit("n"), c.cast("string"))
    initial = t.nation.select(name(F.col("n_nationkey")).alias("replica"), F.lit(1000).cast("long").alias("amount"))
    spends = t.customer.groupBy(name(F.col("c_nationkey")).alias("replica")).agg(F.count("*").alias("amount"))
    moves = t.nation.select(name(F.col("n_nationkey")).alias("replica"), name((F.col("n_nationkey") + 1) % 25).alias("to_replica"), (F.col("n_nationkey") * 10).cast("long").alias("amount"))
    return L.bounded_quota(initial, L.piece(spends, spends), moves)


@query("a5_bounded_counter", f"WITH {_BOUNDED} SELECT * FROM q")
def _(t):
    return bounded(t)


@query("a5_spend_refused", f"WITH {_BOUNDED} SELECT s_name, s_suppkey * 20 AS amount, coalesce(s_suppkey * 20 <= quota, FALSE) AS accepted FROM supplier LEFT JOIN q ON replica = 'n' || s_nationkey")
def _(t):
    asks = t.supplier.select("s_name", F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("replica"), (F.col("s_suppkey") * 20).alias("amount"))
    return L.within_quota(asks, bounded(t)).select("s_name", "amount", "accepted")


@query("a6_lww_register", f"WITH {LWW} SELECT user_id, arg_max_null(value, (ts, origin)) AS value FROM w GROUP BY 1")
def _(t):
    return L.lww(lww_writes(t), ["user_id"])


@query("a7_gauge", f"WITH {LWW} SELECT user_id, arg_max(value, (ts, origin)) AS value FROM w WHERE value IS NOT NULL GROUP BY 1")
def _(t):
    return L.gauge(lww_writes(t), ["user_id"])


@query("a8_lww_map", f"WITH {LWW} SELECT * FROM (SELECT user_id, arg_max_null(value, (ts, origin)) AS value FROM w GROUP BY 1) WHERE value IS NOT NULL")
def _(t):
    return L.lww_map(lww_writes(t), ["user_id"])


@query("a9_mv_register", f"WITH {SURVIVORS} SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS vals FROM surv GROUP BY 1")
def _(t):
    facts, vv, cloud = states(t)
    return C.mv_register(facts.select("state_id", "user_id", "replica", "seq", "event_type"), vv, cloud, ["user_id"], "event_type").select("user_id", F.array_join("values", ",").alias("vals"))


@query("a10_gset", "SELECT DISTINCT o_custkey FROM orders")
def _(t):
    s = t.orders.select("o_custkey")
    return L.gset(s.filter("o_custkey % 2 = 0"), s, s.filter("o_custkey % 3 = 0"))


@query("a11_two_phase_set", "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def _(t):
    return L.two_phase_set(t.orders, t.orders.filter("o_orderstatus = 'P'"), ["o_custkey"])


@query("a12_orset", f"WITH {SURVIVORS} SELECT DISTINCT user_id FROM surv")
def _(t):
    facts, vv, cloud = states(t)
    return C.or_set(facts.select("state_id", "user_id", "replica", "seq"), vv, cloud, "user_id")


@query("a13_ormap", f"WITH {SURVIVORS} SELECT user_id, arg_max(value, (epoch_us(ts), event_id)) AS value FROM surv GROUP BY 1")
def _(t):
    facts, vv, cloud = states(t)
    rows = facts.select("state_id", "user_id", "replica", "seq", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("origin"), "value")
    keyed = C.causal_merge(rows, vv, cloud, ["user_id"])
    return keyed.groupBy("user_id").agg(F.max_by("value", F.struct("ts", "origin")).alias("value"))


@query("a14_ephemeral_map", f"WITH {_PRESENCE} SELECT user_id, clock, alive FROM p")
def _(t):
    e, _ = presence_states(t)
    return L.ephemeral(e.select("user_id", "clock", "value"), ["user_id"]).select("user_id", "clock", F.col("value").isNotNull().alias("alive"))


_VECTORS = f"{DOTTED}, vv AS (SELECT event_type AS peer, replica, max(seq) AS upto FROM dotted WHERE NOT (event_type = 'error' AND replica = 'r3') GROUP BY 1, 2)"


def vectors(t: Tables) -> DataFrame:
    return dotted(t).filter("not (event_type = 'error' and replica = 'r3')").groupBy(F.col("event_type").alias("peer"), "replica").agg(F.max("seq").alias("upto"))


@query("a15_vv_ceil", f"WITH {_VECTORS} SELECT replica, max(upto) AS upto FROM vv GROUP BY 1")
def _(t):
    return L.vv_ceil(vectors(t), [])


@query("a15_vv_floor", f"WITH {_VECTORS}, n AS (SELECT count(DISTINCT peer) AS n FROM vv) SELECT replica, min(upto) AS upto FROM vv, n GROUP BY replica, n.n HAVING count(DISTINCT peer) = n.n")
def _(t):
    v = vectors(t)
    return L.vv_floor(v, [], "peer", v.select("peer").distinct().count())


@query("a16_dot_context", f"WITH {DOTTED}, s AS (SELECT replica, seq FROM dotted WHERE seq % 97 <> 0), g AS (SELECT replica, seq, row_number() OVER (PARTITION BY replica ORDER BY seq) AS n FROM s) SELECT replica, count(CASE WHEN seq = n THEN 1 END) AS upto, count(CASE WHEN seq <> n THEN 1 END) AS cloud FROM g GROUP BY 1")
def _(t):
    vv, cloud = C.compact_context(dotted(t).filter("seq % 97 <> 0"), ["replica"])
    return vv.join(cloud.groupBy("replica").agg(F.count("*").alias("cloud")), "replica", "left").select("replica", "upto", F.coalesce("cloud", F.lit(0)).alias("cloud"))


@query("a17_product", "SELECT event_type, max(event_id) AS top, min(user_id) AS least FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("event_type").agg(F.max("event_id").alias("top"), F.min("user_id").alias("least"))


@query("a18_join_all", "SELECT count(DISTINCT user_id) AS n FROM events")
def _(t):
    e = t.events.select("user_id")
    return L.gset(*(e.filter(F.col("user_id") % 5 == k) for k in range(5))).agg(F.count("*").alias("n"))


@query("a19_metric_catalog", """
SELECT event_type AS name, props AS attrs, 'sum' AS kind, list_reduce(list(v ORDER BY r), lambda a, b: a + b) AS value FROM (SELECT event_type, props, user_id % 4 AS r, max(value / 7) AS v FROM events GROUP BY ALL) GROUP BY ALL
UNION ALL SELECT event_type, props, 'gauge', arg_max(value / 7, (epoch_us(ts), user_id % 4, value)) FROM events GROUP BY event_type, props""")
def _(t):
    base = t.events.select(F.col("event_type").alias("name"), F.col("props").alias("attrs"), (F.col("user_id") % 4).alias("replica"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), (F.col("value") / 7).alias("value"))
    return T.merged_metrics(base.withColumn("kind", F.lit("sum")).unionByName(base.withColumn("kind", F.lit("gauge"))))


@query("a19_distinct_metric", f"""WITH h AS (SELECT name, attrs, {_murmur_sql('item', 0)} AS h FROM (SELECT DISTINCT event_type AS name, 'all' AS attrs, user_id::VARCHAR AS item FROM events)),
g AS (SELECT name, attrs, h >> 18 AS idx, max(19 - CASE WHEN h & 262143 = 0 THEN 0 ELSE floor(log2(h & 262143))::INTEGER + 1 END) AS rho FROM h GROUP BY ALL)
SELECT name, attrs, round(16384 * ln(16384.0 / (16384 - count(*))), 6) AS value FROM g GROUP BY ALL""")
def _(t):
    points = t.events.select(F.col("event_type").alias("name"), F.lit("all").alias("attrs"), F.lit("distinct").alias("kind"), F.col("user_id").alias("item"))
    return T.distinct_metrics(points).select("name", "attrs", F.round("value", 6).alias("value"))


@query("a19_histogram_metric", "SELECT event_type AS name, 'all' AS attrs, CASE WHEN value <= 10 THEN 0 WHEN value <= 50 THEN 1 ELSE 2 END AS bucket, count(*) AS count, round(sum(value::DECIMAL(20, 4)), 4)::DOUBLE AS sum FROM events GROUP BY ALL")
def _(t):
    points = t.events.select(F.col("event_type").alias("name"), F.lit("all").alias("attrs"), F.lit("histogram").alias("kind"), (F.col("user_id") % 4).alias("replica"), "value")
    return T.histogram_metrics(points, [10, 50]).withColumn("sum", F.round("sum", 4))


@query("a19_summary_metric", """WITH c AS (SELECT event_type, CASE WHEN value < 1e-9 THEN 0 ELSE 1 END AS p, CASE WHEN value < 1e-9 THEN 0 ELSE ceil(ln(value) / ln(1.01 / 0.99))::INTEGER END AS idx, count(*) AS n FROM events GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY p, idx) AS cum, sum(n) OVER (PARTITION BY event_type) AS tot FROM c)
SELECT event_type AS name, 'all' AS attrs, q, round(arg_min(CASE WHEN p = 0 THEN 0.0 ELSE 2 * pow(1.01 / 0.99, idx) / (1 + 1.01 / 0.99) END, (p, idx)), 6) AS value FROM r, (VALUES (0.5::DOUBLE), (0.99)) v(q) WHERE cum > q * (tot - 1) GROUP BY ALL""")
def _(t):
    points = t.events.select(F.col("event_type").alias("name"), F.lit("all").alias("attrs"), F.lit("summary").alias("kind"), "value")
    return T.quantile_metrics(points, [0.5, 0.99]).select("name", "attrs", "q", F.round("value", 6).alias("value"))


@query("a20_fedavg", "WITH u AS (SELECT label, count(*) AS n, max(vec_id) AS v FROM embeddings GROUP BY 1) SELECT i::INTEGER - 1 AS i, round(sum(embedding[i]::DOUBLE * n) / sum(n), 6) AS weight FROM u JOIN embeddings ON vec_id = v, range(1, 65) r(i) GROUP BY 1")
def _(t):
    sizes = t.embeddings.groupBy("label").agg(F.count("*").alias("samples"), F.max("vec_id").alias("vec_id"))
    u = t.embeddings.select("vec_id", "embedding").join(sizes, "vec_id").select(F.col("label").alias("peer"), F.lit(2).alias("epoch"), "samples", F.col("embedding").alias("weights"))
    return L.fedavg(L.piece(u, u.withColumn("epoch", F.lit(1)))).select("i", F.round("weight", 6).alias("weight"))


@query("a21_gradient_step", "SELECT round(0.5 - 0.001 * sum((0.5 * l_quantity + 1 - l_tax) * l_quantity) / count(*), 6) AS w, round(1 - 0.001 * sum(0.5 * l_quantity + 1 - l_tax) / count(*), 6) AS b FROM lineitem")
def _(t):
    return L.gradient_step(t.lineitem, "l_quantity", "l_tax", 0.5, 1.0, 0.001).select(F.round("w", 6).alias("w"), F.round("b", 6).alias("b"))


@query("a22_results", f"WITH {SURVIVORS} SELECT event_type AS task, arg_max(event_id, (epoch_us(ts), event_id)) AS result FROM surv GROUP BY 1")
def _(t):
    facts, vv, cloud = states(t)
    rows = facts.select("state_id", F.col("event_type").alias("task"), "replica", "seq", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("origin"), F.col("event_id").alias("value"))
    return C.or_map_lww(rows, vv, cloud, "task").select("task", F.col("value").alias("result"))


@query("a23_work_queue", f"WITH {SURVIVORS} SELECT DISTINCT event_id AS task FROM surv")
def _(t):
    facts, vv, cloud = states(t)
    return C.or_set(facts.select("state_id", F.col("event_id").alias("task"), "replica", "seq"), vv, cloud, "task")


@query("a29_command_dedup", "SELECT event_id, user_id IS NULL OR (event_id * 7) % 101 > coalesce(max((event_id * 7) % 101) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS applied FROM events")
def _(t):
    return L.apply_once(t.events.select(F.col("event_id").alias("idx"), F.col("user_id").alias("client"), ((F.col("event_id") * 7) % 101).alias("request_id"))).select(F.col("idx").alias("event_id"), "applied")


@query("a30_gossip_admission", f"WITH {DOTTED} SELECT replica, max(seq) AS upto FROM dotted GROUP BY 1")
def _(t):
    d = dotted(t).select("replica", "seq")
    return C.contiguous(L.piece(d, d.filter("seq % 3 = 0")).dropDuplicates(["replica", "seq"]))


@query("a31_card_state", "SELECT p_brand AS card, max(p_size) AS stage, arg_max(p_name, (p_size, p_name)) AS cipher FROM part GROUP BY 1")
def _(t):
    return L.furthest(t.part.select(F.col("p_brand").alias("card"), F.col("p_size").alias("stage"), F.col("p_name").alias("cipher")), ["card"], ["stage"], "cipher")


@query("a32_seam_totals", "SELECT count(*) AS sent, sum(length(props))::BIGINT AS bytes FROM events")
def _(t):
    return t.events.agg(F.count("*").alias("sent"), F.sum(F.char_length("props")).cast("long").alias("bytes"))


# ---- ledger ---------------------------------------------------------------------------------------------------


def ledger_edges(t: Tables) -> DataFrame:
    """root -> regions -> nations."""
    r = t.region.select(F.concat(F.lit("e-r-"), "r_name").alias("edge"), F.lit("root").alias("parent"), F.concat(F.lit("region-"), "r_name").alias("child"), F.lit(1).cast("long").alias("weight_num"), (F.col("r_regionkey") + 1).cast("long").alias("weight_den"), F.lit("ACTIVE").alias("lifecycle"))
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat(F.lit("e-n-"), "n_name").alias("edge"), F.concat(F.lit("region-"), "r_name").alias("parent"), F.concat(F.lit("nation-"), "n_name").alias("child"),
        F.lit(2).cast("long").alias("weight_num"), F.lit(3).cast("long").alias("weight_den"), F.when(F.col("n_nationkey") % 7 == 0, "RETIRED").otherwise("ACTIVE").alias("lifecycle"))
    return L.piece(r, n)


def ledger_counters(t: Tables) -> DataFrame:
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    rep = F.concat(F.lit("r"), (F.col("c_custkey") % 2).cast("string"))
    by = lambda e, kind, v: c.groupBy(F.concat(F.lit(e[0]), e[1]).alias("edge"), rep.alias("replica"), F.lit(kind).alias("kind")).agg(v.cast("long").alias("amount"))
    one = F.count("*")
    return L.piece(by(("e-r-", "r_name"), "issued", one * 3), by(("e-n-", "n_name"), "issued", one * 2), by(("e-n-", "n_name"), "leaf", one), by(("e-r-", "r_name"), "rollup", one), by(("e-n-", "n_name"), "returned", F.sum((F.col("c_custkey") % 3 == 0).cast("int"))))


def ledger_minted(t: Tables) -> DataFrame:
    m = t.supplier.select(F.concat(F.lit("m"), F.col("s_suppkey").cast("string")).alias("id"), F.concat(F.lit("r"), (F.col("s_suppkey") % 2).cast("string")).alias("holder"), F.lit(100).cast("long").alias("amount"))
    return L.piece(m, m)


def ledger_transfers(t: Tables) -> DataFrame:
    return t.nation.select(F.concat(F.lit("e-n-"), "n_name").alias("path"), F.lit("r0").alias("sender"), F.lit("r1").alias("receiver"), (F.col("n_nationkey") + 1).cast("long").alias("amount")).unionByName(t.rows([("gone", "r0", "r1", 5)], "path string, sender string, receiver string, amount long"))


_CUST = "cu AS (SELECT n_name, n_nationkey, r_name, 'r' || (c_custkey % 2) AS rep, count(*) AS c, count(*) FILTER (c_custkey % 3 = 0) AS ret FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)"
_HELD = f"""{_CUST},
v AS (
 SELECT 'root' AS grp, 'r' || (s_suppkey % 2) AS replica, 100 AS v FROM supplier
 UNION ALL SELECT 'root', rep, -3 * c FROM cu UNION ALL SELECT 'region-' || r_name, rep, 3 * c FROM cu
 UNION ALL SELECT 'region-' || r_name, rep, -(2 * c - ret) FROM cu UNION ALL SELECT 'nation-' || n_name, rep, 2 * c - ret - c FROM cu
 UNION ALL SELECT 'nation-' || n_name, 'r0', -(n_nationkey + 1) FROM nation UNION ALL SELECT 'nation-' || n_name, 'r1', n_nationkey + 1 FROM nation),
held AS (SELECT grp, replica, sum(v)::BIGINT AS held FROM v GROUP BY ALL)"""


@query("a25_holdings", f"WITH {_HELD} SELECT * FROM held")
def _(t):
    return G.holdings(ledger_minted(t), ledger_edges(t), ledger_counters(t), ledger_transfers(t))


@query("a24_edge_totals", f"WITH {_CUST} SELECT 'e-n-' || n_name AS edge, (2 * sum(c))::BIGINT AS issued, sum(ret)::BIGINT AS returned, sum(c)::BIGINT AS leaf, 0::BIGINT AS rollup FROM cu GROUP BY n_name UNION ALL SELECT 'e-r-' || r_name, (3 * sum(c))::BIGINT, 0, 0, sum(c)::BIGINT FROM cu GROUP BY r_name")
def _(t):
    c = ledger_counters(t)
    return G.edge_totals(L.piece(c, c))


@query("a26_virtual_service", f"WITH {_CUST}, s AS (SELECT 'e-n-' || n_name AS edge, ((2 * sum(c) - sum(ret)) * 3)::BIGINT AS n, 2::BIGINT AS d FROM cu GROUP BY n_name UNION ALL SELECT 'e-r-' || r_name, (3 * sum(c) * (r_regionkey + 1))::BIGINT, 1 FROM cu JOIN region USING (r_name) GROUP BY r_name, r_regionkey) SELECT edge, n // gcd(n, d) AS num, d // gcd(n, d) AS den FROM s")
def _(t):
    return G.virtual_service(ledger_edges(t), ledger_counters(t))


@query("a27_validate", f"""WITH {_HELD}
SELECT 'PersistentNegativeHoldings' AS kind, grp || '/' || replica AS subject FROM held WHERE held < 0
UNION ALL SELECT 'OrphanedTransferPath', 'gone'
UNION ALL SELECT 'ClosureViolation', 'e-n-' || n_name FROM (SELECT n_name, 2 * sum(c) - sum(ret) - sum(c) AS o FROM cu WHERE n_nationkey % 7 = 0 GROUP BY n_name) WHERE o <> 0
UNION ALL SELECT 'PerEdgeSafety', 'e-n-' || n_name FROM (SELECT n_name, sum(c) + sum(ret) AS used, 2 * sum(c) AS issued FROM cu GROUP BY n_name) WHERE used > issued
UNION ALL SELECT 'ConservationViolation', '*' WHERE (SELECT sum(c) FROM cu) > (SELECT 100 * count(*) FROM supplier)""")
def _(t):
    return G.validate(ledger_minted(t), ledger_edges(t), ledger_counters(t), ledger_transfers(t))


@query("l1_mint", "SELECT 'r' || (s_suppkey % 2) AS holder, (100 * count(*))::BIGINT AS amount FROM supplier GROUP BY 1")
def _(t):
    return G.mints(ledger_minted(t)).groupBy("holder").agg(F.sum("amount").alias("amount"))


def ledger_actions(t: Tables) -> DataFrame:
    """A delegation, a release and a transfer for each nation or region, some beyond what is held, some down a retired edge, one down an unknown one."""
    n, no = t.nation, F.lit(None).cast("string")
    edge, rep = F.concat(F.lit("e-n-"), "n_name"), F.concat(F.lit("r"), (F.col("n_nationkey") % 2).cast("string"))
    long = lambda c: c.cast("long")
    down = n.select(long(F.col("n_nationkey")).alias("id"), F.lit("delegate").alias("kind"), rep.alias("replica"), edge.alias("place"), no.alias("receiver"), long(F.col("n_nationkey") % 4 * 100_000 + 1).alias("amount"))
    up = n.select(long(F.col("n_nationkey") + 100).alias("id"), F.lit("release").alias("kind"), rep.alias("replica"), edge.alias("place"), no.alias("receiver"), long(F.col("n_nationkey") % 3 * 100_000 + 1).alias("amount"))
    over = t.region.select(long(F.col("r_regionkey") + 200).alias("id"), F.lit("transfer").alias("kind"), F.lit("r0").alias("replica"), F.concat(F.lit("region-"), "r_name").alias("place"), F.concat(F.lit("r"), (F.col("r_regionkey") % 4 % 3).cast("string")).alias("receiver"), long(F.col("r_regionkey") % 2 * 1_000_000 + 1).alias("amount"))
    return L.piece(down, up, over, t.rows([(300, "delegate", "r0", "gone", None, 1)], "id long, kind string, replica string, place string, receiver string, amount long"))


_ACTIONS = f"""{_HELD},
a AS (SELECT n_nationkey AS id, 'delegate' AS kind, 'r' || (n_nationkey % 2) AS replica, 'region-' || r_name AS grp, n_name, (n_nationkey % 4 * 100000 + 1)::BIGINT AS amount, CASE WHEN n_nationkey % 7 = 0 THEN 'not active' END AS form FROM nation JOIN region ON n_regionkey = r_regionkey
 UNION ALL SELECT n_nationkey + 100, 'release', 'r' || (n_nationkey % 2), 'nation-' || n_name, n_name, n_nationkey % 3 * 100000 + 1, CASE WHEN n_nationkey % 7 = 0 THEN 'contested lineage' END FROM nation
 UNION ALL SELECT r_regionkey + 200, 'transfer', 'r0', 'region-' || r_name, NULL, r_regionkey % 2 * 1000000 + 1, CASE WHEN r_regionkey % 4 % 3 = 0 THEN 'malformed' END FROM region UNION ALL SELECT 300, 'delegate', 'r0', NULL, NULL, 1, 'unknown edge'),
k AS (SELECT *, row_number() OVER (PARTITION BY grp, replica, form IS NULL ORDER BY id) AS turn FROM a),
j AS (SELECT k.*, CASE WHEN form IS NOT NULL THEN form WHEN turn > 1 THEN 'later' WHEN amount > coalesce(held, 0) THEN 'insufficient' END AS reason FROM k LEFT JOIN held ON held.grp = k.grp AND held.replica = k.replica)"""


@query("l2_l3_actions", f"WITH {_ACTIONS} SELECT id::BIGINT AS id, kind, replica, grp, amount, reason FROM j")
def _(t):
    return E.judged(ledger_actions(t), ledger_minted(t), ledger_edges(t), ledger_counters(t), ledger_transfers(t)).select("id", "kind", "replica", "grp", "amount", "reason")


@query("l2_patch", f"""WITH {_ACTIONS} SELECT 'e-n-' || j.n_name AS edge, replica, CASE kind WHEN 'delegate' THEN 'issued' ELSE 'returned' END AS kind, (coalesce(CASE kind WHEN 'delegate' THEN 2 * c ELSE ret END, 0) + amount)::BIGINT AS amount
FROM j LEFT JOIN cu ON cu.n_name = j.n_name AND rep = replica WHERE reason IS NULL AND kind <> 'transfer'""")
def _(t):
    c = ledger_counters(t)
    return E.counter_patch(E.judged(ledger_actions(t), ledger_minted(t), ledger_edges(t), c, ledger_transfers(t)), c)


@query("l3_patch", f"WITH {_ACTIONS} SELECT 'e-r-' || substr(grp, 8) AS path, 'r0' AS sender, 'r' || ((id - 200) % 4 % 3) AS receiver, amount FROM j WHERE reason IS NULL AND kind = 'transfer'")
def _(t):
    return E.transfer_patch(E.judged(ledger_actions(t), ledger_minted(t), ledger_edges(t), ledger_counters(t), ledger_transfers(t)), ledger_transfers(t))


@query("l6_retire", "SELECT o_custkey::VARCHAR AS edge, CASE WHEN max(CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE 3 END) <> 2 THEN 'not closing' WHEN sum(CASE o_orderkey % 3 WHEN 0 THEN -1 ELSE 1 END) <> 0 THEN 'outstanding' END AS reason FROM orders GROUP BY 1 UNION ALL SELECT 'gone', 'unknown edge'")
def _(t):
    state = F.when(F.col("o_orderstatus") == "O", "ACTIVE").when(F.col("o_orderstatus") == "P", "CLOSED").otherwise("RETIRED")
    edge = F.col("o_custkey").cast("string").alias("edge")
    marks = t.orders.select(edge, state.alias("lifecycle"))
    counters = t.orders.select(edge, F.lit("r").alias("replica"), F.when(F.col("o_orderkey") % 3 == 0, "returned").otherwise("issued").alias("kind")).groupBy("edge", "replica", "kind").agg(F.count("*").alias("amount"))
    return E.retirement(marks.select("edge").unionByName(t.rows([("gone",)], "edge string")), marks, counters)


@query("a26_gauged_service", f"""WITH {_CUST}, s AS (SELECT 'e-n-' || n_name AS edge, sum(2 * c)::BIGINT AS i, sum(ret)::BIGINT AS r, 2 AS w, 3 AS d, any_value(n_nationkey) AS k FROM cu GROUP BY n_name UNION ALL SELECT 'e-r-' || r_name, sum(3 * c)::BIGINT, 0, 1, r_regionkey + 1, -1 FROM cu JOIN region USING (r_name) GROUP BY r_name, r_regionkey),
f AS (SELECT edge, CASE WHEN k % 2 = 0 THEN (k + 1) * w + 4 * (i - 10 - r) * d ELSE (i - r) * d END AS n, CASE WHEN k % 2 = 0 THEN 4 * w ELSE w END AS m FROM s) SELECT edge, (n // gcd(n, m))::BIGINT AS num, (m // gcd(n, m))::BIGINT AS den FROM f""")
def _(t):
    n = t.nation.filter("n_nationkey % 2 = 0").select(F.concat(F.lit("e-n-"), "n_name").alias("edge"), (F.col("n_nationkey") + 1).cast("long").alias("floor_num"), F.lit(4).cast("long").alias("floor_den"), F.lit(7).cast("long").alias("folded"))
    lower = n.select("edge", F.lit(0).cast("long").alias("floor_num"), F.lit(1).cast("long").alias("floor_den"), F.lit(10).cast("long").alias("folded"))
    return E.gauged_service(ledger_edges(t), ledger_counters(t), L.piece(n, lower))


@query("a28_bounds", f"""WITH {_HELD}, ch AS (SELECT 'region-' || r_name AS parent, sum(2 * c - ret) AS s, 1.0 AS w FROM cu WHERE n_nationkey % 7 <> 0 AND n_nationkey % 3 <> 0 GROUP BY r_name, n_name),
dv AS (SELECT parent, max((abs(sum_s - n * s) + n - 1) // n) AS gap FROM (SELECT parent, s::BIGINT AS s, sum(s) OVER (PARTITION BY parent)::BIGINT AS sum_s, count(*) OVER (PARTITION BY parent) AS n FROM ch) GROUP BY parent),
st AS (SELECT grp AS parent, sum(greatest(held, 0)) AS steer FROM held WHERE replica IN ('r0', 'r1') GROUP BY 1),
ps AS (SELECT 'root' AS parent UNION ALL SELECT 'region-' || r_name FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1)
SELECT parent, 2030::BIGINT AS worst, least(2030, coalesce(steer, 0) + 30)::BIGINT AS bound, coalesce(gap, 0)::BIGINT AS deviation FROM ps LEFT JOIN st USING (parent) LEFT JOIN dv USING (parent)""")
def _(t):
    demanding = t.nation.filter("n_nationkey % 3 <> 0").select(F.concat(F.lit("e-n-"), "n_name").alias("edge"))
    held = G.holdings(ledger_minted(t), ledger_edges(t), ledger_counters(t), ledger_transfers(t))
    return E.bound_metrics(ledger_edges(t), ledger_counters(t), held, t.rows([("r0",), ("r1",)], "replica string"), demanding, 1000, 30)


@query("l4_spend_rollup", "SELECT 'e-n-' || n_name AS edge, 'r0' AS replica, 'leaf' AS kind, (n_nationkey + 1)::BIGINT AS amount FROM nation UNION ALL SELECT 'e-r-' || r_name, 'r0', 'rollup', sum(n_nationkey + 1)::BIGINT FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def _(t):
    spends = t.nation.select(F.concat(F.lit("nation-"), "n_name").alias("grp"), F.lit("r0").alias("replica"), (F.col("n_nationkey") + 1).cast("long").alias("amount"))
    return G.spend_rollup(spends, ledger_edges(t))


@query("l6_lifecycle", "SELECT o_custkey::VARCHAR AS edge, CASE max(CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE 3 END) WHEN 1 THEN 'ACTIVE' WHEN 2 THEN 'CLOSED' ELSE 'RETIRED' END AS lifecycle FROM orders GROUP BY 1")
def _(t):
    state = F.when(F.col("o_orderstatus") == "O", "ACTIVE").when(F.col("o_orderstatus") == "P", "CLOSED").otherwise("RETIRED")
    return G.lifecycles(t.orders.select(F.col("o_custkey").cast("string").alias("edge"), state.alias("lifecycle")))


@query("l9_reservations", "WITH r AS (SELECT l_suppkey AS account, l_orderkey * 10 + l_linenumber AS id, min(l_quantity::BIGINT) AS a, min(l_returnflag) AS f FROM lineitem GROUP BY 1, 2) SELECT account, coalesce(sum(a) FILTER (f = 'A'), 0)::BIGINT AS charged, coalesce(sum(a) FILTER (f = 'N'), 0)::BIGINT AS earmarked FROM r GROUP BY 1")
def _(t):
    key = [F.col("l_suppkey").alias("account"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")]
    base = t.lineitem.groupBy(*key).agg(F.min(F.col("l_quantity").cast("long")).alias("amount"), F.min("l_returnflag").alias("f"))
    made = base.select("account", "id", F.lit("reserve").alias("kind"), "amount", F.lit(1).alias("idx"))
    ends = base.filter("f in ('A', 'R')").select("account", "id", F.when(F.col("f") == "A", "complete").otherwise("cancel").alias("kind"), F.lit(None).cast("long").alias("amount"), F.lit(2).alias("idx"))
    return G.reservations(L.piece(made, ends, ends.withColumn("idx", F.lit(3))))


@query("l10_demand", "SELECT l_suppkey::VARCHAR AS edge, max(l_quantity)::BIGINT AS target, max(l_linenumber)::BIGINT AS most FROM lineitem GROUP BY 1")
def _(t):
    return G.demand_fold(t.lineitem.select(F.col("l_suppkey").cast("string").alias("edge"), F.col("l_quantity").cast("long").alias("target"), F.col("l_linenumber").cast("long").alias("most")))


@query("l11_enrolled", "SELECT user_id AS member FROM events GROUP BY 1 HAVING arg_max(event_type <> 'error', event_id)")
def _(t):
    log = t.events.select(F.col("event_id").alias("idx"), F.col("user_id").alias("member"), (F.col("event_type") != "error").alias("enrolled"))
    return G.enrolled_at(log, log.agg(F.max("idx")).first()[0] or 0)  # as of the log's last index


@query("l11_enrolled_log", """WITH c AS (SELECT q, max(event_id) * q // 4 AS upto FROM events, range(1, 5) r(q) GROUP BY q)
SELECT q::INTEGER AS quarter, user_id AS member FROM events JOIN c ON event_id <= upto GROUP BY q, user_id HAVING arg_max(event_type <> 'error', event_id)""")
def _(t):
    last = t.events.agg(F.max("event_id")).first()[0] or 0  # one row
    log = t.events.select(F.col("event_id").alias("idx"), F.col("user_id").alias("member"), (F.col("event_type") != "error").alias("enrolled"))
    return L.piece(*(G.enrolled_at(log, last * q // 4).select(F.lit(q).alias("quarter"), "member") for q in range(1, 5)))


@query("l13_health", "SELECT event_type, count(*) FILTER (event_id % 5 = 0) AS accepted, count(*) FILTER (event_id % 5 = 1) AS failed, count(*) FILTER (event_id % 5 = 2) AS dropped, count(*) FILTER (event_id % 5 = 3) AS refused, count(*) FILTER (event_id % 5 = 4) AS deduplicated FROM events GROUP BY 1")
def _(t):
    names = F.array(*map(F.lit, ("accepted", "failed", "dropped", "refused", "deduplicated")))
    return T.health(t.events.withColumn("outcome", F.get(names, (F.col("event_id") % 5).cast("int"))), ["event_type"])


@query("l14_durability", "SELECT event_type, min(event_id) AS from_offset, max(event_id) AS to_offset FROM events WHERE event_id % 11 = 0 GROUP BY 1")
def _(t):
    return T.failed_range(t.events.select("event_type", F.col("event_id").alias("offset"), F.when(F.col("event_id") % 11 == 0, "failed").otherwise("accepted").alias("outcome")), ["event_type"])


@query("l17_roster", "SELECT user_id FROM events GROUP BY 1 HAVING arg_max(event_type <> 'error', event_id)")
def _(t):
    return T.roster(t.events.select("user_id", "event_id", (F.col("event_type") != "error").alias("present")), "user_id", ["event_id"])


@query("l18_elect_host", "SELECT min(s_name) AS host FROM supplier")
def _(t):
    return t.supplier.agg(F.min("s_name").alias("host"))


_FENCED = f"{_CUST}, fz AS (SELECT *, n_nationkey % 5 AS g, 'e-n-' || n_name AS edge FROM cu)"


def ledger_finals(t: Tables) -> DataFrame:
    """Last slots of each nation's edge, which '<edge>-2' follows. By nation: transfers, net negative, uncovered, drained, sound."""
    g, c = F.col("n_nationkey") % 5, ledger_counters(t).groupBy("edge", "replica").pivot("kind", ["issued", "returned", "leaf"]).agg(F.max("amount"))
    n = t.nation.select("n_nationkey", F.concat(F.lit("e-n-"), "n_name").alias("edge"))
    return c.join(n, "edge").select(
        F.concat("edge", F.lit("-2")).alias("live"), "edge", "replica", "issued", F.when(g == 1, 3 * F.col("issued")).when(g == 3, F.col("issued")).otherwise(F.col("returned")).alias("returned"),
        F.when(g == 2, 3 * F.col("leaf")).when(g == 3, 0).otherwise(F.col("leaf")).cast("long").alias("leaf"), F.lit(0).cast("long").alias("rollup"))


def _relocating(t: Tables):
    standing = t.nation.select(F.concat(F.lit("e-n-"), "n_name", F.lit("-2")).alias("edge"), F.lit("r0").alias("replica"), F.lit("issued_in").alias("kind"), F.lit(10).cast("long").alias("amount"))
    moved = t.nation.filter("n_nationkey % 5 = 0").select(F.concat(F.lit("e-n-"), "n_name").alias("path"), F.lit("r0").alias("sender"), F.lit("r1").alias("receiver"), F.lit(1).cast("long").alias("amount"))
    return ledger_finals(t), standing, moved


@query("l7_outcomes", f"WITH {_FENCED} SELECT DISTINCT edge || '-2' AS live, CASE g WHEN 3 THEN 'nothing' WHEN 4 THEN 'moved' ELSE 'refused' END AS outcome, CASE g WHEN 0 THEN 'transfers' WHEN 1 THEN 'net negative' WHEN 2 THEN 'uncovered' END AS reason FROM fz")
def _(t):
    return G.relocation_outcomes(*_relocating(t))


@query("l7_relocation", f"""WITH {_FENCED}, m AS (SELECT * FROM fz WHERE g = 4)
SELECT edge, rep AS replica, unnest(['returned', 'issued', 'leaf', 'rollup', 'issued_in', 'leaf_in', 'rollup_in', 'leaf_out', 'rollup_out']) AS kind, unnest([2 * c, 2 * c, c, 0, 0, 0, 0, c, 0])::BIGINT AS amount FROM m
UNION ALL SELECT edge || '-2', rep, unnest(['issued_in', 'leaf_in', 'rollup_in']), unnest([2 * c - ret + if(rep = 'r0', 10, 0), c, 0])::BIGINT FROM m""")
def _(t):
    return G.relocation_patch(*_relocating(t))


@query("w11_settle_joiners", """WITH c AS (SELECT c_nationkey AS parent, c_custkey AS edge, c_custkey % 5 + 1 AS w, c_custkey % 17 AS i, c_custkey % 4 < 2 AS dem, c_custkey % 7 = 0 AS fresh, c_custkey % 4 < 2 AND c_custkey % 3 = 0 AS wakes FROM customer),
f AS (SELECT parent, count(*) FILTER (dem) AS k, sum(i) FILTER (dem) AS sn, sum(w) FILTER (dem) AS sd, arg_max({'i': i, 'w': w}, i / w) AS top FROM c WHERE NOT fresh AND NOT wakes GROUP BY 1),
g AS (SELECT parent, (CASE WHEN k > 0 THEN sn ELSE top.i END)::BIGINT AS n, (CASE WHEN k > 0 THEN sd ELSE top.w END)::BIGINT AS d FROM f),
x AS (SELECT parent, edge, fresh, CASE WHEN coalesce(n * w > i * d, FALSE) THEN n ELSE i END AS sn, CASE WHEN coalesce(n * w > i * d, FALSE) THEN d ELSE w END AS sd,
  CASE WHEN wakes AND coalesce(n * w > i * d, FALSE) THEN n * w - i * d ELSE 0 END AS o, CASE WHEN wakes AND coalesce(n * w > i * d, FALSE) THEN d * w ELSE 1 END AS od FROM c LEFT JOIN g USING (parent))
SELECT parent, edge, CASE WHEN fresh THEN (sn // gcd(sn, sd))::BIGINT END AS seat_num, CASE WHEN fresh THEN (sd // gcd(sn, sd))::BIGINT END AS seat_den, (o // gcd(o, od))::BIGINT AS offset_num, (od // gcd(o, od))::BIGINT AS offset_den FROM x""")
def _(t):
    return G.settle_joiners(joining(t))


def joining(t: Tables) -> DataFrame:
    """Customers as children of their nation: some newborn, some waking, some idle."""
    k = F.col("c_custkey")
    long = lambda c: F.lit(c).cast("long") if isinstance(c, int) else c.cast("long")
    return t.customer.select(
        F.col("c_nationkey").alias("parent"), k.alias("edge"), long(k % 5 + 1).alias("weight_num"), long(1).alias("weight_den"), long(k % 17).alias("issued"), long(k % 4).alias("outstanding"), long(2).alias("target"),
        (k % 7 != 0).alias("seated"), (k % 3 != 0).alias("was_demanding"), long(0).alias("offset_num"), long(1).alias("offset_den"))


@query("w9_schedule")
def _(t):
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    children = n.select(
        F.col("r_name").alias("parent"), F.col("n_name").alias("edge"), (F.col("n_nationkey") % 3 + 1).cast("long").alias("weight_num"), F.lit(2).cast("long").alias("weight_den"), F.col("n_nationkey").cast("long").alias("service"),
        F.lit(0).cast("long").alias("outstanding"), F.lit(20).cast("long").alias("target"), F.lit(7).cast("long").alias("most"), F.lit(60).cast("long").alias("held"))
    return G.schedule(children, quantum=5, cap=15)


@query("w12_speculation", """WITH e AS (SELECT event_id % 50 AS session, event_id AS id, user_id AS client, (event_id * 7) % 101 AS request, event_id % 3 = 0 AS proposed FROM events),
c AS (SELECT *, client IS NULL OR request > coalesce(max(request) OVER (PARTITION BY session, client ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS fresh FROM e WHERE NOT proposed),
a AS (SELECT session, -coalesce(sum(id) FILTER (fresh), 0) AS v, count(*) AS n FROM c GROUP BY 1), p AS (SELECT session, sum(id) AS v, count(*) AS n FROM e WHERE proposed GROUP BY 1)
SELECT session, coalesce(a.v, 0)::BIGINT AS authoritative, (coalesce(a.v, 0) + coalesce(p.v, 0))::BIGINT AS speculative, coalesce(p.n, 0) AS pending, coalesce(a.n, 0) AS confirmed FROM a FULL JOIN p USING (session)""")
def _(t):
    i = F.col("event_id")
    return X.speculate(t.events.select(
        (i % 50).alias("session"), i.alias("idx"), F.when(i % 3 == 0, "propose").otherwise("commit").alias("kind"), F.col("user_id").alias("client"), (i * 7 % 101).alias("request"),
        F.when(i % 3 == 0, i).otherwise(-i).cast("long").alias("action")), 0, lambda state, action: state + action)


# ---- sketches -------------------------------------------------------------------------------------------------


@query("k1_hll_error", "SELECT event_type, TRUE AS within FROM events GROUP BY 1")
def _(t):
    est = K.hll_estimate(K.hll_merge(K.hll_registers(t.events, ["event_type", F.lit(1).alias("one")][:1], "event_id", 12), ["event_type"]), ["event_type"], 12)
    real = t.events.groupBy("event_type").agg(F.countDistinct("event_id").alias("n"))
    return est.join(real, "event_type").select("event_type", (F.abs(F.col("estimate") - F.col("n")) <= 0.08 * F.col("n")).alias("within"))


@query("k2_cms_bounds", "SELECT DISTINCT user_id, TRUE AS at_least FROM events")
def _(t):
    a = K.cms_cells(t.events.filter("event_id % 2 = 0"), [], "user_id", 2048, 5)
    b = K.cms_cells(t.events.filter("event_id % 2 = 1"), [], "user_id", 2048, 5)
    one = t.events.groupBy("user_id").agg(F.sum((F.col("event_id") % 2).cast("long")).alias("odd"), F.count("*").alias("n")).withColumn("most", F.greatest("odd", F.col("n") - F.col("odd")))
    est = K.cms_estimate(K.cms_merge(L.piece(a, b), []), one.select("user_id"), "user_id", 2048, 5)
    return est.join(one, "user_id").select("user_id", (F.col("estimate") >= F.col("most")).alias("at_least"))


@query("k3_bloom_members", "SELECT DISTINCT user_id, TRUE AS contains FROM events")
def _(t):
    bits, hashes = K.bloom_size(20_000, 0.01)
    words = K.bloom_words(t.events, [], "user_id", bits, hashes)
    return K.bloom_contains(words, t.events.select("user_id").distinct(), "user_id", bits, hashes)


@query("k1_hll_registers", f"SELECT event_type, (h >> 20)::INTEGER AS idx, max(21 - CASE WHEN h & 1048575 = 0 THEN 0 ELSE floor(log2(h & 1048575))::INTEGER + 1 END)::INTEGER AS rho FROM (SELECT event_type, {_murmur_sql('event_id::VARCHAR', 0)} AS h FROM events) GROUP BY ALL")
def _(t):
    a, b = (K.hll_registers(t.events.filter(f"event_id % 3 {op} 0"), ["event_type"], "event_id", 12) for op in ("=", "<>"))
    return K.hll_merge(L.piece(a, b), ["event_type"])


@query("k2_cms_cells", " UNION ALL ".join(f"SELECT row, col, max(n) AS count FROM (SELECT {i} AS row, {_murmur_sql('user_id::VARCHAR', i)} % 512 AS col, event_id % 2 AS w, count(*) AS n FROM events GROUP BY ALL) GROUP BY ALL" for i in range(3)))
def _(t):
    a, b = (K.cms_cells(t.events.filter(f"event_id % 2 = {w}"), [], "user_id", 512, 3) for w in (0, 1))
    return K.cms_merge(L.piece(a, b), [])


@query("k3_bloom_bits", f"SELECT DISTINCT (a + i * b) % 9586 AS bit FROM (SELECT {_murmur_sql('u::VARCHAR', 0)} AS a, {_murmur_sql('u::VARCHAR', 1)} AS b FROM (SELECT DISTINCT user_id AS u FROM events)), range(7) r(i)")
def _(t):
    bits, hashes = K.bloom_size(1000, 0.01)
    words = K.bloom_words(t.events, [], "user_id", bits, hashes)
    at = F.filter(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda j: F.when(F.getbit("bits", j) == 1, j)), lambda j: j.isNotNull())
    return words.select("word", F.explode(at).alias("at")).select((F.col("word") * 64 + F.col("at")).alias("bit"))


_GAMMA = "1.01 / 0.99"


@query("k4_ddsketch_cells", f"SELECT c_mktsegment, CASE WHEN abs(c_acctbal) < 1e-9 THEN '0' WHEN c_acctbal > 0 THEN '+' ELSE '-' END AS part, CASE WHEN abs(c_acctbal) < 1e-9 THEN 0 ELSE ceil(ln(abs(c_acctbal)) / ln({_GAMMA}))::INTEGER END AS idx, count(*) AS count, 0::BIGINT AS overflow FROM customer GROUP BY ALL")
def _(t):
    return K.dd_cells(t.customer, ["c_mktsegment"], "c_acctbal")


@query("w5_ddsketch_quantile", f"""WITH c AS (SELECT event_type, ceil(ln(value) / ln({_GAMMA}))::INTEGER AS idx, count(*) AS n FROM events WHERE value >= 1e-9 GROUP BY ALL),
z AS (SELECT event_type, count(*) AS n FROM events WHERE value < 1e-9 GROUP BY 1),
a AS (SELECT event_type, 0 AS p, 0 AS idx, n FROM z UNION ALL SELECT event_type, 1, idx, n FROM c),
r AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY p, idx) AS cum, sum(n) OVER (PARTITION BY event_type) AS tot FROM a)
SELECT event_type, q, round(arg_min(CASE WHEN p = 0 THEN 0.0 ELSE 2 * pow({_GAMMA}, idx) / (1 + {_GAMMA}) END, (p, idx)), 6) AS value FROM r, (VALUES (0.0::DOUBLE), (0.5), (0.9), (0.99), (1.0)) v(q) WHERE cum > q * (tot - 1) GROUP BY ALL""")
def _(t):
    cells = K.dd_cells(t.events, ["event_type"], "value")
    return K.dd_quantiles(cells, ["event_type"], [0.0, 0.5, 0.9, 0.99, 1.0]).select("event_type", "q", F.round("value", 6).alias("value"))


@query("k5_histogram", "SELECT p_brand, CASE WHEN p_size <= 5 THEN 0 WHEN p_size <= 10 THEN 1 WHEN p_size <= 25 THEN 2 ELSE 3 END AS bucket, count(*) AS count, sum(p_size)::DOUBLE AS sum FROM part GROUP BY ALL")
def _(t):
    return K.histogram(t.part, ["p_brand"], "p_size", [5, 10, 25])


@query("k6_op_cardinality", "SELECT event_type AS op, TRUE AS within FROM events GROUP BY 1")
def _(t):
    est = K.hll_estimate(K.hll_registers(t.events.withColumnRenamed("event_type", "op"), ["op"], "user_id"), ["op"])
    real = t.events.groupBy(F.col("event_type").alias("op")).agg(F.countDistinct("user_id").alias("n"))
    return est.join(real, "op").select("op", (F.abs(F.col("estimate") - F.col("n")) <= 1 + 0.04 * F.col("n")).alias("within"))


@query("k7_exponential_histogram", f"""WITH c AS (SELECT event_type, ceil(ln(value) / ln({_GAMMA}))::INTEGER AS idx, count(*) AS n FROM events WHERE value >= 1e-9 GROUP BY ALL),
s AS (SELECT event_type, lo, unnest(range(lo, hi + 1)) AS idx FROM (SELECT event_type, min(idx) AS lo, max(idx) AS hi FROM c GROUP BY 1))
SELECT s.event_type, (min(lo) - 1)::INTEGER AS \"offset\", array_to_string(list(coalesce(n, 0) ORDER BY s.idx), ',') AS counts FROM s LEFT JOIN c ON c.event_type = s.event_type AND c.idx = s.idx GROUP BY 1""")
def _(t):
    h = K.exponential_histogram(K.dd_cells(t.events, ["event_type"], "value"), ["event_type"])
    return h.select("event_type", "offset", F.array_join(F.transform("counts", lambda x: x.cast("string")), ",").alias("counts"))


# ---- ordered computations, sorts, sets ------------------------------------------------------------------------


@query("w1_last_visible", "SELECT user_id, event_id FROM (SELECT user_id, event_id, coalesce(sum((event_type <> 'error')::INTEGER) OVER (PARTITION BY user_id ORDER BY event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM events) WHERE a < 3")
def _(t):
    return P.last_visible(t.events.select("user_id", "event_id", (F.col("event_type") != "error").alias("visible")), ["user_id"], "event_id", 3).select("user_id", "event_id")


@query("w2_contiguous", f"WITH {DOTTED}, s AS (SELECT replica, seq FROM dotted WHERE seq > 20 AND seq % 89 <> 0), g AS (SELECT *, row_number() OVER (PARTITION BY replica ORDER BY seq) AS n FROM s) SELECT replica, max(seq) AS upto FROM g WHERE seq - n = 20 GROUP BY 1")
def _(t):
    floors = t.rows([(f"r{i}", 20) for i in range(4)], "replica string, floor long")
    return C.contiguous(dotted(t).filter("seq % 89 <> 0"), floors)


@query("w3_stable_cut", f"WITH {_VECTORS}, n AS (SELECT count(DISTINCT peer) AS n FROM vv) SELECT replica, CASE WHEN count(DISTINCT peer) = any_value(n.n) THEN min(upto) ELSE 0 END AS cut, max(upto) AS frontier FROM vv, n GROUP BY 1")
def _(t):
    v = vectors(t)
    low = L.vv_floor(v, [], "peer", v.select("peer").distinct().count()).withColumnRenamed("upto", "cut")
    return L.vv_ceil(v, []).withColumnRenamed("upto", "frontier").join(low, "replica", "left").select("replica", F.coalesce("cut", F.lit(0)).alias("cut"), "frontier")


@query("w4_universal_ack", "SELECT min(coalesce(a, 0)) AS acked FROM (SELECT s_suppkey, max(l_orderkey) AS a FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_returnflag = 'N' GROUP BY 1)")
def _(t):
    return C.universal_ack(t.supplier.select(F.col("s_suppkey").alias("peer")), t.lineitem.filter("l_returnflag = 'N'").select(F.col("l_suppkey").alias("peer"), F.col("l_orderkey").alias("acked")))


@query("w6_drop_oldest", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 5")
def _(t):
    return T.capped(t.events.select("user_id", "event_id"), ["user_id"], ["event_id"], 5, "newest")


@query("w6_drop_newest", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n <= 5")
def _(t):
    return T.capped(t.events.select("user_id", "event_id"), ["user_id"], ["event_id"], 5, "oldest")


@query("w7_first_by_id", "SELECT event_id // 3 AS record_id, min(event_id) AS event_id FROM events GROUP BY 1")
def _(t):
    return T.first_by_id(t.events.select(F.expr("event_id div 3").alias("record_id"), "event_id"), "record_id", ["event_id"])


@query("t3_ring", f"WITH {_points_sql()} SELECT position, peer FROM pts")
def _(t):
    return P.ring_points(t.supplier.select(F.col("s_name").alias("peer"))).orderBy("position")


@query("t1_span_links", f"""WITH {DOTTED}, l AS (
SELECT DISTINCT a.event_id AS from_span, b.event_id AS to_span FROM dotted a JOIN dotted b ON a.replica = b.replica AND b.seq IN (a.seq - 1, a.seq - 3)
WHERE (CASE WHEN a.event_id % 4 <> 0 THEN a.event_id - 1 END) IS DISTINCT FROM b.event_id)
SELECT from_span, array_to_string(list(to_span ORDER BY to_span), ',') AS links FROM l GROUP BY 1""")
def _(t):
    links = T.sorted_links(T.causal_links(spans(t)))
    return links.select("from_span", F.array_join(F.transform("links", lambda x: x.cast("string")), ",").alias("links"))


@query("t4_winner", "SELECT p_brand, arg_max(p_name, (p_retailprice, p_name)) AS best FROM part GROUP BY 1")
def _(t):
    return t.part.groupBy("p_brand").agg(F.max_by("p_name", F.struct("p_retailprice", "p_name")).alias("best"))


@query("t5_peer_sample", "SELECT s_name AS peer FROM supplier ORDER BY md5(s_name || '|7'), s_name LIMIT 7")
def _(t):
    return P.sample_peers(t.supplier.select(F.col("s_name").alias("peer")), 7, 7)


@query("u1_union", "SELECT DISTINCT user_id FROM events WHERE event_type IN ('click', 'error')")
def _(t):
    e = t.events
    return L.gset(e.filter("event_type = 'click'").select("user_id"), e.filter("event_type = 'error'").select("user_id"))


@query("u2_difference", "SELECT l_orderkey FROM lineitem EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
def _(t):
    return t.lineitem.select("l_orderkey").subtract(t.lineitem.filter("l_returnflag = 'R'").select("l_orderkey"))


@query("u3_intersection", "SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'error'")
def _(t):
    return t.events.filter("event_type = 'click'").select("user_id").intersect(t.events.filter("event_type = 'error'").select("user_id"))


@query("u5_combine", "SELECT 'docs' AS plan, count(*) AS n FROM documents WHERE lang = 'en' UNION ALL SELECT 'lines', count(*) FROM lineitem")
def _(t):
    r = pipeline_registry(t)
    a, b = r.lower(D.Draft.shuttle("docs").filter("english").combine(D.Draft.shuttle("lines")))
    return a.agg(F.lit("docs").alias("plan"), F.count("*").alias("n")).unionByName(b.agg(F.lit("lines").alias("plan"), F.count("*").alias("n")))


# ---- sequences, trees, documents ------------------------------------------------------------------------------


def line_ops(t: Tables) -> DataFrame:
    """Each order is a document that two replicas appended to; returned lines are removed again."""
    li = t.lineitem.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("long").alias("n"), F.col("l_partkey").cast("string").alias("value"), "l_returnflag")
    li = li.groupBy("doc", "n").agg(F.min("value").alias("value"), F.min("l_returnflag").alias("l_returnflag"))
    prev = Window.partitionBy("doc").orderBy("n")
    rep = lambda n: F.concat(F.lit("r"), (n % 2).cast("string"))
    p = F.lag("n").over(prev)
    ins = li.withColumn("p", p).select("doc", F.lit("insert").alias("kind"), F.col("n").alias("lamport"), rep(F.col("n")).alias("replica"), F.col("n").alias("seq"), F.col("p").alias("after_lamport"), F.when(F.col("p").isNotNull(), rep(F.col("p"))).alias("after_replica"), F.col("p").alias("after_seq"), "value")
    none = F.lit(None)
    rem = li.filter("l_returnflag = 'R'").select("doc", F.lit("remove").alias("kind"), F.col("n").alias("lamport"), rep(F.col("n")).alias("replica"), F.col("n").alias("seq"), none.cast("long").alias("after_lamport"), none.cast("string").alias("after_replica"), none.cast("long").alias("after_seq"), none.cast("string").alias("value"))
    return L.piece(ins, rem)


_SIDES = "li AS (SELECT l_orderkey AS doc, l_linenumber::BIGINT AS n, min(l_partkey::VARCHAR) AS value, min(l_returnflag) <> 'R' AS visible FROM lineitem GROUP BY 1, 2), sd AS (SELECT *, min(n) OVER (PARTITION BY doc, n % 2) AS head FROM li)"


def concurrent_ops(t: Tables) -> DataFrame:
    """Each order is a document to which two replicas appended at the same time, each its own chain from the head: odd lines and even ones."""
    ops = line_ops(t)
    own = Window.partitionBy("doc", "kind", "replica").orderBy("lamport")
    after = lambda c: F.when(F.col("kind") == "insert", F.lag(c).over(own))
    return ops.withColumns({"after_lamport": after("lamport"), "after_replica": after("replica"), "after_seq": after("seq")})


@query("q1_rga", f"WITH {_SIDES} SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY head DESC, n) - 1 AS pos, value, visible FROM sd")
def _(t):
    ops = concurrent_ops(t)
    return Q.rga_materialize(Q.oplog_merge(ops.filter("seq % 2 = 0"), ops))


@query("q2_oplog_merge", """WITH li AS (SELECT l_orderkey AS doc, l_linenumber::BIGINT AS n, min(l_returnflag) AS f FROM lineitem GROUP BY 1, 2), k AS (SELECT *, f = 'R' AND n % 3 = 0 AS gone FROM li)
SELECT doc, unnest(CASE WHEN gone THEN ['compact'] WHEN f = 'R' THEN ['insert', 'remove'] ELSE ['insert'] END) AS kind, n AS lamport, 'r' || (n % 2) AS replica, n AS seq FROM k""")
def _(t):
    ops = line_ops(t)
    compacts = ops.filter("kind = 'remove' and seq % 3 = 0").withColumn("kind", F.lit("compact"))
    return Q.oplog_merge(ops, ops.filter("seq % 2 = 0").unionByName(compacts), compacts).select("doc", "kind", "lamport", "replica", "seq")


_ENDS = "li AS (SELECT l_orderkey AS doc, l_linenumber::BIGINT AS n, min(l_returnflag) AS f FROM lineitem GROUP BY 1, 2), nx AS (SELECT *, lead(n) OVER (PARTITION BY doc ORDER BY n) AS nxt FROM li)"


@query("q3_insert_at", f"WITH {_ENDS}, v AS (SELECT doc, min(n) AS f1 FROM li WHERE f <> 'R' GROUP BY doc) SELECT doc, max(n) + 1 AS lamport, 'r0' AS replica, coalesce(max(n) FILTER (n % 2 = 0), 0) + 1 AS seq, any_value(f1) AS after_lamport, any_value(f1) AS after_seq FROM li JOIN v USING (doc) GROUP BY doc")
def _(t):
    ops = line_ops(t)
    gone = ops.filter("kind = 'remove'").select("doc", "seq")
    some = ops.filter("kind = 'insert'").join(gone, ["doc", "seq"], "left_anti").select("doc").distinct()
    return Q.insert_at(ops, some.select("doc", F.lit(1).alias("index"), F.lit("new").alias("value")), "r0").select("doc", "lamport", "replica", "seq", "after_lamport", "after_seq")


@query("q3_remove_at", f"WITH {_ENDS}, v AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY n) - 1 AS place FROM li WHERE f <> 'R') SELECT doc, n AS lamport, 'r' || (n % 2) AS replica, n AS seq FROM v WHERE place = 1")
def _(t):
    ops = line_ops(t)
    return Q.remove_at(ops, ops.select("doc", F.lit(1).alias("index"))).select("doc", "lamport", "replica", "seq")


@query("q2_merge_floor", """WITH li AS (SELECT l_orderkey AS doc, l_linenumber::BIGINT AS n, min(l_returnflag) AS f FROM lineitem GROUP BY 1, 2), k AS (SELECT * FROM li WHERE n > CASE WHEN doc % 2 = 1 THEN 0 WHEN n % 2 = 1 THEN 3 ELSE 2 END)
SELECT doc, unnest(CASE WHEN f = 'R' THEN ['insert', 'remove'] ELSE ['insert'] END) AS kind, n AS lamport, 'r' || (n % 2) AS replica, n AS seq FROM k""")
def _(t):
    ops = line_ops(t)
    # even documents: one side has forgotten up to r0:2 and r1:1, the other up to r1:3
    even = ops.filter("doc % 2 = 0").select("doc").distinct()
    floor = lambda r, n: even.select("doc", F.lit(r).alias("replica"), F.lit(n).cast("long").alias("upto"))
    floors = L.piece(floor("r0", 2), floor("r1", 1), floor("r1", 3))
    return Q.oplog_merge(ops, ops.filter("seq % 2 = 0"), floors=floors).select("doc", "kind", "lamport", "replica", "seq")


@query("q4_compactable", f"WITH {_ENDS}, b AS (SELECT *, lag(n) OVER (PARTITION BY doc ORDER BY n) AS before FROM nx) SELECT doc, 'compact' AS kind, n AS lamport, 'r' || (n % 2) AS replica, n AS seq, before AS after_lamport, 'r' || (before % 2) AS after_replica, before AS after_seq FROM b WHERE f = 'R' AND nxt IS NULL AND n <= CASE n % 2 WHEN 0 THEN 6 ELSE 5 END")
def _(t):
    return Q.compactable(line_ops(t), t.rows([("r0", 6), ("r1", 5)], "replica string, upto long"))


@query("q4_frontier", f"WITH {_ENDS} SELECT doc, n AS lamport, 'r' || (n % 2) AS replica, n AS seq FROM nx WHERE f = 'R' AND nxt IS NULL AND doc % 3 <> 0")
def _(t):
    ops = line_ops(t)
    known = ops.groupBy("doc", "replica").agg(F.max("seq").alias("upto"))
    # every third document knows of an op of r1 that has not come yet
    coming = known.select("doc").distinct().filter("doc % 3 = 0").select("doc", F.lit("r1").alias("replica"), F.lit(99).cast("long").alias("upto"))
    return Q.compactable(ops, known, L.piece(known, coming), known).select("doc", "lamport", "replica", "seq")


@query("q6_reroot", f"WITH {_SIDES}, k AS (SELECT doc, n, value, min(n) OVER (PARTITION BY doc, n % 2) AS head FROM sd WHERE visible) SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY head DESC, n) - 1 AS pos, value FROM k")
def _(t):
    ops = concurrent_ops(t)
    inserts, removes = ops.filter("kind = 'insert'"), ops.filter("kind = 'remove'").select("doc", "lamport", "replica", "seq")
    compacts = inserts.join(removes, ["doc", "lamport", "replica", "seq"], "left_semi").withColumns({"kind": F.lit("compact"), "value": F.lit(None).cast("string")})
    # what came after the compacted elements hangs from the nearest one that is kept
    return Q.rga_materialize(Q.oplog_merge(ops, compacts)).select("doc", "pos", "value")


@query("q5_drop_window", f"""WITH {_ENDS}, fl AS (SELECT doc, CASE WHEN NOT bool_or(n = 1) THEN 0 WHEN doc % 2 = 0 THEN CASE WHEN bool_or(n = 3) THEN 3 ELSE 2 END ELSE 1 END AS upto FROM li WHERE n <= 4 GROUP BY doc)
SELECT doc, 'floor' AS kind, NULL::BIGINT AS lamport, 'r1' AS replica, upto::BIGINT AS seq FROM fl WHERE upto > 0
UNION ALL SELECT doc, 'compact', n, 'r' || (n % 2), n FROM li JOIN fl USING (doc) WHERE n <= 4 AND NOT (n % 2 = 1 AND n <= upto)""")
def _(t):
    ops = line_ops(t)
    ident = ["doc", "lamport", "replica", "seq"]
    gone = ops.filter("doc % 2 = 0").groupBy("doc").agg(F.lit("compact").alias("kind")).select("doc", "kind", F.lit(9).cast("long").alias("lamport"), F.lit("r1").alias("replica"), F.lit(2).cast("long").alias("seq"))
    held = ops.select(*ident, "kind").unionByName(gone)
    return Q.drop_window(held, ops.filter("kind = 'insert' and seq <= 4").select(*ident), "r1", t.rows([], "doc long, upto long"))


@query("q7_fugue", "SELECT conv_id AS doc, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, turn::VARCHAR AS value, turn % 5 <> 4 AS visible FROM (SELECT DISTINCT conv_id, turn FROM conversations)")
def _(t):
    c = t.conversations.select("conv_id", "turn").distinct()
    p = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    null = lambda k: F.lit(None).cast(k)
    base = c.withColumn("p", p)
    ins = base.select(F.col("conv_id").alias("doc"), F.lit("insert").alias("kind"), F.lit("r").alias("replica"), F.col("turn").alias("seq"), F.when(F.col("p").isNotNull(), "r").alias("parent_replica"), F.col("p").alias("parent_seq"), F.lit("R").alias("side"), null("string").alias("right_replica"), null("long").alias("right_seq"), F.col("turn").cast("string").alias("value"))
    rem = base.filter("turn % 5 = 4").select(F.col("conv_id").alias("doc"), F.lit("remove").alias("kind"), F.lit("r").alias("replica"), F.col("turn").alias("seq"), null("string").alias("parent_replica"), null("long").alias("parent_seq"), null("string").alias("side"), null("string").alias("right_replica"), null("long").alias("right_seq"), null("string").alias("value"))
    return Q.fugue_materialize(L.piece(ins, rem))


@query("q7_fugue_bushy", """WITH RECURSIVE c AS (SELECT DISTINCT conv_id AS doc, turn::BIGINT AS turn, dense_rank() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations),
p AS (SELECT doc, turn, i, '' AS path FROM c WHERE i = 0 UNION ALL SELECT c.doc, c.turn, c.i, p.path || (ARRAY['0', '1', '4', '3'])[(c.i - 1) % 4 + 1] FROM c JOIN p ON p.doc = c.doc AND p.i = (c.i - 1) // 4 AND c.i > 0)
SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY path || '2') - 1 AS pos, turn::VARCHAR AS value, TRUE AS visible FROM p""")
def _(t):
    # a tree of four children a node: two to the left, by id upwards, and two to the right with one right origin, by id downwards
    c = t.conversations.select("conv_id", "turn").distinct().withColumn("i", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long") - 1)
    up = F.when(F.col("i") > 0, F.floor((F.col("i") - 1) / 4).cast("long"))
    null = lambda k: F.lit(None).cast(k)
    side = F.when((F.col("i") - 1) % 4 < 2, "L").otherwise("R")
    return Q.fugue_materialize(c.select(F.col("conv_id").alias("doc"), F.lit("insert").alias("kind"), F.lit("r").alias("replica"), F.col("i").alias("seq"), F.when(up.isNotNull(), "r").alias("parent_replica"), up.alias("parent_seq"), side.alias("side"), null("string").alias("right_replica"), null("long").alias("right_seq"), F.col("turn").cast("string").alias("value")))


@query("q8_movable_tree", """WITH n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS i, lead(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_name) AS other FROM nation)
SELECT 'r' || n_regionkey AS tree, n_name AS node, CASE WHEN i % 2 = 1 AND other IS NOT NULL THEN other ELSE 'region' || n_regionkey END AS parent FROM n""")
def _(t):
    order = Window.partitionBy("n_regionkey").orderBy("n_name")
    n = t.nation.withColumns({"i": F.row_number().over(order), "other": F.lead("n_name").over(order), "before": F.lag("n_name").over(order)})
    first = n.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("tree"), F.lit(1).cast("long").alias("ts"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0").alias("replica"), F.lit(1).cast("long").alias("seq"), F.col("n_name").alias("node"), F.concat(F.lit("region"), F.col("n_regionkey").cast("string")).alias("new_parent"), F.lit("v").alias("value"), "i", "other", "before")
    # A under B, then B under A at the same time elsewhere: the later one would close a cycle and is skipped, as a node under itself is
    under = first.filter("i % 2 = 1 and other is not null").withColumns({"ts": F.lit(2).cast("long"), "new_parent": F.col("other")})
    back = first.filter("i % 2 = 0").withColumns({"ts": F.lit(3).cast("long"), "new_parent": F.col("before")})
    own = first.withColumns({"ts": F.lit(4).cast("long"), "new_parent": F.col("node")})
    every = L.piece(first.drop("i", "other", "before"), *(x.drop("i", "other", "before") for x in (under, back, own)))
    return Q.tree_replay(every).select("tree", "node", "parent")


def tree_moves(t: Tables) -> DataFrame:
    """A tree of three children a node for each nation's customers, made at i, then moved to the top at 10000 + i (odd i) and, i % 4 = 1, back at 20000 + i."""
    order = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    n = t.customer.select(F.col("c_nationkey").alias("tree"), (F.row_number().over(order) - 1).cast("long").alias("i"))
    up = F.when(F.col("i") == 0, "root").otherwise(F.floor((F.col("i") - 1) / 3).cast("string"))
    move = lambda rows, ts, replica, parent, value: rows.select("tree", (F.col("i") + ts).alias("ts"), F.lit(replica).alias("replica"), (F.col("i") + 1).alias("seq"), F.col("i").cast("string").alias("node"), parent.alias("new_parent"), value.cast("string").alias("value"))
    return L.piece(
        move(n, 0, "a", up, F.col("i")), move(n.filter("i % 2 = 1"), 10_000, "b", F.lit("root"), F.lit(None)), move(n.filter("i % 4 = 1"), 20_000, "c", up, F.lit(None)),
    )


_TREE = """n AS (SELECT c_nationkey AS tree, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i FROM customer),
e AS (SELECT tree, i, CASE WHEN i = 0 OR i % 4 = 3 THEN -1 ELSE (i - 1) // 3 END AS up FROM n),
p AS (SELECT tree, i, up, 1 AS depth FROM e UNION ALL SELECT p.tree, p.i, e.up, p.depth + 1 FROM p JOIN e ON e.tree = p.tree AND e.i = p.up WHERE p.up >= 0)"""


@query("p11_tree", f"""WITH RECURSIVE {_TREE}, d AS (SELECT tree, i, max(depth) AS depth FROM p GROUP BY ALL), b AS (SELECT tree, up AS i, count(*) AS below FROM p GROUP BY ALL), c AS (SELECT tree, up AS i, count(*) AS children FROM e GROUP BY ALL)
SELECT tree, i::VARCHAR AS node, CASE WHEN up < 0 THEN 'root' ELSE up::VARCHAR END AS parent, depth::BIGINT AS depth, coalesce(below, 0)::BIGINT AS below, coalesce(children, 0)::BIGINT AS children, TRUE AS rooted, i::VARCHAR AS value
FROM e JOIN d USING (tree, i) LEFT JOIN b USING (tree, i) LEFT JOIN c USING (tree, i)""")
def _(t):
    placed = Q.tree_replay(tree_moves(t))
    spans = Q.tree_spans(placed, "root")
    n = F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("children")
    return (
        spans.join(Q.children_of(spans), ["tree", "node"], "left").join(placed.select("tree", "node", "value"), ["tree", "node"])
        .select("tree", "node", "parent", "depth", (F.col("leave") - F.col("enter")).alias("below"), n, "rooted", "value")
    )


@query("p11_is_ancestor", f"""WITH RECURSIVE {_TREE}, q AS (SELECT tree, i // 5 AS a, i AS d FROM n)
SELECT tree, a::VARCHAR AS ancestor, d::VARCHAR AS descendant, EXISTS (SELECT 1 FROM p WHERE p.tree = q.tree AND p.i = q.d AND p.up = q.a) AS above FROM q""")
def _(t):
    moves = tree_moves(t)
    pairs = moves.filter("replica = 'a'").select("tree", F.expr("cast(cast(node as long) div 5 as string)").alias("ancestor"), F.col("node").alias("descendant"))
    return Q.is_ancestor(Q.tree_spans(Q.tree_replay(moves), "root"), pairs)


@query("q9_tree_compactable", "WITH n AS (SELECT c_nationkey AS tree, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i FROM customer) SELECT tree, 'b' AS replica, i + 1 AS seq FROM n WHERE i % 4 = 1 AND i <= 20 AND tree % 5 <> 0")
def _(t):
    moves = tree_moves(t)
    stable = t.rows([("a", 10_000), ("b", 30), ("c", 21)], "replica string, upto long")
    got = moves.groupBy("tree", "replica").agg(F.max("seq").alias("upto"))
    # every fifth tree knows of a move of d that has not come yet
    coming = got.select("tree").distinct().filter("tree % 5 = 0").select("tree", F.lit("d").alias("replica"), F.lit(1).cast("long").alias("upto"))
    return Q.tree_compactable(moves, stable, L.piece(got, coming), got)


@query("q9_tree_compact", f"WITH RECURSIVE {_TREE} SELECT tree, i::VARCHAR AS node, CASE WHEN up < 0 THEN 'root' ELSE up::VARCHAR END AS parent FROM e")
def _(t):
    moves = tree_moves(t)
    got = moves.groupBy("tree", "replica").agg(F.max("seq").alias("upto"))
    return Q.tree_replay(Q.tree_compact(moves, Q.tree_compactable(moves, got, got, got))).select("tree", "node", "parent")


@query("q7_fugue_compact", """WITH c AS (SELECT DISTINCT conv_id AS doc, turn::BIGINT AS turn FROM conversations), k AS (SELECT *, lead(turn) OVER (PARTITION BY doc ORDER BY turn) AS nxt FROM c)
SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY turn, late) - 1 AS pos, CASE late WHEN 1 THEN 'late' ELSE turn::VARCHAR END AS value FROM k, range(2) r(late) WHERE late = 0 AND (nxt IS NOT NULL OR turn % 2 = 0) OR late = 1 AND nxt IS NULL""")
def _(t):
    null = lambda k: F.lit(None).cast(k)
    order = Window.partitionBy("conv_id").orderBy("turn")
    c = t.conversations.select("conv_id", F.col("turn").cast("long").alias("turn")).distinct().withColumns({"p": F.lag("turn").over(order), "nxt": F.lead("turn").over(order)})
    columns = lambda kind, replica, seq, pr, ps, value: [F.col("conv_id").alias("doc"), F.lit(kind).alias("kind"), F.lit(replica).alias("replica"), seq.alias("seq"), pr.alias("parent_replica"), ps.alias("parent_seq"), F.lit("R").alias("side"), null("string").alias("right_replica"), null("long").alias("right_seq"), value.cast("string").alias("value")]
    ins = c.select(*columns("insert", "r", F.col("turn"), F.when(F.col("p").isNotNull(), "r"), F.col("p"), F.col("turn")))
    last = c.filter("nxt is null")
    rem = last.filter("turn % 2 = 1").select(*columns("remove", "r", F.col("turn"), null("string"), null("long"), null("string")))
    log = L.piece(ins, rem)
    known = ins.groupBy("doc", "replica").agg(F.max("seq").alias("upto"))
    compacts = Q.fugue_compactable(log, known, known, known).withColumns({"right_replica": null("string"), "right_seq": null("long"), "value": null("string")})
    # an insert after the compacted element still comes in, from a replica that had not seen the removal
    late = last.select(*columns("insert", "s", F.lit(1).cast("long"), F.lit("r"), F.col("turn"), F.lit("late")))
    return Q.fugue_materialize(Q.fugue_merge(log, compacts, L.piece(late, log))).select("doc", "pos", "value")


def json_edits(t: Tables) -> DataFrame:
    """An event log as documents: a leaf for each type under 'last', a list under 'seen', and 'gone' removed; users divisible by 5 write a leaf over 'last'."""
    e = t.events.select(F.col("user_id").alias("doc"), F.col("event_type").alias("type"), F.col("event_id").alias("ts"), F.col("value").cast("string").alias("value"))
    edit = lambda rows, path, kind, value: rows.select("doc", path.alias("path"), F.lit(kind).alias("kind"), "ts", F.lit("o").alias("origin"), value.cast("string").alias("value"))
    none = F.lit(None)
    return L.piece(
        edit(e.filter("doc % 5 <> 0"), F.lit("last"), "object", none), edit(e.filter("doc % 5 = 0"), F.lit("last"), "leaf", F.lit("v")),
        edit(e, F.concat(F.lit("last/"), F.col("type")), "leaf", F.col("value")), edit(e, F.lit("seen"), "array", none),
        edit(e, F.lit("gone"), "remove", none), edit(e, F.lit("gone/x"), "leaf", F.lit("v")),
    )


@query("q10_keys", """WITH k AS (SELECT DISTINCT user_id AS doc, event_type AS key FROM events)
SELECT doc, 'last' AS at, array_to_string(list(key ORDER BY key), ',') AS keys FROM k WHERE doc % 5 <> 0 GROUP BY doc UNION ALL SELECT DISTINCT doc, '', 'last,seen' FROM k""")
def _(t):
    return Q.json_keys(Q.json_paths(json_edits(t))).withColumn("keys", F.array_join("keys", ","))


@query("q10_lists", "SELECT user_id AS doc, 'seen' AS path, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) - 1 AS pos, event_type AS value FROM events WHERE event_type <> 'error'")
def _(t):
    null = lambda k: F.lit(None).cast(k)
    # each event is put at the head of its user's list, errors are removed again; what hangs under 'last' is no list
    op = lambda kind, value: [F.col("user_id").alias("doc"), F.lit("seen").alias("path"), F.lit(kind).alias("kind"), F.col("event_id").alias("lamport"), F.lit("r").alias("replica"), F.col("event_id").alias("seq"), null("long").alias("after_lamport"), null("string").alias("after_replica"), null("long").alias("after_seq"), value.alias("value")]
    ins = t.events.select(*op("insert", F.col("event_type")))
    ops = L.piece(ins, ins.withColumn("path", F.lit("last")), t.events.filter("event_type = 'error'").select(*op("remove", null("string"))))
    return Q.json_lists(Q.json_paths(json_edits(t)), ops)


@query("q10_json", "WITH e AS (SELECT user_id AS doc, event_type AS path, CASE WHEN event_id % 9 = 0 THEN 'object' WHEN event_id % 9 = 1 THEN 'array' ELSE 'leaf' END AS kind, event_id AS ts, value::VARCHAR AS v FROM events), r AS (SELECT *, CASE kind WHEN 'object' THEN 3 WHEN 'array' THEN 2 ELSE 1 END AS k FROM e) SELECT doc, path, arg_max(kind, (k, ts)) AS kind, max(k)::INTEGER AS rank FROM r GROUP BY 1, 2")
def _(t):
    kind = F.when(F.col("event_id") % 9 == 0, "object").when(F.col("event_id") % 9 == 1, "array").otherwise("leaf")
    e = t.events.select(F.col("user_id").alias("doc"), F.col("event_type").alias("path"), kind.alias("kind"), F.col("event_id").alias("ts"), F.lit("o").alias("origin"), F.col("value").cast("string").alias("value"))
    return Q.json_paths(e).select("doc", "path", "kind", F.when(F.col("kind") == "object", 3).when(F.col("kind") == "array", 2).otherwise(1).alias("rank"))


# ---- scalar functions -----------------------------------------------------------------------------------------


@query("f1_murmur3", f"SELECT p_partkey, {_murmur_sql('p_name', 0)} AS h0, {_murmur_sql('p_name', 42)} AS h42 FROM part")
def _(t):
    return t.part.select("p_partkey", H.murmur3(F.col("p_name")).alias("h0"), H.murmur3(F.col("p_name"), 42).alias("h42"))


@query("f2_fnv1a64", f"SELECT p_partkey, {_fnv_sql('p_name')} AS h FROM part")
def _(t):
    return t.part.select("p_partkey", H.fnv64(F.col("p_name")).alias("h"))


@query("f3_ring_position", f"SELECT p_partkey, {_ring_sql('p_name')} AS position FROM part")
def _(t):
    return t.part.select("p_partkey", H.ring(F.col("p_name")).alias("position"))


@query("f4_content_address", "SELECT p_partkey, sha256(p_name) AS address FROM part")
def _(t):
    return t.part.select("p_partkey", F.sha2("p_name", 256).alias("address"))


@query("f5_bucket_math", f"SELECT event_id, ceil(ln(value) / ln({_GAMMA}))::BIGINT AS idx FROM events WHERE value > 0")
def _(t):
    return t.events.filter("value > 0").select("event_id", F.ceil(F.log("value") / F.log(F.lit(1.01) / F.lit(0.99))).alias("idx"))


@query("f9_incarnation", "SELECT user_id, (max(event_id) << 20) + count(*) AS clock FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("user_id").agg((F.shiftleft(F.max("event_id"), 20) + F.count("*")).alias("clock"))


@query("f11_hex", "SELECT p_partkey, lower(hex(p_name)) AS h FROM part")
def _(t):
    return t.part.select("p_partkey", F.lower(F.hex("p_name")).alias("h"))


@query("f12_map_max", "SELECT user_id, greatest(count(*) FILTER (event_type = 'click'), count(*) FILTER (event_type = 'error')) AS top FROM events GROUP BY 1")
def _(t):
    n = lambda k: F.count(F.when(F.col("event_type") == k, 1))
    maps = t.events.groupBy("user_id").agg(F.create_map(F.lit("n"), n("click")).alias("a"), F.create_map(F.lit("n"), n("error")).alias("b"))
    return maps.select("user_id", F.map_zip_with("a", "b", lambda k, x, y: F.greatest(x, y))["n"].alias("top"))


@query("f13_json_leaf", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def _(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("f15_severity", "SELECT user_id % 24 + 1 AS severity, CASE WHEN user_id % 24 + 1 < 5 THEN 'TRACE' WHEN user_id % 24 + 1 < 9 THEN 'DEBUG' WHEN user_id % 24 + 1 < 13 THEN 'INFO' WHEN user_id % 24 + 1 < 17 THEN 'WARN' WHEN user_id % 24 + 1 < 21 THEN 'ERROR' ELSE 'FATAL' END AS level, count(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    s = F.col("severity")
    level = F.when(s < 5, "TRACE").when(s < 9, "DEBUG").when(s < 13, "INFO").when(s < 17, "WARN").when(s < 21, "ERROR").otherwise("FATAL")
    return t.events.withColumn("severity", F.col("user_id") % 24 + 1).groupBy("severity", level.alias("level")).agg(F.count("*").alias("n"))


@query("f16_epoch", "SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events")
def _(t):
    return t.events.select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))


# ---- streaming semantics, in their batch form -----------------------------------------------------------------


@query("r3_root_digest", "SELECT TRUE AS equal")
def _(t):
    e = t.events.select("event_id", "event_type")
    a, b = A.state_digest(e, "event_id", "event_type"), A.state_digest(e.repartition(7), "event_id", "event_type")
    return a.join(b, "root", "left").select(b["n"].isNotNull().alias("equal"))  # one row each


@query("r6_heartbeat_gaps", """WITH g AS (SELECT user_id, event_id, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts)) / 1e6 AS gap FROM events)
SELECT user_id, round(max(gap), 3) AS longest, count(*) FILTER (gap < 7200) AS recovered, count(*) FILTER (gap >= 7200) AS lost FROM g WHERE gap > 1800 GROUP BY 1""")
def _(t):
    g = T.gap_classes(t.events.select("user_id", F.col("ts").cast("timestamp").alias("ts")), "user_id", "ts", 1800, 7200)
    return g.groupBy("user_id").agg(F.round(F.max("gap"), 3).alias("longest"), F.count(F.when(F.col("event") == "Recovered", 1)).alias("recovered"), F.count(F.when(F.col("event") == "Lost", 1)).alias("lost"))


@query("d2_registry", "SELECT event_id, upper(event_type) AS out FROM events")
def _(t):
    r = D.Registry()
    r.source("events", lambda: t.events)
    r.map("shout", lambda df: df.select("event_id", F.upper("event_type").alias("out")), {"out"})
    return r.lower(D.Draft.shuttle("events").map("shout"))[0]


@query("d3_op_result", "SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN 100 // (event_id % 10) END AS result, event_id % 10 = 0 AS failed FROM events")
def _(t):
    r = F.expr("if(event_id % 10 = 0, null, 100 div (event_id % 10))")
    return t.events.select("event_id", r.alias("result"), (F.col("event_id") % 10 == 0).alias("failed"))


# ---- stamps, turns, requests, rationals -------------------------------------------------------------------------


def causal_log(t: Tables) -> DataFrame:
    """Four replicas: most events are ticks, every fifth observes a dot of the next replica, every 35th forgets the frontier."""
    d = dotted(t)
    kind = F.when(F.col("event_id") % 35 == 4, "clear").when(F.col("event_id") % 5 == 3, "observe").otherwise("tick")
    sender = F.when(kind == "observe", F.concat(F.lit("r"), ((F.col("user_id") + 1) % 4).cast("string")))
    return d.select("replica", F.col("seq").alias("idx"), kind.alias("kind"), sender.alias("from_replica"), F.when(kind == "observe", F.col("event_id") % 50).cast("long").alias("from_seq"))


_STAMPS = f"""{DOTTED}, l AS (SELECT replica, seq AS idx, CASE WHEN event_id % 35 = 4 THEN 'clear' WHEN event_id % 5 = 3 THEN 'observe' ELSE 'tick' END AS kind, 'r' || ((user_id + 1) % 4) AS from_replica, event_id % 50 AS from_seq FROM dotted),
k AS (SELECT *, count(*) FILTER (kind = 'tick') OVER (PARTITION BY replica ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS turn, coalesce(max(idx) FILTER (kind IN ('tick', 'clear')) OVER (PARTITION BY replica ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS since FROM l)"""


@query("f10_causal_stamps", f"""WITH {_STAMPS}, tk AS (SELECT replica, idx, turn, since FROM k WHERE kind = 'tick'),
dots AS (SELECT tk.replica, tk.idx, o.from_replica || ':' || o.from_seq AS dot FROM tk JOIN l o ON o.replica = tk.replica AND o.kind = 'observe' AND o.idx > tk.since AND o.idx < tk.idx
  UNION SELECT tk.replica, tk.idx, tk.replica || ':' || tk.turn FROM tk JOIN l p ON p.replica = tk.replica AND p.idx = tk.since AND p.kind = 'tick')
SELECT tk.replica, tk.idx, tk.turn + 1 AS seq, coalesce(string_agg(dot, ',' ORDER BY dot), '') AS predecessors FROM tk LEFT JOIN dots USING (replica, idx) GROUP BY ALL""")
def _(t):
    dots = F.array_sort(F.transform("predecessors", lambda d: F.concat_ws(":", d["replica"], d["seq"].cast("string"))))
    return S.causal_stamps(causal_log(t)).select("replica", "idx", "seq", F.array_join(dots, ",").alias("predecessors"))


@query("f10_frontier", f"""WITH {_STAMPS}, e AS (SELECT replica, max(idx) + 1 AS idx, count(*) FILTER (kind = 'tick') AS turn, max(idx) FILTER (kind IN ('tick', 'clear')) AS since FROM l GROUP BY 1),
dots AS (SELECT e.replica, o.from_replica || ':' || o.from_seq AS dot FROM e JOIN l o ON o.replica = e.replica AND o.kind = 'observe' AND o.idx > e.since UNION SELECT e.replica, e.replica || ':' || e.turn FROM e JOIN l p ON p.replica = e.replica AND p.idx = e.since AND p.kind = 'tick')
SELECT e.replica, coalesce(string_agg(dot, ',' ORDER BY dot), '') AS frontier FROM e LEFT JOIN dots USING (replica) GROUP BY ALL""")
def _(t):
    dots = F.array_sort(F.transform("frontier", lambda d: F.concat_ws(":", d["replica"], d["seq"].cast("string"))))
    return S.causal_frontier(causal_log(t)).select("replica", F.array_join(dots, ",").alias("frontier"))


@query("l12_stamped", f"WITH {_STAMPS} SELECT replica, idx, CASE WHEN idx % 10 = 0 THEN 7 WHEN kind = 'tick' THEN turn + 1 END::BIGINT AS seq, idx % 10 = 0 AS kept FROM k")
def _(t):
    log = causal_log(t)
    given = F.col("idx") % 10 == 0
    kind = "array<struct<replica:string,seq:bigint>>"
    spans = log.select("replica", "idx", F.when(given, F.lit(7)).cast("long").alias("seq"), F.when(given, F.array()).cast(kind).alias("predecessors"), given.alias("kept"))
    return S.stamped(spans, S.causal_stamps(log)).select("replica", "idx", "seq", "kept")


@query("w13_turns", """WITH e AS (SELECT event_id AS idx, CASE WHEN event_id % 400 = 399 THEN 'install' WHEN event_type = 'view' THEN 'internal' ELSE 'entry' END AS kind, CASE WHEN user_id % 9 <> 0 THEN user_id END AS client, (event_id * 7) % 101 AS request, event_type AS action FROM events),
r AS (SELECT *, count(*) FILTER (kind = 'install') OVER (ORDER BY idx) AS era FROM e WHERE kind <> 'internal')
SELECT idx, CASE kind WHEN 'install' THEN 'Reset' ELSE 'Committed' END AS event, action, kind = 'install' OR client IS NULL OR request > coalesce(max(request) FILTER (kind = 'entry') OVER (PARTITION BY client, era ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS applied FROM r""")
def _(t):
    kind = F.when(F.col("event_id") % 400 == 399, "install").when(F.col("event_type") == "view", "internal").otherwise("entry")
    return S.turn_events(t.events.select(F.col("event_id").alias("idx"), kind.alias("kind"), F.when(F.col("user_id") % 9 != 0, F.col("user_id")).alias("client"), ((F.col("event_id") * 7) % 101).alias("request_id"), F.col("event_type").alias("action")))


@query("r7_pairing", """WITH s AS (SELECT user_id AS session, min(event_id) AS armed FROM events GROUP BY 1), m AS (SELECT user_id AS session, event_id AS "at", event_id % 3 AS members FROM events),
v AS (SELECT session, armed + 200 AS ends, min("at") FILTER (members >= 2) AS paired, arg_max(members, "at") AS observed FROM s JOIN m USING (session) WHERE "at" < armed + 200 AND "at" <= 900 GROUP BY ALL)
SELECT session, CASE WHEN paired IS NOT NULL THEN 'Paired' ELSE 'NeverPaired' END AS event, coalesce(paired, ends) AS "at", CASE WHEN paired IS NULL THEN observed END AS observed FROM v WHERE paired IS NOT NULL OR ends <= 900""")
def _(t):
    e = t.events.select(F.col("user_id").alias("session"), F.col("event_id").alias("at"), (F.col("event_id") % 3).alias("members"))
    sessions = e.groupBy("session").agg(F.min("at").alias("armed"))
    return S.pairing(sessions, e, 2, 200, 900)


@query("s12_otlp_traces", f"""WITH {DOTTED}, x AS (SELECT event_id, epoch_us(ts) * 1000 AS ns, lpad(event_id::VARCHAR, 16, '0') AS id, md5((event_id // 4)::VARCHAR) AS trace, event_type, user_id, replica, seq, CASE WHEN event_id % 4 <> 0 THEN lpad((event_id - 1)::VARCHAR, 16, '0') END AS up FROM dotted),
k AS (SELECT a.id, string_agg('{{"traceId":"' || b.trace || '","spanId":"' || b.id || '"}}', ',' ORDER BY b.trace, b.id) AS links FROM x a JOIN x b ON a.replica = b.replica AND b.seq IN (a.seq - 1, a.seq - 3) WHERE a.up IS DISTINCT FROM b.id GROUP BY 1),
j AS (SELECT event_id // 256 AS batch, ns, x.id, '{{"traceId":"' || trace || '","spanId":"' || x.id || '",' || coalesce('"parentSpanId":"' || up || '",', '') || '"name":"' || event_type || '","kind":' || CASE WHEN user_id % 2 = 0 THEN 2 ELSE 1 END || ',"startTimeUnixNano":"' || ns || '","endTimeUnixNano":"' || (ns + 1000) || '","attributes":[{{"key":"replica","value":{{"stringValue":"' || replica || '"}}}}]' || coalesce(',"links":[' || links || ']', '') || '}}' AS body FROM x LEFT JOIN k ON k.id = x.id)
SELECT batch, count(*) AS n, '{{"resourceSpans":[{{"scopeSpans":[{{"spans":[' || string_agg(body, ',' ORDER BY ns, id) || ']}}]}}]}}' AS body FROM j GROUP BY 1""")
def _(t):
    name = lambda c: F.lpad(c.cast("string"), 16, "0")
    trace = lambda c: F.md5(F.floor(c / 4).cast("string"))
    made = spans(t)
    e = t.events.select("event_id", "event_type", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    s = made.join(e, made["span_id"] == e["event_id"]).select(
        F.expr("event_id div 256").alias("batch"), trace(F.col("event_id")).alias("trace_id"), name(F.col("event_id")).alias("span_id"), name(F.col("parent_span_id")).alias("parent_span_id"), F.col("event_type").alias("name"),
        F.when(F.col("user_id") % 2 == 0, "SERVER").otherwise("INTERNAL").alias("kind"), (F.col("us") * 1000).alias("start_ns"), (F.col("us") * 1000 + 1000).alias("end_ns"), F.create_map(F.lit("replica"), F.col("replica")).alias("attributes"))
    links = T.causal_links(made).select(name(F.col("from_span")).alias("from_span"), trace(F.col("to_span")).alias("to_trace"), name(F.col("to_span")).alias("to_span"))
    return T.otlp_traces(s, links, "batch")


@query("s12_otlp_metrics", f"""WITH e AS (SELECT event_type, user_id % 3 AS batch, max(epoch_us(ts)) * 1000 AS ns, count(*) AS n, floor(max(value)) + 0.5 AS top, count(DISTINCT user_id) AS users FROM events GROUP BY ALL),
c AS (SELECT event_type, user_id % 3 AS batch, ceil(ln(value) / ln({_GAMMA}))::INTEGER AS idx, count(*) AS n FROM events WHERE value >= 1e-9 GROUP BY ALL),
h AS (SELECT event_type, batch, min(idx) AS lo, max(idx) AS hi, sum(n) AS total FROM c GROUP BY ALL),
hx AS (SELECT g.event_type, g.batch, any_value(g.lo) - 1 AS off, any_value(g.total) AS total, string_agg('"' || coalesce(c.n, 0) || '"', ',' ORDER BY g.i) AS cells FROM (SELECT *, unnest(range(lo, hi + 1)) AS i FROM h) g LEFT JOIN c ON c.event_type = g.event_type AND c.batch = g.batch AND c.idx = g.i GROUP BY 1, 2),
a AS (SELECT *, '"attributes":[{{"key":"of","value":{{"stringValue":"' || event_type || '"}}}}],' AS ax FROM e),
m AS (SELECT batch, event_type || '.count' AS name, 'sum' AS kind, '{{"name":"' || event_type || '.count","sum":{{"dataPoints":[{{' || ax || '"startTimeUnixNano":"0","timeUnixNano":"' || ns || '","asInt":"' || n || '"}}],"aggregationTemporality":2,"isMonotonic":true}}}}' AS body FROM a
UNION ALL SELECT batch, event_type || '.top', 'gauge', '{{"name":"' || event_type || '.top","gauge":{{"dataPoints":[{{' || ax || '"timeUnixNano":"' || ns || '","asDouble":' || top::DOUBLE || '}}]}}}}' FROM a
UNION ALL SELECT batch, event_type || '.users', 'cardinality', '{{"name":"' || event_type || '.users","gauge":{{"dataPoints":[{{' || ax || '"timeUnixNano":"' || ns || '","asInt":"' || users || '"}}]}}}}' FROM a
UNION ALL SELECT batch, event_type || '.value', 'histogram', '{{"name":"' || event_type || '.value","exponentialHistogram":{{"dataPoints":[{{' || ax || '"startTimeUnixNano":"0","timeUnixNano":"' || ns || '","count":"' || total || '","scale":5,"zeroCount":"0","positive":{{"offset":' || off || ',"bucketCounts":[' || cells || ']}}}}],"aggregationTemporality":2}}}}' FROM a JOIN hx USING (event_type, batch))
SELECT batch, count(*) AS n, '{{"resourceMetrics":[{{"scopeMetrics":[{{"metrics":[' || string_agg(body, ',' ORDER BY name, kind) || ']}}]}}]}}' AS body FROM m GROUP BY 1""")
def _(t):
    key = ["event_type", "batch"]
    e = t.events.withColumn("batch", F.col("user_id") % 3)
    ends = e.groupBy(*key).agg((F.max(F.unix_micros(F.col("ts").cast("timestamp"))) * 1000).alias("time_ns"), F.count(F.lit(1)).alias("n"), (F.floor(F.max("value")) + 0.5).alias("top"), F.countDistinct("user_id").alias("users"))
    cells = K.dd_cells(e.filter("value >= 1e-9"), key, "value")
    h = K.exponential_histogram(cells, key).join(cells.groupBy(*key).agg(F.sum("count").alias("count")), key).join(ends.select(*key, "time_ns"), key)
    null = lambda k: F.lit(None).cast(k)
    point = lambda rows, kind, tail, value, cell: rows.select("batch", F.lit(kind).alias("kind"), F.concat("event_type", F.lit(tail)).alias("name"), F.create_map(F.lit("of"), F.col("event_type")).alias("attributes"), F.lit(0).cast("long").alias("start_ns"), "time_ns", value.cast("double").alias("value"), *cell)
    no = [null("long").alias("count"), null("int").alias("scale"), null("long").alias("zero_count"), null("int").alias("offset"), null("array<bigint>").alias("counts")]
    full = ["count", F.lit(5).alias("scale"), F.lit(0).cast("long").alias("zero_count"), F.col("offset").cast("int").alias("offset"), "counts"]
    points = L.piece(
        point(ends, "sum", ".count", F.col("n"), no), point(ends, "gauge", ".top", F.col("top"), no), point(ends, "cardinality", ".users", F.col("users"), no),
        point(h, "histogram", ".value", F.lit(None), full))
    return T.otlp_metrics(points, "batch")


@query("s2_append", "SELECT event_id AS \"offset\", event_type AS op FROM events")
def _(t):
    f = frames(t).select("offset", "end_offset", "arrived_at", "op")
    path = f"{shared_dir(t.spark)}/tidefold/archive-{uuid.uuid4().hex}"
    # two appends to one archive, then a replay of the whole
    A.append(f.filter("offset % 2 = 0"), path)
    A.append(f.filter("offset % 2 = 1"), path)
    return A.replay(t.spark.read.parquet(path)).select("offset", "op")


@query("t5_partial_view", "WITH p AS (SELECT s_name AS peer, row_number() OVER (ORDER BY md5(s_name || '|Supplier#000000001'), s_name) AS n FROM supplier WHERE s_name <> 'Supplier#000000001'), k AS (SELECT greatest(4, ceil(ln(count(*))) + 2) AS k FROM supplier) SELECT peer, CASE WHEN n <= k THEN 'active' ELSE 'spare' END AS role FROM p, k WHERE n <= k + 3")
def _(t):
    return P.partial_view(t.supplier.select(F.col("s_name").alias("peer")), "Supplier#000000001", 3)


@query("f6_scales", "SELECT s::INTEGER AS scale, round((pow(2, pow(2, -s)) - 1) / (pow(2, pow(2, -s)) + 1), 12) AS alpha, s::INTEGER AS back FROM range(-3, 13) r(s)")
def _(t):
    return t.rows([(s, round(K.alpha_for_scale(s), 12), K.scale_for_alpha(K.alpha_for_scale(s))) for s in range(-3, 13)], "scale int, alpha double, back int")


@query("f7_bloom_sizes", "WITH c AS (SELECT n, p, ceil(-n * ln(p) / (ln(2) * ln(2)))::BIGINT AS bits FROM (VALUES (1), (10), (1000), (1000000)) v(n), (VALUES (0.5), (0.01), (0.0001)) w(p)) SELECT n::BIGINT AS n, p::DOUBLE AS fpr, greatest(1, bits) AS bits, greatest(1, round(bits::DOUBLE / n * ln(2)))::BIGINT AS hashes FROM c")
def _(t):
    return t.rows([(n, p, *K.bloom_size(n, p)) for n in (1, 10, 1000, 1000000) for p in (0.5, 0.01, 0.0001)], "n long, fpr double, bits long, hashes long")


@query("f8_rationals", """WITH x AS (SELECT l_orderkey AS o, l_linenumber AS l, (l_quantity::BIGINT - 25)::HUGEINT AS a, (l_linenumber + 1)::HUGEINT AS b, (l_suppkey % 12 + 1)::HUGEINT AS c, (l_partkey % 9 + 1)::HUGEINT AS d FROM lineitem),
y AS (SELECT o, l, a * d + c * b AS sn, b * d AS sd, a * c AS pn, b * d AS pd, a * d AS qn, b * c AS qd, sign(a * d - c * b)::INTEGER AS compared, ceil(a::DOUBLE / b)::BIGINT AS up FROM x)
SELECT o AS orderkey, l AS line, (sn // gcd(sn, sd))::BIGINT AS sum_num, (sd // gcd(sn, sd))::BIGINT AS sum_den, (pn // gcd(pn, pd))::BIGINT AS product_num, (pd // gcd(pn, pd))::BIGINT AS product_den, (qn // gcd(qn, qd))::BIGINT AS quotient_num, (qd // gcd(qn, qd))::BIGINT AS quotient_den, compared, up FROM y""")
def _(t):
    long = lambda c: c.cast("long")
    li = t.lineitem.select("l_orderkey", "l_linenumber", R.rational(long(F.col("l_quantity")) - 25, long(F.col("l_linenumber") + 1)).alias("x"), R.rational(long(F.col("l_suppkey") % 12 + 1), long(F.col("l_partkey") % 9 + 1)).alias("y"))
    x, y = F.col("x"), F.col("y")
    got = li.select("l_orderkey", "l_linenumber", R.plus(x, y).alias("s"), R.times(x, y).alias("p"), R.over(x, y).alias("q"), R.compared(x, y).alias("compared"), R.ceiling(x).alias("up"))
    return got.select(F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("line"), *(F.col(f"{c}.{p}").alias(f"{n}_{p}") for c, n in (("s", "sum"), ("p", "product"), ("q", "quotient")) for p in ("num", "den")), "compared", "up")


@query("f14_metric_version", "SELECT event_id, md5('gauge|' || event_id::VARCHAR) AS version FROM events")
def _(t):
    return t.events.select("event_id", F.col("event_id").alias("value")).select("event_id", T.metric_version("gauge").alias("version"))


@query("w10_fronts", """WITH c AS (SELECT c_nationkey AS parent, c_custkey % 5 + 1 AS w, c_custkey % 17 AS i, c_custkey % 4 < 2 AS dem, c_custkey % 7 = 0 AS fresh, c_custkey % 4 < 2 AND c_custkey % 3 = 0 AS wakes FROM customer),
f AS (SELECT parent, count(*) FILTER (dem) AS k, sum(i) FILTER (dem) AS sn, sum(w) FILTER (dem) AS sd, arg_max({'i': i, 'w': w}, i / w) AS top FROM c WHERE NOT fresh AND NOT wakes GROUP BY 1),
g AS (SELECT parent, (CASE WHEN k > 0 THEN sn ELSE top.i END)::BIGINT AS n, (CASE WHEN k > 0 THEN sd ELSE top.w END)::BIGINT AS d FROM f)
SELECT parent, n // gcd(n, d) AS num, d // gcd(n, d) AS den FROM g""")
def _(t):
    return G.fronts(joining(t))


@query("l16_run_metrics", "SELECT 'sum' AS kind, 'ops.executed' AS name, 'r' || (user_id % 4) AS replica, count(*)::DOUBLE AS value, NULL::VARCHAR AS item FROM events GROUP BY ALL UNION ALL SELECT 'sum', 'ops.failed', 'r' || (user_id % 4), count(*) FILTER (event_type = 'error')::DOUBLE, NULL FROM events GROUP BY ALL UNION ALL SELECT DISTINCT 'distinct', 'ops.distinct', 'r' || (user_id % 4), NULL::DOUBLE, event_type FROM events")
def _(t):
    return T.run_metrics(t.events.select(F.concat(F.lit("r"), (F.col("user_id") % 4).cast("string")).alias("replica"), F.col("event_type").alias("op"), (F.col("event_type") == "error").alias("failed")))


@query("l19_attachments", f"WITH {LWW} SELECT user_id AS client, value AS server FROM (SELECT user_id, arg_max_null(value, (ts, origin)) AS value FROM w GROUP BY 1) WHERE value IS NOT NULL")
def _(t):
    return L.lww_map(lww_writes(t), ["user_id"]).select(F.col("user_id").alias("client"), F.col("value").alias("server"))
