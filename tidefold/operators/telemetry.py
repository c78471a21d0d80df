"""Telemetry: capture gates, idempotent export with caps, drains against backend digests, causal links, OTLP JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def capture_gate(logs: DataFrame, least: int, keep_untraced: bool = True) -> DataFrame:
    """Rows at or over the level whose trace is sampled; rows without a trace go by the policy."""
    traced = F.when(F.col("sampled").isNull(), F.lit(keep_untraced)).otherwise(F.col("sampled"))
    return logs.filter((F.col("severity") >= least) & traced)


def mapped_attributes(attributes: Column, logger: Column) -> Column:
    """Logger name plus the event's attributes, which override it."""
    return F.map_concat(F.map_filter(F.create_map(F.lit("logger"), logger), lambda k, _: ~F.map_contains_key(attributes, "logger")), attributes)


def first_by_id(records: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Idempotent export: the first arrival of each id."""
    w = Window.partitionBy(key).orderBy(*order)
    return records.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def capped(records: DataFrame, by: list[str], order: list[str], cap: int, keep: str = "newest") -> DataFrame:
    """A full buffer: 'newest' drops the oldest rows, 'oldest' refuses the later ones."""
    w = Window.partitionBy(*by).orderBy(*(F.col(c).desc() if keep == "newest" else F.col(c) for c in order))
    return records.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= cap).drop("__n")


def drain(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """What the backend does not have yet."""
    return rows.join(known.select(key), key, "left_anti")


def drain_metrics(metrics: DataFrame, digest: DataFrame, key: list[str]) -> DataFrame:
    """Metrics whose key is missing there or has another version."""
    known = digest.select(*key, F.col("version").alias("__v"), F.lit(True).alias("__known"))
    return metrics.join(known, key, "left").filter(F.col("__known").isNull() | ~F.col("version").eqNullSafe(F.col("__v"))).drop("__v", "__known")


def causal_links(spans: DataFrame) -> DataFrame:
    """from_span, to_span: a span's predecessor dots resolved to the spans that wrote them, without the tree parent's edge."""
    want = spans.select(F.col("span_id").alias("from_span"), "parent_span_id", F.explode("predecessors").alias("d")).select("from_span", "parent_span_id", "d.replica", "d.seq")
    made = spans.select("replica", "seq", F.col("span_id").alias("to_span"))
    return want.join(made, ["replica", "seq"]).filter(~F.col("parent_span_id").eqNullSafe(F.col("to_span"))).select("from_span", "to_span").distinct()


def sorted_links(links: DataFrame) -> DataFrame:
    """from_span, links: each span's links as one list, in the order of the spans they lead to."""
    return links.groupBy("from_span").agg(F.array_sort(F.collect_set("to_span")).alias("links"))


def distinct_metrics(points: DataFrame, p: int = 14) -> DataFrame:
    """name, attrs, value: the estimated number of different items of the kind 'distinct', registers merged by their maximum."""
    from tidefold.operators.sketches import hll_estimate, hll_registers

    key = ["name", "attrs"]
    return hll_estimate(hll_registers(points.filter("kind = 'distinct'"), key, "item", p), key, p).withColumnRenamed("estimate", "value")


def histogram_metrics(points: DataFrame, bounds: list[float]) -> DataFrame:
    """name, attrs, bucket, count, sum of the kind 'histogram': explicit boundaries, merged by the largest count of a replica's bucket."""
    from tidefold.operators.sketches import histogram

    key = ["name", "attrs", "replica"]
    each = histogram(points.filter("kind = 'histogram'"), key, "value", bounds)
    return each.groupBy("name", "attrs", "bucket").agg(F.sum("count").alias("count"), F.sum("sum").alias("sum"))


def quantile_metrics(points: DataFrame, qs: list[float]) -> DataFrame:
    """name, attrs, q, value of the kind 'summary': quantiles of log buckets."""
    from tidefold.operators.sketches import dd_cells, dd_quantiles

    key = ["name", "attrs"]
    return dd_quantiles(dd_cells(points.filter("kind = 'summary'"), key, "value"), key, qs)


def metric_version(family: str) -> Column:
    """A version per point, of which only equality matters."""
    return F.md5(F.concat_ws("|", F.lit(family), F.col("value").cast("string")))


def merged_metrics(points: DataFrame) -> DataFrame:
    """Metric catalogue: sums by largest per replica, gauges by last writer, keyed by name, kind and canonical attributes.

    Doubles are added as they are, a group's replicas in their order, so that the sum does not depend on how rows lie.
    """
    key = ["name", "attrs"]
    sums = points.filter("kind = 'sum'").groupBy(*key, "replica").agg(F.max("value").alias("value"))
    ordered = F.array_sort(F.collect_list(F.struct("replica", F.col("value").cast("double").alias("value"))))
    sums = sums.groupBy(*key).agg(F.aggregate(ordered, F.lit(0.0), lambda a, x: a + x["value"]).alias("value"))
    gauges = points.filter("kind = 'gauge'").groupBy(*key).agg(F.max_by("value", F.struct("ts", "replica")).alias("value"))
    return sums.withColumn("kind", F.lit("sum")).unionByName(gauges.withColumn("kind", F.lit("gauge")))


def otlp_logs(records: DataFrame, batch: str) -> DataFrame:
    """One OTLP/JSON request body per batch; 64-bit integers are strings, as the JSON mapping asks."""
    record = F.struct(
        F.col("ts_ns").cast("string").alias("timeUnixNano"), F.col("severity").alias("severityNumber"),
        F.struct(F.col("body").alias("stringValue")).alias("body"), F.col("trace_id").alias("traceId"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("ts_ns", "record_id", record.alias("r"))))
    logs = F.transform(ordered, lambda x: x["r"])
    body = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(logs.alias("logRecords"))).alias("scopeLogs"))).alias("resourceLogs")))
    return records.groupBy(batch).agg(body.alias("body"), F.count(F.lit(1)).alias("n"))


def _pairs(attributes: Column) -> Column:
    """A map as OTLP's list of keys and values, by key."""
    return F.transform(F.array_sort(F.map_entries(attributes)), lambda x: F.struct(x["key"].alias("key"), F.struct(x["value"].alias("stringValue")).alias("value")))


def _request(rows: DataFrame, batch: str, order: list[str], item: Column, names: tuple[str, str, str]) -> DataFrame:
    """batch, n, body: the items of each batch in one OTLP/JSON request body; fields without a value are left out."""
    resource, scope, leaf = names
    ordered = F.array_sort(F.collect_list(F.struct(*order, F.to_json(item).alias("json"))))
    items = F.array_join(F.transform(ordered, lambda x: x["json"]), ",")
    body = F.concat(F.lit(f'{{"{resource}":[{{"{scope}":[{{"{leaf}":['), items, F.lit("]}]}]}"))
    return rows.groupBy(batch).agg(F.count(F.lit(1)).alias("n"), body.alias("body"))


#: The protocol's numbers of span kinds and of cumulative temporality: fixed values.
SPAN_KINDS = {"INTERNAL": 1, "SERVER": 2, "CLIENT": 3, "PRODUCER": 4, "CONSUMER": 5}
CUMULATIVE = 2


def otlp_traces(spans: DataFrame, links: DataFrame, batch: str) -> DataFrame:
    """One traces request for each batch.

    spans: trace_id, span_id, parent_span_id (hex or null), name, kind, start_ns, end_ns, attributes (map of strings).
    links: from_span, to_trace, to_span; each span carries its own, sorted.
    """
    own = links.groupBy(F.col("from_span").alias("span_id")).agg(F.array_sort(F.collect_set(F.struct(F.col("to_trace").alias("traceId"), F.col("to_span").alias("spanId")))).alias("links"))
    kind = F.element_at(F.create_map(*(F.lit(x) for pair in SPAN_KINDS.items() for x in pair)), F.col("kind"))
    item = F.struct(
        F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), F.col("parent_span_id").alias("parentSpanId"), "name", kind.alias("kind"),
        F.col("start_ns").cast("string").alias("startTimeUnixNano"), F.col("end_ns").cast("string").alias("endTimeUnixNano"), _pairs(F.col("attributes")).alias("attributes"), "links",
    )
    return _request(spans.join(own, "span_id", "left"), batch, ["start_ns", "span_id"], item, ("resourceSpans", "scopeSpans", "spans"))


def otlp_metrics(points: DataFrame, batch: str) -> DataFrame:
    """One metrics request for each batch: sums are cumulative and monotonic, gauges and cardinalities are gauges, log buckets are exponential histograms.

    points: kind ('sum', 'double_sum', 'gauge', 'cardinality', 'histogram'), name, attributes (map of strings), start_ns,
    time_ns, value (double; whole for sums and cardinalities), and for histograms count, scale, zero_count, offset, counts.
    """
    is_ = lambda *kinds: F.col("kind").isin(*kinds)
    at = [_pairs(F.col("attributes")).alias("attributes"), F.when(~is_("gauge", "cardinality"), F.col("start_ns").cast("string")).alias("startTimeUnixNano"), F.col("time_ns").cast("string").alias("timeUnixNano")]
    point = F.struct(*at, F.when(is_("sum", "cardinality"), F.col("value").cast("long").cast("string")).alias("asInt"), F.when(is_("double_sum", "gauge"), F.col("value")).alias("asDouble"))
    cells = F.struct(
        *at, F.col("count").cast("string").alias("count"), "scale", F.col("zero_count").cast("string").alias("zeroCount"),
        F.when(F.size("counts") > 0, F.struct("offset", F.transform("counts", lambda c: c.cast("string")).alias("bucketCounts"))).alias("positive"),
    )
    item = F.struct(
        "name", F.when(is_("sum", "double_sum"), F.struct(F.array(point).alias("dataPoints"), F.lit(CUMULATIVE).alias("aggregationTemporality"), F.lit(True).alias("isMonotonic"))).alias("sum"),
        F.when(is_("gauge", "cardinality"), F.struct(F.array(point).alias("dataPoints"))).alias("gauge"),
        F.when(is_("histogram"), F.struct(F.array(cells).alias("dataPoints"), F.lit(CUMULATIVE).alias("aggregationTemporality"))).alias("exponentialHistogram"),
    )
    return _request(points, batch, ["name", "kind"], item, ("resourceMetrics", "scopeMetrics", "metrics"))


def run_metrics(runs: DataFrame) -> DataFrame:
    """kind, name, replica, value, item: the points that a job's own runs publish: executions and failures as sums of each replica, operations as items of a cardinality.

    runs: replica, op, failed.
    """
    each = runs.groupBy("replica").agg(F.count(F.lit(1)).alias("executed"), F.count(F.when(F.col("failed"), 1)).alias("failures"))
    none = F.lit(None)
    total = lambda c, name: each.select(F.lit("sum").alias("kind"), F.lit(name).alias("name"), "replica", F.col(c).cast("double").alias("value"), none.cast("string").alias("item"))
    ops = runs.select(F.lit("distinct").alias("kind"), F.lit("ops.distinct").alias("name"), "replica", none.cast("double").alias("value"), F.col("op").cast("string").alias("item")).distinct()
    return total("executed", "ops.executed").unionByName(total("failures", "ops.failed")).unionByName(ops)


def health(results: DataFrame, by: list[str]) -> DataFrame:
    """Counts of each outcome."""
    kinds = ("accepted", "failed", "dropped", "refused", "deduplicated")
    return results.groupBy(*by).agg(*(F.count(F.when(F.col("outcome") == k, 1)).alias(k) for k in kinds))


def failed_range(results: DataFrame, by: list[str]) -> DataFrame:
    """The offsets between which durability is degraded."""
    return results.filter("outcome = 'failed'").groupBy(*by).agg(F.min("offset").alias("from_offset"), F.max("offset").alias("to_offset"))


def roster(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Keys whose last event is an arrival."""
    return events.groupBy(key).agg(F.max_by("present", F.struct(*order)).alias("present")).filter("present").select(key)


def gap_classes(beats: DataFrame, by: str, ts: str, timeout_s: float, lost_s: float) -> DataFrame:
    """Each silence over the timeout: Recovered when shorter than the reconnect window, else Lost."""
    w = Window.partitionBy(by).orderBy(ts)
    gap = (F.unix_micros(F.lead(ts).over(w)) - F.unix_micros(ts)) / 1e6
    return beats.withColumn("gap", gap).filter(F.col("gap") > timeout_s).select(by, ts, "gap", F.when(F.col("gap") < lost_s, "Recovered").otherwise("Lost").alias("event"))
