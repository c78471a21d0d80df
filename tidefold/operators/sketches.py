"""Mergeable sketches as relations: registers, cells, words and buckets, merged by max, bit-or or sum."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefold.functions.hashing import murmur3


def hll_registers(rows: DataFrame, keys: list[str], item: str, p: int = 14) -> DataFrame:
    """key..., idx, rho: the highest rank of a set bit for each register of a 32-bit hash."""
    h = F.col("__h")
    hashed = rows.filter(F.col(item).isNotNull()).select(*keys, murmur3(F.col(item).cast("string")).alias("__h"))
    rest = h.bitwiseAND(F.lit((1 << (32 - p)) - 1))
    width = F.when(rest == 0, 0).otherwise(F.length(F.ltrim(F.bin(rest))))
    return hashed.select(*keys, F.shiftright(h, 32 - p).cast("int").alias("idx"), (F.lit(32 - p + 1) - width).cast("int").alias("rho")).groupBy(*keys, "idx").agg(F.max("rho").alias("rho"))


def hll_merge(registers: DataFrame, keys: list[str]) -> DataFrame:
    return registers.groupBy(*keys, "idx").agg(F.max("rho").alias("rho"))


def hll_estimate(registers: DataFrame, keys: list[str], p: int = 14) -> DataFrame:
    """key..., estimate: the raw harmonic estimate, linear counting while it is at most 2.5 m and registers are empty."""
    m = 1 << p
    alpha = {4: 0.673, 5: 0.697, 6: 0.709}.get(p, 0.7213 / (1 + 1.079 / m))
    s = registers.groupBy(*keys).agg(F.count(F.lit(1)).alias("used"), F.sum(F.pow(F.lit(2.0), -F.col("rho"))).alias("inv"))
    zeros = F.lit(m) - F.col("used")
    raw = F.lit(alpha * m * m) / (F.col("inv") + zeros)
    linear = F.lit(float(m)) * F.log(F.lit(float(m)) / zeros)
    return s.select(*keys, F.when((raw <= 2.5 * m) & (zeros > 0), linear).otherwise(raw).alias("estimate"))


def cms_cells(rows: DataFrame, keys: list[str], item: str, width: int, depth: int) -> DataFrame:
    """key..., row, col, count of one writer: row i hashes with seed i."""
    cols = F.array(*(F.struct(F.lit(i).alias("row"), (murmur3(F.col(item).cast("string"), i) % width).alias("col")) for i in range(depth)))
    return rows.select(*keys, F.explode(cols).alias("c")).groupBy(*keys, "c.row", "c.col").agg(F.count(F.lit(1)).alias("count"))


def cms_merge(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Merging takes the maximum of each cell, so a replica's state may be merged again."""
    return cells.groupBy(*keys, "row", "col").agg(F.max("count").alias("count"))


def cms_estimate(cells: DataFrame, items: DataFrame, item: str, width: int, depth: int) -> DataFrame:
    cols = F.array(*(F.struct(F.lit(i).alias("row"), (murmur3(F.col(item).cast("string"), i) % width).alias("col")) for i in range(depth)))
    probe = items.select(item, F.explode(cols).alias("c")).select(item, "c.row", "c.col")
    return probe.join(cells, ["row", "col"], "left").groupBy(item).agg(F.min(F.coalesce("count", F.lit(0))).alias("estimate"))


def bloom_size(n: int, fpr: float) -> tuple[int, int]:
    bits = max(1, math.ceil(-n * math.log(fpr) / math.log(2) ** 2))
    return bits, max(1, round(bits / n * math.log(2)))


def _bloom_bits(item: str, bits: int, hashes: int) -> Column:
    a, b = murmur3(F.col(item).cast("string"), 0), murmur3(F.col(item).cast("string"), 1)
    return F.array(*(((a + F.lit(i) * b) % bits) for i in range(hashes)))


def bloom_words(rows: DataFrame, keys: list[str], item: str, bits: int, hashes: int) -> DataFrame:
    """key..., word, bits: 64 filter bits to a row, merged by bit-or."""
    each = rows.select(*keys, F.explode(_bloom_bits(item, bits, hashes)).alias("b"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("b") % 64).cast("int"))
    return each.select(*keys, F.floor(F.col("b") / 64).alias("word"), one.alias("one")).groupBy(*keys, "word").agg(F.bit_or("one").alias("bits"))


def bloom_contains(words: DataFrame, items: DataFrame, item: str, bits: int, hashes: int) -> DataFrame:
    probe = items.select(item, F.explode(_bloom_bits(item, bits, hashes)).alias("b")).select(item, F.floor(F.col("b") / 64).alias("word"), (F.col("b") % 64).cast("int").alias("at"))
    hit = F.call_function("shiftright", F.coalesce("bits", F.lit(0).cast("long")), F.col("at")).bitwiseAND(F.lit(1).cast("long")) == 1
    return probe.join(words, "word", "left").groupBy(item).agg(F.bool_and(hit).alias("contains"))


def dd_cells(rows: DataFrame, keys: list[str], value: str, alpha: float = 0.01, low: float = 1e-9, high: float = 1e18) -> DataFrame:
    """key..., part, idx, count: log buckets of positive and negative magnitudes, zeros, and what lies over high."""
    v, mag = F.col(value), F.least(F.abs(F.col(value)), F.lit(high))
    idx = F.ceil(F.log(mag) / F.lit(math.log((1 + alpha) / (1 - alpha)))).cast("int")
    part = F.when(F.abs(v) < low, "0").when(v > 0, "+").otherwise("-")
    cells = rows.filter(v.isNotNull()).select(*keys, part.alias("part"), F.when(F.abs(v) < low, 0).otherwise(idx).alias("idx"), (F.abs(v) > high).cast("long").alias("over"))
    return cells.groupBy(*keys, "part", "idx").agg(F.count(F.lit(1)).alias("count"), F.sum("over").alias("overflow"))


def dd_quantiles(cells: DataFrame, keys: list[str], qs: list[float], alpha: float = 0.01) -> DataFrame:
    """key..., q, value: the first bucket whose running count exceeds q (n - 1), negatives from the largest magnitude, zeros, positives."""
    gamma = (1 + alpha) / (1 - alpha)
    merged = cells.groupBy(*keys, "part", "idx").agg(F.sum("count").alias("count"))
    place = F.when(F.col("part") == "-", F.struct(F.lit(0).alias("p"), (-F.col("idx")).alias("i"))).when(F.col("part") == "0", F.struct(F.lit(1).alias("p"), F.lit(0).alias("i"))).otherwise(F.struct(F.lit(2).alias("p"), F.col("idx").alias("i")))
    over = Window.partitionBy(*keys).orderBy("place") if keys else Window.partitionBy(F.lit(0)).orderBy("place")
    total = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    run = merged.withColumn("place", place).withColumn("cum", F.sum("count").over(over)).withColumn("n", F.sum("count").over(total))
    mid = F.pow(F.lit(gamma), F.col("idx")) * 2 / (1 + gamma)
    rep = F.when(F.col("part") == "0", 0.0).when(F.col("part") == "-", -mid).otherwise(mid)
    each = run.withColumn("value", rep).withColumn("q", F.explode(F.array(*map(F.lit, qs)))).filter(F.col("cum") > F.col("q") * (F.col("n") - 1))
    return each.groupBy(*keys, "q").agg(F.min_by("value", "place").alias("value"))


def histogram(rows: DataFrame, keys: list[str], value: str, bounds: list[float]) -> DataFrame:
    """key..., bucket, count, sum: buckets (b[i-1], b[i]], open at both ends of the list."""
    bucket = F.lit(len(bounds))
    for i in reversed(range(len(bounds))):
        bucket = F.when(F.col(value) <= bounds[i], i).otherwise(bucket)
    return rows.select(*keys, bucket.alias("bucket"), F.col(value).alias("v")).groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("count"), F.sum(F.col("v").cast("decimal(20,4)")).cast("double").alias("sum"))


def exponential_histogram(cells: DataFrame, keys: list[str]) -> DataFrame:
    """key..., offset, counts: positive buckets made dense from the least index; offset is that index less one."""
    pos = cells.filter("part = '+'").groupBy(*keys, "idx").agg(F.sum("count").alias("count"))
    span = pos.groupBy(*keys).agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    dense = span.select(*keys, "lo", F.explode(F.sequence("lo", "hi")).alias("idx"))
    full = dense.join(pos, [*keys, "idx"], "left").select(*keys, "lo", "idx", F.coalesce("count", F.lit(0)).alias("count"))
    return full.groupBy(*keys).agg((F.min("lo") - 1).alias("offset"), F.transform(F.array_sort(F.collect_list(F.struct("idx", "count"))), lambda x: x["count"]).alias("counts"))


def alpha_for_scale(scale: int) -> float:
    g = 2.0 ** (2.0**-scale)
    return (g - 1) / (g + 1)


def scale_for_alpha(alpha: float) -> int:
    return math.floor(-math.log2(math.log2((1 + alpha) / (1 - alpha))) + 0.5)
