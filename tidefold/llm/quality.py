"""Quality rules: one threshold table compiled into a single Spark projection, without user functions.

Nulls and empty texts have no words and fail the base rule. Rows are judged one by one, so repeated rows
get equal results. Only doc_id and text are read; other columns, whatever their names, are left out. An empty table gives an
empty result. Very long texts: a text's words and window hashes are arrays in one row, sorted once; no length is turned away.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import ASCII_SPACE, let

#: Symbols that are counted, fixed by the result's definition.
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it as for was on with by are this from at "
    "der die das und den von zu mit sich ein eine nicht ist im dem auf für "
    "le la les de des et en un une que qui dans pour est du sur par "
    "el los las del y se por con una su para es al lo como no"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes when low <= metric <= high; a missing bound is open."""

    metric: str
    low: float | None = None
    high: float | None = None


#: The threshold table. Ratios are to words, or to lines for line ratios.
RULES = (
    Rule("n_words", low=20),
    Rule("mean_word_chars", low=2.0, high=15.0),
    Rule("symbol_ratio", high=0.2),
    Rule("stop_word_ratio", low=0.02),
    Rule("dup_line_ratio", high=0.5),
)


def compiled(rules, metrics: dict[str, Column]) -> Column:
    """The conjunction of all rules as one expression."""
    verdict = F.lit(True)
    for rule in rules:
        value = metrics[rule.metric]
        if rule.low is not None:
            verdict = verdict & (value >= F.lit(rule.low))
        if rule.high is not None:
            verdict = verdict & (value <= F.lit(rule.high))
    return verdict


def _window_hashes(words: Column) -> Column:
    hashed = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW))))
    return F.when(F.size(words) >= WINDOW, hashed).otherwise(F.array().cast("array<bigint>"))


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more. Windows are compared by 64-bit hashes within one text."""

    def starts(s: Column) -> Column:
        again = F.transform(s, lambda x, j: F.when((F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]), x["i"]))
        return F.array_sort(F.filter(again, lambda i: i.isNotNull()))

    def width(st: Column) -> Column:
        steps = F.zip_with(st, F.slice(st, F.lit(2), F.size(st)), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))

    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(let(ordered, starts), width)).otherwise(F.lit(0).cast("bigint"))


def quality(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id with every metric, base_failed and kept."""
    text = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    cut = text.select(
        "doc_id", "t",
        F.filter(F.split("t", f"[{ASCII_SPACE}]+"), lambda w: w != "").alias("w"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{ASCII_SPACE}]")).alias("lines"),
    )
    hashed = cut.withColumn("hashes", _window_hashes(F.col("w")))
    long = lambda c: c.cast("bigint")
    counts = hashed.select(
        "doc_id",
        long(F.size("w")).alias("n_words"),
        long(F.char_length(F.translate("t", " \t\n\x0b\f\r", ""))).alias("word_chars"),
        long(F.char_length("t") - F.char_length(F.translate("t", SYMBOLS, ""))).alias("n_symbols"),
        long(F.size("lines")).alias("n_lines"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        _covered(F.col("hashes")).alias("n_repeat_words"),
        long(F.size(F.filter("w", lambda x: F.lower(x).isin(STOP_WORDS)))).alias("n_stop_words"),
    )
    n = F.col("n_words")
    per = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    metrics = {
        "n_words": n,
        "mean_word_chars": per("word_chars", "n_words"),
        "symbol_ratio": per("n_symbols", "n_words"),
        "stop_word_ratio": per("n_stop_words", "n_words"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"),
    }
    failed = (n < 20) | (100 * F.col("n_repeat_words") > 30 * n)
    return counts.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words",
        failed.alias("base_failed"),
        (~failed & compiled(rules, metrics)).alias("kept"),
    )
