r"""Secret scans: multipart credential linking, in built-in functions only.

Strong parts (labelled assignments, access identifiers, long hex) always count. Weak parts (an unlabelled token of
20 or more mixed characters, an identifier such as client_id=..., an endpoint) say nothing alone; they are reported
only when a complementary part that does not overlap them starts within SCOPE code points: a secret beside an
identifier or an endpoint, an identifier or endpoint beside a secret. That is an interval join: parts fall into
buckets one scope wide, the complement is laid out in its own and both neighbouring buckets, and a semi join on
(document, bucket) checks the distance. The texts are read once: all parts go to a table in the shared folder,
from which the join and the result are taken.

Null texts count as empty and have no spans. Rows are keyed by doc_id (nulls equal nulls) and a hash of the text, so
repeated rows get equal results. Other columns, whatever their names, are left out. An empty table gives an empty result.
Very long texts: each pattern is matched by possessive loops without recursion or rescanning, so a text costs time in
proportion to its length; its matches go through folds of 512, and a bucket holds at most SCOPE parts of a kind, so
the join stays in proportion to the parts, however many one document has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import let, same_row, spans_if, spans_of, staged, tagged

SCOPE = 400
KINDS = ("assign", "access", "hex", "weak_secret", "identifier", "endpoint")

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = r"(?i:password|passwd|secret|token|api_?key)"
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"

WEAK_SECRET = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/=_-])"
IDENTIFIER = r"""(?i:access_?key_?id|client_?id|user_?name|login|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
ENDPOINT = r"""(?i:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]++|(?i:endpoint|host|hostname|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"""


def base_spans(text: Column) -> dict[str, Column]:
    """The strong parts by kind."""
    return {
        "assign": spans_if(text.rlike(ASSIGN_HINT), spans_of(text, ASSIGN, keep=lambda _, value: F.char_length(value) >= 6, group=1)),
        "access": spans_if(F.contains(text, F.lit("AKIA")), spans_of(text, ACCESS)),
        "hex": spans_if(text.rlike(HEX), spans_of(text, HEX)),
    }


def _mixed(token: Column, _: Column) -> Column:
    return token.rlike("[0-9]") & token.rlike("[a-z]") & token.rlike("[A-Z]")


def weak_spans(text: Column) -> dict[str, Column]:
    return {
        "weak_secret": spans_if(text.rlike(WEAK_SECRET), spans_of(text, WEAK_SECRET, keep=_mixed)),
        "identifier": spans_if(text.rlike(IDENTIFIER), spans_of(text, IDENTIFIER)),
        "endpoint": spans_if(text.rlike(ENDPOINT), spans_of(text, ENDPOINT)),
    }


_ROLE = {"assign": "S", "access": "A", "hex": "S", "weak_secret": "S", "identifier": "A", "endpoint": "E"}


def linked_parts(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, h, linked: the weak parts that have a complement in scope. found: doc_id, h, parts (tagged spans)."""
    some = found.filter(F.exists("parts", lambda p: p["o"] >= 3)).select("doc_id", "h", F.explode("parts").alias("p"))
    role = F.element_at(F.create_map(*(F.lit(x) for kv in _ROLE.items() for x in kv)), F.col("p.k"))
    parts = some.select("doc_id", "h", "p", role.alias("role"), F.floor(F.col("p.s") / scope).alias("b"))
    weak = parts.filter(F.col("p.o") >= 3)
    near = parts.select("doc_id", "h", F.col("p.s").alias("at"), F.col("p.e").alias("upto"), F.col("role").alias("other"), F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)).alias("b2"))
    complement = ((weak["role"] == "S") & near["other"].isin("A", "E")) | (weak["role"].isin("A", "E") & (near["other"] == "S"))
    apart = (near["upto"] <= weak["p.s"]) | (near["at"] >= weak["p.e"])
    hit = weak.join(near, same_row(weak, near) & (weak["b"] == near["b2"]) & complement & apart & (F.abs(weak["p.s"] - near["at"]) <= scope), "left_semi")
    return hit.groupBy("doc_id", "h").agg(F.collect_set("p").alias("linked"))


def secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per document: counts and spans (array of s, o, e, k: start, kind's place, end, kind), base and all."""
    text = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    spans = base_spans(F.col("t")) | weak_spans(F.col("t"))
    parts = F.concat(*(tagged(spans[k], k, KINDS.index(k)) for k in KINDS))
    found = staged(text.select("doc_id", F.xxhash64("t").alias("h"), parts.alias("parts")), "secrets-parts")
    linked = linked_parts(found, scope)
    count = lambda i: F.size(F.filter("parts", lambda p: p["o"] == i)).cast("bigint")
    found = found.select("doc_id", "h", *(count(i).alias(f"n_{KINDS[i]}") for i in range(3)), F.array_sort(F.filter("parts", lambda p: p["o"] < 3)).alias("base"))
    both = found.join(linked, same_row(found, linked), "left").select(found["*"], linked["linked"])
    return both.withColumn("all", let(F.col("base"), lambda b: F.when(F.col("linked").isNull(), b).otherwise(F.array_sort(F.concat(b, F.col("linked"))))))
