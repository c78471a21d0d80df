"""Helpers that several training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.sources.staging import staged  # noqa: F401

#: ASCII white space as a Java character class body: space, tab, line feed, vertical tab, form feed, return.
ASCII_SPACE = r" \t-\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until they clash with no column of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def let(value: Column, body) -> Column:
    """body(x) with x bound to value, which is evaluated once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def own_key(name: str) -> Column:
    """The same string under an expression that the planner does not identify with the column.

    An aggregate's output is already dealt by its key; a join on that key would take it as it lies and
    then could not split a hot key. Joining on this copy deals both sides anew, so that adaptive
    execution may split a skewed partition of the larger side.
    """
    return F.concat(F.col(name), F.lit(""))


#: Elements that one inner fold of scanned() takes.
FOLD = 512


def scanned(rows: Column, state: Column, made: str, step, within=None) -> Column:
    """struct<at, out>: a fold over the array rows that emits as it goes. step(at, x[, w]) gives the next state and an array to emit.

    Built-in folds copy what they have gathered at each step, so rows go in blocks of FOLD: the copies
    stay short, and n rows cost about n * FOLD / 2 moves. within(at, block), if given, is evaluated once a block
    and handed to step. made is the type of the emitted array.
    """

    def fold(at: Column, block: Column, w: Column | None) -> Column:
        def one(acc: Column, x: Column) -> Column:
            then, more = step(acc["at"], x) if w is None else step(acc["at"], x, w)
            return F.struct(then.alias("at"), F.concat(acc["out"], more).alias("out"))

        return F.aggregate(block, F.struct(at.alias("at"), F.array().cast(made).alias("out")), one)

    def outer(acc: Column, block: Column) -> Column:
        inner = fold(acc["at"], block, None) if within is None else let(within(acc["at"], block), lambda w: fold(acc["at"], block, w))
        return let(inner, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

    def blocks(r: Column) -> Column:
        starts = F.when(F.size(r) > 0, F.sequence(F.lit(1), F.size(r), F.lit(FOLD))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.slice(r, i, F.lit(FOLD)))

    start = F.struct(state.alias("at"), F.array().cast(f"array<{made}>").alias("out"))
    return F.aggregate(let(rows, blocks), start, outer, lambda acc: F.struct(acc["at"].alias("at"), F.flatten(acc["out"]).alias("out")))


_SPANS, _MATCHES = "array<struct<s:int,e:int>>", "array<struct<s:int,e:int,w:string>>"


def matches(text: Column, pattern: str, keep=None, group: int | None = None) -> Column:
    """Leftmost non-overlapping matches of a Java pattern as array<struct<s, e, w>>: start, end in code points, the match.

    Splitting by the pattern and extracting its matches walk over the same matches, so the pieces'
    lengths add up to the positions. keep(match, group) drops matches afterwards, without a retry.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else None
    ok = lambda w, g: (keep(w, g) if keep else F.lit(True)).alias("ok")
    found = F.zip_with(whole, part, lambda w, g: F.struct(w.alias("w"), ok(w, g))) if group else F.transform(whole, lambda w: F.struct(w.alias("w"), ok(w, w)))
    # there is one piece more than there are matches
    rows = F.zip_with(F.split(text, pattern, -1), found, lambda p, f: F.struct(F.char_length(p).alias("p"), f["w"].alias("w"), f["ok"].alias("ok")))

    def step(at: Column, x: Column):
        s, e = at + x["p"], at + x["p"] + F.char_length(x["w"])
        one = F.array(F.struct(s.alias("s"), e.alias("e"), x["w"].alias("w")))
        return F.coalesce(e, s), F.when(x["ok"], one).otherwise(F.array().cast(_MATCHES))

    return scanned(rows, F.lit(0), _MATCHES, step)["out"]


def spans_of(text: Column, pattern: str, keep=None, group: int | None = None) -> Column:
    """The places of matches() alone: array<struct<s, e>>."""
    return F.transform(matches(text, pattern, keep, group), lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e")))


def spans_if(guard: Column, spans: Column, of=spans_of) -> Column:
    """spans where the guard holds, else none; of: what made them, spans_of or matches."""
    return F.when(guard, spans).otherwise(F.array().cast(_SPANS if of is spans_of else _MATCHES))


def tagged(spans: Column, kind: str, order: int) -> Column:
    """array<struct<s, o, e, k>>: sorts by start, then by the kind's place in the list."""
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(order).alias("o"), x["e"].alias("e"), F.lit(kind).alias("k")))


def joined(spans: Column) -> Column:
    """kind:start:end of tagged spans, comma-joined in the order given."""
    return F.array_join(F.transform(spans, lambda x: F.concat(x["k"], F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))), ",")


def same_row(a: DataFrame, b: DataFrame) -> Column:
    """Rows of one document: equal doc_id, or both null, and equal text hash in column h."""
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["h"] == b["h"])
