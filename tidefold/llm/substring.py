r"""Substring dedup: hash normalised lines or paragraphs, group the digests over the corpus, keep the earliest occurrence.

Words are runs of letters, digits and combining marks, each in NFKC and lower case; punctuation and spacing play no
part. A unit is a line (or, as an option, a paragraph, or a sentence within a line) with at least one word. Its digest
is 128 bits over its words. Occurrences rank by document - doc_id, nulls last, then the text's hash, so that different
texts that share a doc_id are different documents - and by position. The earliest one stays, every other one is removed,
whatever its length. min_words is an option for callers that want short formulas left in place.

A passage may begin and end inside units, or lie within one. So windows of WINDOW words, picked by winnowing (the least
hash of each SPREAD neighbours), are hashed and ranked as units are; a repeated window is removed too, and overlapping
cuts are one passage. Two texts that share WINDOW + SPREAD - 1 words share a picked window, so no such copy stays whole;
fewer than SPREAD words may stay at either end of one that lies inside units.

Null and empty texts, and texts without words, have no units and nothing removed. Repeated rows (equal doc_id and text)
are one document, whose cuts hold for each of them. Only doc_id and text are read; other columns, whatever their names,
are left out of the reports and kept by deduplicated(). An empty table gives no rows. Very long texts: a text's
words are arrays in one task, about 100 bytes a character at the peak; batches go in slices of SLICE characters, and
no step is worse than n log n in a text's length.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidefold.llm.common import staged, unused

#: Words of a hashed window, and of how many neighbouring windows the least is taken: every 50 shared words hold one.
WINDOW, SPREAD = 25, 26
#: What parts a text into units; None stands for line breaks, which need no pattern.
UNITS = {"line": None, "paragraph": re.compile(r"\n[^\S\n]*\n\s*"), "sentence": re.compile(r"\n|(?<=[.!?])\s+")}
#: Digests whose keeper's doc_id several texts share: up to so many are broadcast, beyond it they are joined by a shuffle.
BROADCAST_TIES = 100_000
#: Characters of the texts whose rows make one Arrow batch.
SLICE = 1_000_000

#: Odd multipliers of the two 64-bit halves, over characters and over words, and what sets windows apart from units.
_CHARS = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], dtype=np.uint64)
_WORDS = np.array([0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F], dtype=np.uint64)
_WINDOWED = np.uint64(0x5851F42D4C957F2D)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: whether words hold it, and its lower case (itself where that is more than one code point)."""
    every = [chr(i) for i in range(0x110000)]
    inside = np.array([c.isalnum() or unicodedata.category(c)[0] == "M" for c in every])
    low = np.arange(0x110000, dtype=np.uint32)
    for i, c in enumerate(every):
        x = c.lower()
        if x != c and len(x) == 1:
            low[i] = ord(x)
    return inside, low


@lru_cache(maxsize=1)
def _powers(n: int) -> np.ndarray:
    out = np.ones((4, n), dtype=np.uint64)
    for row, base in zip(out, (*_CHARS, *_WORDS)):
        row[1:] = base
        np.multiply.accumulate(row, out=row)
    return out


def powers(n: int) -> np.ndarray:
    """The multipliers' powers from 0 to at least n - 1, modulo 2**64."""
    return _powers(1 << max(12, int(n - 1).bit_length()))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _coded(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def hashed_words(text: str, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of a text's words in code points, and the words' two hashes (2 rows)."""
    inside, low = _tables()
    held = inside[codes]
    edges = np.flatnonzero(np.diff(held, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return starts, ends, np.empty((2, 0), dtype=np.uint64)
    if unicodedata.is_normalized("NFKC", text):
        chars, lengths = low[codes[held]], ends - starts
    else:
        forms = [unicodedata.normalize("NFKC", text[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
        chars, lengths = low[_coded("".join(forms))], np.fromiter(map(len, forms), dtype=np.int64, count=len(forms))
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(chars)) - np.repeat(first, lengths)
    weight, chars = powers(int(lengths.max())), chars.astype(np.uint64) + np.uint64(1)
    return starts, ends, np.stack([_mixed(np.add.reduceat(chars * weight[j][place], first)) for j in (0, 1)])


def _unit_bounds(text: str, codes: np.ndarray, apart: re.Pattern | None) -> tuple[np.ndarray, np.ndarray]:
    if apart is None:
        cut = np.flatnonzero(codes == 10)
        return np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(codes)]])
    found = [m.span() for m in apart.finditer(text)]
    return np.array([0, *(b for _, b in found)]), np.array([*(a for a, _ in found), len(codes)])


def windows(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The picked windows' first words, and their digests (2 rows); h: the words' hashes."""
    n = h.shape[1] - WINDOW + 1
    if n < 1:
        return np.empty(0, dtype=np.int64), np.empty((2, 0), dtype=np.uint64)
    weight, out = powers(WINDOW), np.zeros((2, n), dtype=np.uint64)
    for j in range(WINDOW):
        out += h[:, j : j + n] * weight[2:, j, None]
    out = _mixed(out ^ _WINDOWED)
    near = min(SPREAD, n)
    at = np.unique(np.arange(n - near + 1) + np.lib.stride_tricks.sliding_window_view(out[0], near).argmin(axis=1))
    return at, out[:, at]


def marks(text: str, unit: str = "line") -> tuple[np.ndarray, np.ndarray]:
    """Of each unit with words, then of each picked window: start, end, first word, number of words, whether it is a window, whether
    an equal one stands before it in the text (6 columns); and the digests (2 rows)."""
    codes = _coded(text)
    starts, ends, h = hashed_words(text, codes)
    if not len(starts):
        return np.empty((0, 6), dtype=np.int64), np.empty((2, 0), dtype=np.uint64)
    a, b = _unit_bounds(text, codes, UNITS[unit])
    owner = np.searchsorted(a, starts, side="right") - 1
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    held = np.diff(first, append=len(starts))
    place = np.arange(len(starts)) - np.repeat(first, held)
    weight = powers(int(held.max()))
    whole = np.stack([_mixed(np.add.reduceat(h[j] * weight[2 + j][place], first)) for j in (0, 1)])
    at, part = windows(h)
    units = np.stack([a[owner[first]], b[owner[first]], first, held, np.zeros_like(first)], axis=1)
    picked = np.stack([starts[at], ends[at + WINDOW - 1], at, np.full_like(at, WINDOW), np.ones_like(at)], axis=1)
    digests = np.concatenate([whole, part], axis=1)
    again = np.ones(digests.shape[1], dtype=np.int64)
    again[np.unique(digests[0], return_index=True)[1]] = 0
    return np.column_stack([np.concatenate([units, picked]), again]), digests


_MARK = "s int, e int, v int, n int, window boolean, again boolean, d1 long, d2 long"


def _marker(unit: str):
    def run(batches):
        for batch in batches:
            texts, found, size, start = batch.column("text"), [], 0, 0
            for i in range(len(texts)):
                text = texts[i].as_py()
                found.append(marks(text, unit))
                size += len(text)
                if size >= SLICE or i == len(texts) - 1:
                    yield _marked(batch, start, found)
                    found, size, start = [], 0, i + 1

    return run


def _marked(batch: pa.RecordBatch, start: int, found: list) -> pa.RecordBatch:
    rows, digests = np.concatenate([x for x, _ in found]), np.concatenate([d for _, d in found], axis=1).view(np.int64)
    owner = pa.array(np.repeat(np.arange(start, start + len(found)), [len(x) for x, _ in found]))
    cols = [pa.array(rows[:, i].astype(np.int32)) for i in range(4)] + [pa.array(rows[:, i].astype(bool)) for i in (4, 5)]
    names = ["doc_id", "h", "s", "e", "v", "n", "window", "again", "d1", "d2"]
    return pa.RecordBatch.from_arrays([batch.column("doc_id").take(owner), batch.column("h").take(owner), *cols, pa.array(digests[0]), pa.array(digests[1])], names)


def _texts(docs: DataFrame) -> DataFrame:
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.col("text") != "")
    return texts.select("doc_id", F.xxhash64("text").alias("h"), "text")


def repeats(docs: DataFrame, unit: str = "line") -> DataFrame:
    """doc_id, h, s, e, v, n, window, keeper: the units and picked windows that are not the earliest of their digest."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = staged(_texts(docs).mapInArrow(_marker(unit), f"doc_id {kind}, h long, {_MARK}"), "substring-marks")
    # minima of fixed-width columns, so that a hash aggregate combines a hot digest's rows before the shuffle
    first = rows.groupBy("d1", "d2").agg(F.min("doc_id").alias("keeper"), F.count(F.lit(1)).alias("seen")).filter(F.col("seen") > 1)
    # joined on the digests' complements: both sides are dealt anew, so that a hot digest's rows may be split
    first = first.select(F.bitwise_not("d1").alias("c1"), F.bitwise_not("d2").alias("c2"), "keeper")
    keyed = rows.withColumns({"k1": F.bitwise_not("d1"), "k2": F.bitwise_not("d2")}).drop("d1", "d2")
    same = keyed.join(first, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2"))).drop("c1", "c2")
    same = staged(same, "substring-same")
    # texts that share the keeper's doc_id: the least hash is the earliest
    lead = same.filter(F.col("doc_id").eqNullSafe(F.col("keeper"))).groupBy("k1", "k2").agg(F.min("h").alias("lead"), F.max("h").alias("last"))
    tied = staged(lead.filter(F.col("lead") != F.col("last")).select(F.bitwise_not("k1").alias("t1"), F.bitwise_not("k2").alias("t2"), "lead"), "substring-tied")
    few = tied.count() <= BROADCAST_TIES
    both = same.withColumns({"k1": F.bitwise_not("k1"), "k2": F.bitwise_not("k2")}).join(F.broadcast(tied) if few else tied.hint("merge"), (F.col("k1") == F.col("t1")) & (F.col("k2") == F.col("t2")), "left")
    earliest = F.col("doc_id").eqNullSafe(F.col("keeper")) & (F.col("lead").isNull() | (F.col("h") == F.col("lead"))) & ~F.col("again")
    return both.filter(~earliest).select("doc_id", "h", "s", "e", "v", "n", "window", "keeper")


def passages(docs: DataFrame, unit: str = "line", min_words: int = 1) -> DataFrame:
    """doc_id, h, start, end, n_words, n_units, n_windows, kept_in: what is to be removed, overlapping cuts as one passage.

    n_units counts the repeated units in a passage, n_windows the repeated windows, kept_in the documents of the earliest occurrences.
    """
    cuts = repeats(docs, unit).dropDuplicates(["doc_id", "h", "window", "s"])
    in_order = Window.partitionBy("doc_id", "h").orderBy("s", "e")
    cuts = cuts.withColumn("reach", F.max("e").over(in_order.rowsBetween(Window.unboundedPreceding, -1)))
    cuts = cuts.withColumn("passage", F.sum(F.when(F.col("s") < F.col("reach"), 0).otherwise(1)).over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    made = cuts.groupBy("doc_id", "h", "passage").agg(
        F.min("s").cast("long").alias("start"), F.max("e").cast("long").alias("end"), (F.max(F.col("v") + F.col("n")) - F.min("v")).cast("long").alias("n_words"),
        F.count_if(~F.col("window")).alias("n_units"), F.count_if("window").alias("n_windows"), F.array_sort(F.collect_set("keeper")).alias("kept_in")).drop("passage")
    return made.filter(F.col("n_words") >= min_words)


def repeated_passages(docs: DataFrame, unit: str = "line", min_words: int = 1) -> DataFrame:
    """doc_id, n_passages, n_words, n_units, n_windows, spans, kept_in: a row for each document with something to remove.

    spans holds start:end of each passage in code points, in order, comma-joined; n_windows counts the repeated windows of
    WINDOW words, so it tells long passages from short lines.
    """
    ordered = F.array_sort(F.collect_list(F.struct("start", "end")))
    total = [F.sum(c).alias(c) for c in ("n_words", "n_units", "n_windows")]
    made = passages(docs, unit, min_words).groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n_passages"), *total, ordered.alias("at"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("kept_in")))).alias("kept_in"))
    spans = F.array_join(F.transform("at", lambda x: F.concat(x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",")
    return made.select("doc_id", "n_passages", "n_words", "n_units", "n_windows", spans.alias("spans"), "kept_in")


def deduplicated(docs: DataFrame, unit: str = "line", min_words: int = 1) -> DataFrame:
    """docs with the repeated passages cut out of text; documents without any stay as they are, and so do other columns."""
    key, hash_, cuts = unused(docs, "__id", "__h", "__cuts")
    found = passages(docs, unit, min_words).groupBy("doc_id", "h").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(cuts))
    found = found.select(F.col("doc_id").alias(key), F.col("h").alias(hash_), cuts)
    both = docs.join(found, docs["doc_id"].eqNullSafe(F.col(key)) & (F.xxhash64(docs["text"].cast("string")) == F.col(hash_)), "left")
    text = F.col("text").cast("string")
    # only texts with cuts travel to Python
    left = F.pandas_udf(_without, "string")(F.when(F.col(cuts).isNotNull(), text), cuts)
    return both.withColumn("text", F.when(F.col(cuts).isNull(), text).otherwise(left)).select(*docs.columns)


def _without(text: pd.Series, cuts: pd.Series) -> pd.Series:
    def cut(t, spans):
        if t is None:
            return None
        bounds = [0, *(x for s in spans for x in (s["start"], s["end"])), len(t)]
        return "".join(t[a:b] for a, b in zip(bounds[::2], bounds[1::2]))

    return pd.Series([cut(t, s) for t, s in zip(text, cuts)], dtype=object)
