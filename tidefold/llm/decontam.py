"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

The alphabet is words, the patterns are windows of 10 consecutive benchmark words (an item of fewer words is
one window). Patterns of one length form one searcher: a shift table over blocks of two words skips positions
that cannot end a pattern, buckets by the final block select the patterns, and a comparison of all words
confirms an occurrence.

The benchmark's patterns reach the workers by a broadcast, in blocks: items are dealt by a hash into as many
blocks as keep each under block_bytes, and every block searches all documents. One block is the usual case;
more blocks' hits are put together by document, interval by interval.

Null texts have no words. A null item_id still marks hits but is not listed. Repeated items count once.
Only doc_id and text, item_id and text are read. Empty tables: no documents give no rows, no items no hits.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import staged

WINDOW = 10
#: Text bytes of the benchmark in one broadcast block. A worker's searchers take about 115 times as much memory.
BLOCK_BYTES = 2 << 20

#: Lower-cases A-Z and turns every ASCII byte that is in no word into a space; bytes of other characters stay.
_TO_WORDS = bytes(b | 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


class WuManber:
    """Searches word sequences for patterns of one length."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], set]):
        self.length, self.block = length, min(2, length)
        self.far = length - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = defaultdict(dict)
        for pattern, items in patterns.items():
            for end in range(self.block, length + 1):
                key = self._block(pattern, end)
                self.shift[key] = min(self.shift.get(key, self.far), length - end)
            self.buckets[self._block(pattern, length)][pattern] = items

    def _block(self, seq, end: int):
        return seq[end - 1] if self.block == 1 else (seq[end - 2], seq[end - 1])

    def find(self, seq: list[bytes]):
        """(start, items) of every occurrence, by start."""
        end, n, shift, far, m = self.length, len(seq), self.shift, self.far, self.length
        while end <= n:
            key = self._block(seq, end)
            step = shift.get(key, far)
            if step:
                end += step
                continue
            items = self.buckets[key].get(tuple(seq[end - m : end]))
            if items is not None:
                yield end - m, items
            end += 1


def searchers(items: list[tuple[str | None, str | None]]) -> list[WuManber]:
    by_length: dict[int, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))
    for item_id, text in items:
        w = words(text)
        m = min(WINDOW, len(w))
        if m:
            for i in range(len(w) - m + 1):
                by_length[m][tuple(w[i : i + m])].add(item_id)
    return [WuManber(m, patterns) for m, patterns in sorted(by_length.items())]


def search(seq: list[bytes], machines: list[WuManber]) -> tuple[list[tuple[int, int]], set]:
    """Covered word intervals, ordered and disjoint, and the items found."""
    raw, found = [], set()
    for machine in machines:
        for start, items in machine.find(seq):
            found |= items
            if raw and raw[-1][0] <= start <= raw[-1][1]:
                raw[-1][1] = max(raw[-1][1], start + machine.length)
            else:
                raw.append([start, start + machine.length])
    return merged(raw), found


def merged(intervals) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


_OUT = "doc_id {id}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _judged(n, intervals, found) -> dict:
    ids = sorted(x for x in found if x is not None)
    hit = sum(b - a for a, b in intervals)
    return {"n_words": n, "n_hit": hit, "n_items": len(ids), "items_sha256": hashlib.sha256(",".join(ids).encode()).hexdigest(), "contaminated": hit > 0}


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each document."""
    sc = docs.sparkSession.sparkContext
    kind = docs.schema["doc_id"].dataType.simpleString()
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    if blocks == 1:
        held = sc.broadcast([tuple(r) for r in items.collect()])
        return texts.mapInArrow(_searching(held), _OUT.format(id=kind))
    keyed = staged(texts.withColumn("row", F.monotonically_increasing_id()), "decontam-texts")
    parts = None
    for k in range(blocks):
        held = sc.broadcast([tuple(r) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()])
        part = staged(keyed.mapInArrow(_partial(held), f"row long, doc_id {kind}, n_words long, found array<string>, starts array<int>, ends array<int>"), "decontam-hits")
        held.unpersist()
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("row").applyInArrow(_together, _OUT.format(id=kind))


def _searching(held):
    def run(batches):
        machines = searchers(held.value)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                seq = words(text)
                rows.append(_judged(len(seq), *search(seq, machines)))
            yield _beside(batch, ["doc_id"], rows, _JUDGED)

    return run


_JUDGED = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])
_FOUND = pa.schema([("n_words", pa.int64()), ("found", pa.list_(pa.string())), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])


def _beside(batch: pa.RecordBatch, keys: list[str], rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    made = pa.RecordBatch.from_pylist(rows, schema=schema)
    return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *made.columns], [*keys, *schema.names])


def _partial(held):
    def run(batches):
        machines = searchers(held.value)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                seq = words(text)
                spans, found = search(seq, machines)
                rows.append({"n_words": len(seq), "found": sorted(x for x in found if x is not None), "starts": [a for a, _ in spans], "ends": [b for _, b in spans]})
            yield _beside(batch, ["row", "doc_id"], rows, _FOUND)

    return run


def _together(group: pa.Table) -> pa.Table:
    """One row for each block of the benchmark, so a group is as large as the number of blocks."""
    parts = group.to_pylist()
    spans = merged((a, b) for p in parts for a, b in zip(p["starts"], p["ends"]))
    found = {x for p in parts for x in p["found"]}
    one = pa.RecordBatch.from_arrays([group.column("doc_id").slice(0, 1).combine_chunks()], ["doc_id"]) if group.num_rows else None
    return pa.Table.from_batches([_beside(one, ["doc_id"], [_judged(parts[0]["n_words"], spans, found)], _JUDGED)])


def _filtering(held):
    def run(batches):
        machines = searchers(held.value)
        for batch in batches:
            clean = [not search(words(text), machines)[0] for text in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return run


def without_contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs less the rows in which a benchmark window occurs; columns and types stay. One pass for each block of the benchmark."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    for k in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        docs = docs.mapInArrow(_filtering(docs.sparkSession.sparkContext.broadcast([tuple(r) for r in part.collect()])), docs.schema)
        if k + 1 < blocks:  # a table between, so that a task holds one block's searchers
            docs = staged(docs, "decontam-rest")
    return docs
