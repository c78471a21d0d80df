"""Streaming forms. Merges are order-free, so a stream of deltas is a grouped aggregate in update mode; late and repeated rows are harmless."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def tail(stream: DataFrame, ids: list[str], ts: str, late: str = "10 minutes") -> DataFrame:
    """Each record once: repeats within the lateness bound go; ts may be a timestamp without time zone."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(ids)


def counters(stream: DataFrame, keys: list[str], count: str = "count") -> DataFrame:
    """Per key and replica the largest count so far; state and delta rows have one schema."""
    return stream.groupBy(*keys, "replica").agg(F.max(count).alias(count))


def last_values(stream: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    return stream.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def until(result: DataFrame, reached: Callable[[DataFrame], bool], checkpoint: str, name: str) -> StreamingQuery:
    """Run an update-mode aggregate; once a batch satisfies the threshold, later batches are left alone."""
    done = {"at": None}

    def each(batch: DataFrame, number: int) -> None:
        if done["at"] is None and reached(batch):
            done["at"] = number

    query = result.writeStream.outputMode("complete").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).queryName(name).start()
    query.reached = done
    return query


def presence(stream: DataFrame, ttl_ms: int) -> DataFrame:
    """replica, clock, live: the newest announcement of each replica, and its departure when ttl_ms pass in silence.

    stream: replica STRING, clock LONG, value STRING (null: departure), ts TIMESTAMP with a watermark.
    """

    def step(key, batches: Iterator[pd.DataFrame], state):
        if state.hasTimedOut:
            clock, _ = state.get
            state.remove()
            yield pd.DataFrame({"replica": [key[0]], "clock": [clock], "live": [False]})
            return
        clock, live = state.get if state.exists else (-1, False)
        last = None
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                here = (int(r.clock), r.value is not None and not pd.isna(r.value))
                if here > (clock, live):
                    clock, live = here
                last = r.ts if last is None or r.ts > last else last
        state.update((clock, live))
        if last is not None and live:
            at = max(int(last.timestamp() * 1000) + ttl_ms, state.getCurrentWatermarkMs() + 1)
            state.setTimeoutTimestamp(at)
        yield pd.DataFrame({"replica": [key[0]], "clock": [clock], "live": [bool(live)]})

    return stream.groupBy("replica").applyInPandasWithState(step, "replica string, clock long, live boolean", "clock long, live boolean", "update", "EventTimeTimeout")


def in_order(stream: DataFrame) -> DataFrame:
    """sender, seq, payload released in each sender's sequence; gaps wait in state, repeats go.

    stream: sender STRING, seq LONG (from 1), payload STRING.
    """

    def step(key, batches: Iterator[pd.DataFrame], state):
        expected, seqs, payloads = state.get if state.exists else (1, [], [])
        waiting = dict(zip(seqs, payloads))
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if r.seq >= expected:
                    waiting.setdefault(int(r.seq), r.payload)
        out = []
        while expected in waiting:
            out.append((key[0], expected, waiting.pop(expected)))
            expected += 1
        state.update((expected, list(waiting), list(waiting.values())))
        yield pd.DataFrame(out, columns=["sender", "seq", "payload"])

    return stream.groupBy("sender").applyInPandasWithState(step, "sender string, seq long, payload string", "expected long, seqs array<long>, payloads array<string>", "append", "NoTimeout")


def changes(stream: DataFrame, key: str, value: str) -> DataFrame:
    """key, value: each key's value when it first comes and whenever it differs from the one before.

    stream: key STRING, value STRING, and ts, in whose order the rows of one batch are taken.
    """

    def step(which, batches: Iterator[pd.DataFrame], state):
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        seen, last = state.get if state.exists else (False, None)
        out = []
        for v in rows[value]:
            v = None if pd.isna(v) else v
            if not seen or v != last:
                seen, last = True, v
                out.append((which[0], v))
        state.update((seen, last))
        yield pd.DataFrame(out, columns=[key, value])

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} string, {value} string", "seen boolean, last string", "append", "NoTimeout")


def pairing(stream: DataFrame, minimum: int, deadline_ms: int) -> DataFrame:
    """session, event, observed: one verdict a session, Paired when a roster reaches the minimum before the deadline, else NeverPaired once it has passed.

    stream: session STRING, members LONG, ts TIMESTAMP with a watermark. A session is armed by its first row.
    """

    def step(key, batches: Iterator[pd.DataFrame], state):
        if state.hasTimedOut:
            ends, observed, _ = state.get
            state.update((ends, observed, True))
            yield pd.DataFrame({"session": [key[0]], "event": ["NeverPaired"], "observed": [observed]})
            return
        ends, observed, decided = state.get if state.exists else (0, 0, False)
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        verdict = None
        for r in rows.itertuples(index=False):
            at = int(r.ts.timestamp() * 1000)
            ends = ends or at + deadline_ms
            if decided:
                break
            if at >= ends:
                verdict, decided = ("NeverPaired", observed), True
            elif r.members >= minimum:
                verdict, decided = ("Paired", None), True
            else:
                observed = int(r.members)
        state.update((ends, observed, decided))
        if not decided:
            state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        found = [] if verdict is None else [(key[0], *verdict)]
        yield pd.DataFrame(found, columns=["session", "event", "observed"]).astype({"observed": "Int64"})

    return stream.groupBy("session").applyInPandasWithState(step, "session string, event string, observed long", "ends long, observed long, decided boolean", "append", "EventTimeTimeout")
