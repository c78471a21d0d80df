"""Optimistic actions over a committed log: what is confirmed, what is pending, and both states.

A session's events are a fold in their order, sequential by definition. Sessions are dealt over tasks and streamed in
order, so a task holds one session's states and its pending actions, never its whole log.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

from tidefold.sources.staging import together


class Session:
    """One session's fold. apply(state, action) gives the next state and changes none.

    The shown state is worked out when read: a commit that is not ours makes every pending action apply anew, and doing
    so at each such commit costs the square of a session's length.
    """

    def __init__(self, start, apply: Callable):
        self.sure = self._shown = start
        self.stale = False
        self.apply, self.pending, self.confirmed, self.marks = apply, deque(), 0, {}

    @property
    def shown(self):
        if self.stale:
            self._shown, self.stale = self.sure, False
            for action in self.pending:
                self._shown = self.apply(self._shown, action)
        return self._shown

    def take(self, kind: str, action, client=None, request=None) -> None:
        if kind == "propose":
            self.pending.append(action)
            if not self.stale:
                self._shown = self.apply(self._shown, action)
        elif kind == "fail":  # the newest proposal did not get through
            if self.pending:
                self.pending.pop()
            self.stale = True
        elif kind == "reset":  # action is a state to start from again; what was pending is void
            self.pending.clear()
            self.sure = self._shown = action
            self.stale = False
            self.confirmed += 1
        elif kind == "commit":
            self.confirmed += 1
            fresh = client is None or request > self.marks.get(client, -1)
            if fresh and client is not None:
                self.marks[client] = request
            ours = bool(self.pending) and self.pending[0] == action
            if ours:
                self.pending.popleft()
            if fresh:
                self.sure = self.apply(self.sure, action)
            if not ours and fresh or ours and not fresh:
                self.stale = True
        else:
            raise ValueError(f"unknown event {kind!r}")


def speculate(events: DataFrame, start, apply: Callable, state: str = "long") -> DataFrame:
    """session, authoritative, speculative, pending, confirmed from events (session, idx, kind, client, request, action).

    kind: propose, commit, fail or reset. A commit whose request is not above its client's largest one is a duplicate; a
    null client is never one. Sessions start from `start`; no events, no rows.
    """
    def told(key, s: Session):
        return key, s.sure, s.shown, len(s.pending), s.confirmed

    names = ["session", "authoritative", "speculative", "pending", "confirmed"]

    def run(batches):
        key, now, out = None, None, []
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if now is None or r.session != key:
                    if now is not None:
                        out.append(told(key, now))
                    key, now = r.session, Session(start, apply)
                known = not pd.isna(r.client)
                now.take(r.kind, r.action, r.client if known else None, r.request if known else None)
            yield pd.DataFrame(out, columns=names)
            out = []
        if now is not None:
            yield pd.DataFrame([told(key, now)], columns=names)

    kind = events.schema["session"].dataType.simpleString()
    dealt = together(events.select("session", "idx", "kind", "client", "request", "action").filter("session is not null"), "session", "idx")
    return dealt.mapInPandas(run, f"session {kind}, authoritative {state}, speculative {state}, pending long, confirmed long")
