"""Byte-level BPE encoding and decoding with DuckDB recursive queries in each partition.

A text is cut by the vocabulary's pattern, and each distinct piece is encoded once. A piece that is a token is
that token. The others become token-position rows (one byte each at first) that join the merge table - pairs
of ids whose bytes together are a token - and each word's leftmost pair of the least rank is contracted, one
contraction a word and round, until no word has a pair. Words run in chunks of bounded size, so a chunk's rows
bound the memory; finished encodings stay in a bounded memo of the worker, which saves work and changes no
result. Decoding joins ids with the vocabulary and aggregates their bytes in order of position.

Very long words (unbroken runs of letters, digits or signs) would take a round for each of their bytes. So a word of more
than LONG bytes is first cut between bytes that stand together in no token, which no merge can cross; and a round
contracts the leftmost pair of the least rank of every neighbourhood, not of the whole word. A token grows out of the place of
its first merge and is at most m bytes long, m being the longest token that the word's bytes allow. So what happens 2 m bytes
away can neither touch the tokens a contraction makes use of nor want the same neighbours, and a pair with no lower one
within 2 m bytes is contracted as it would be in its turn. Of a run of equal pairs every other one is contracted, from
the left, if the new token takes part in no pair of a lower rank (they would follow one another); else the first alone.

Null and empty texts have no tokens. Only doc_id and text are read, so other columns, whatever their names, do not matter;
rows are independent, so repeated rows get equal results. An empty table gives no rows. A text is held whole in one task,
with its ids, about 20 bytes a character; a word's rows are held in DuckDB, which never spills to disk and fails
beyond MEMORY (words of some millions of bytes that cannot be cut).
"""

from __future__ import annotations

import base64
import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of pieces in one recursive query, encodings a worker remembers, and tokens in one decoding query.
CHUNK_BYTES, MEMO, DECODE_TOKENS = 500_000, 500_000, 1_000_000
#: Bytes from which on a word is long, and DuckDB's limit.
LONG, MEMORY = 64, "400MB"

#: A row's key is word << 32 | position, so that one ordering serves all words; a merge's is left << 20 | right.
_ENCODE = """
WITH RECURSIVE seq(k, tok, live) AS (
    SELECT k, tok, TRUE FROM start
    UNION ALL
    (WITH pair AS (
        SELECT k, tok, lead(tok) OVER o AS nxt, lead(k) OVER o AS nk, lag(k) OVER o AS pk
        FROM seq WHERE live WINDOW o AS (ORDER BY k)),
     ranked AS (
        SELECT k, k >> 32 AS w, tok, pk, m.rank
        FROM pair LEFT JOIN merges m ON m.ab = CASE WHEN nk >> 32 = k >> 32 THEN (tok::BIGINT << 20) | nxt END),
     best AS (
        SELECT w, min((rank::BIGINT << 32) | (k & 4294967295)) AS best FROM ranked WHERE rank IS NOT NULL GROUP BY w)
     SELECT r.k, CASE WHEN r.k & 4294967295 = b.best & 4294967295 THEN (b.best >> 32)::INT ELSE r.tok END, b.w IS NOT NULL
     FROM ranked r LEFT JOIN best b ON b.w = r.w
     WHERE b.w IS NULL OR r.pk IS NULL OR r.pk <> ((r.w << 32) | (b.best & 4294967295)))
)
SELECT k >> 32 AS w, tok FROM seq WHERE NOT live ORDER BY k
"""

#: The same for long words, with {reach} for 2 m bytes. A run is a row of overlapping pairs of one rank.
_ENCODE_LONG = """
WITH RECURSIVE seq(k, tok, live) AS (
    SELECT k, tok, TRUE FROM start
    UNION ALL
    (WITH pair AS (
        SELECT k, k >> 32 AS w, tok, lead(tok) OVER o AS nxt, lead(k) OVER o AS nk
        FROM seq WHERE live WINDOW o AS (ORDER BY k)),
     ranked AS (
        SELECT k, w, tok, m.rank, m.bulk, (m.rank::BIGINT << 32) | (k & 4294967295) AS key
        FROM pair LEFT JOIN merges m ON m.ab = CASE WHEN nk >> 32 = w THEN (tok::BIGINT << 20) | nxt END),
     open AS (SELECT DISTINCT w FROM ranked WHERE rank IS NOT NULL),
     near AS (
        SELECT k, w, tok, rank, row_number() OVER o AS rn, rank IS DISTINCT FROM lag(rank) OVER o AS fresh,
            CASE WHEN bulk THEN rank ELSE key END = CASE WHEN bulk THEN least >> 32 ELSE least END AS first
        FROM (SELECT *, min(key) OVER (ORDER BY k RANGE BETWEEN {reach} PRECEDING AND {reach} FOLLOWING) AS least FROM ranked)
        WINDOW o AS (ORDER BY k)),
     run AS (
        SELECT *, max(CASE WHEN fresh THEN rn END) OVER o AS began, max(CASE WHEN first THEN 0 ELSE rn END) OVER o AS held
        FROM near WINDOW o AS (ORDER BY k ROWS UNBOUNDED PRECEDING)),
     chosen AS (SELECT *, rank IS NOT NULL AND held < began AND (rn - began) % 2 = 0 AS joins FROM run),
     done AS (SELECT *, lag(joins, 1, FALSE) OVER (ORDER BY k) AS gone FROM chosen)
     SELECT k, CASE WHEN joins THEN rank ELSE tok END, open.w IS NOT NULL FROM done LEFT JOIN open ON open.w = done.w WHERE NOT gone)
)
SELECT k >> 32 AS w, tok FROM seq WHERE NOT live ORDER BY k
"""

_DECODE = "SELECT t.d, string_agg(v.chars, '' ORDER BY t.pos) AS chars FROM ids t JOIN vocab v ON v.id = t.id GROUP BY t.d"


def read_ranks(path: str) -> bytes:
    """The rank file as it is; it is small and fixed, so it can travel with the tasks."""
    with open(path, "rb") as f:
        return f.read()


def ranks_of(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


class Codec:
    """Encoder and decoder over one in-memory DuckDB connection of a worker."""

    def __init__(self, data: bytes, pattern: str):
        import duckdb
        import regex

        self.ranks = ranks_of(data)
        self.find = regex.compile(pattern).findall
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        ab, r = array("q"), array("i")
        get = self.ranks.get
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = get(token[:cut]), get(token[cut:])
                if left is not None and right is not None:
                    ab.append(left << 20 | right), r.append(rank)
        pairs, rank = np.array(ab, np.int64), np.array(r, np.int32)
        # the least rank of a pair that a token takes part in; a token may be made everywhere at once if that is above its own
        least = np.full(1 << 20, np.iinfo(np.int32).max, dtype=np.int32)
        np.minimum.at(least, pairs >> 20, rank)
        np.minimum.at(least, pairs & 0xFFFFF, rank)
        self._table("merges", ab=pairs, rank=rank, bulk=least[rank] > rank)
        # each token's neighbouring bytes, one token after the other, the longest first
        self.longest = sorted((t for t in self.ranks if len(t) > 1), key=len, reverse=True)
        b = [np.frombuffer(t, np.uint8).astype(np.int32) for t in self.longest]
        self.bigrams = np.concatenate([np.empty(0, np.int32), *(x[:-1] << 8 | x[1:] for x in b)])
        self.begin = np.cumsum([0, *(len(t) - 1 for t in self.longest)])[:-1]
        self.together = np.zeros(1 << 16, dtype=bool)
        self.together[self.bigrams] = True
        # one character for each byte, so that DuckDB's text functions keep all bytes apart
        self._table("vocab", id=np.fromiter(self.ranks.values(), np.int32), chars=[t.decode("latin-1") for t in self.ranks])
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.memo: dict[str, bytes] = {}

    def _table(self, name: str, **cols) -> None:
        self.db.register("incoming", pa.table(cols))
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def contract(self, words: list[bytes], query: str = _ENCODE) -> list[bytes]:
        """The ids of each word by the recursive query, as little-endian 32-bit integers."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(lengths)
        pos = np.arange(int(ends[-1])) - np.repeat(ends - lengths, lengths)
        k = (np.repeat(np.arange(len(words), dtype=np.int64), lengths) << 32) | pos
        self._table("start", k=k, tok=self.byte[np.frombuffer(b"".join(words), dtype=np.uint8)])
        out = self.db.execute(query).fetchnumpy()
        at = np.searchsorted(np.asarray(out["w"]), np.arange(len(words) + 1)) * 4
        ids = np.asarray(out["tok"]).astype("<u4").tobytes()
        return [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]

    def contract_long(self, word: bytes) -> bytes:
        """The ids of one long word."""
        b = np.frombuffer(word, dtype=np.uint8).astype(np.int32)
        pairs = b[:-1] << 8 | b[1:]
        cuts = [0, *(np.flatnonzero(~self.together[pairs]) + 1).tolist(), len(b)]
        held = np.zeros(1 << 16, dtype=bool)
        held[pairs] = True
        able = np.logical_and.reduceat(held[self.bigrams], self.begin) if len(self.begin) else np.zeros(0, dtype=bool)
        query = _ENCODE_LONG.format(reach=2 * len(self.longest[int(able.argmax())]) if able.any() else 2)
        parts = [word[a:z] for a, z in zip(cuts[:-1], cuts[1:])]
        known = dict.fromkeys(parts)
        todo = list(known)
        start = size = 0
        for i, part in enumerate(todo):
            size += len(part)
            if size >= CHUNK_BYTES or i == len(todo) - 1:
                known.update(zip(todo[start : i + 1], self.contract(todo[start : i + 1], query)))
                start, size = i + 1, 0
        return b"".join([known[p] for p in parts])

    def learn(self, pieces) -> None:
        """Put the encodings of pieces into the memo."""
        get, rest, size = self.ranks.get, [], 0
        for piece in pieces:
            raw = piece.encode("utf-8", "surrogatepass")
            whole = get(raw)
            if whole is not None:
                self.memo[piece] = whole.to_bytes(4, "little")
                continue
            if len(raw) > LONG:
                self.memo[piece] = self.contract_long(raw)
                continue
            rest.append((piece, raw))
            size += len(raw)
            if size >= CHUNK_BYTES:
                self._flush(rest)
                rest, size = [], 0
        self._flush(rest)

    def _flush(self, rest) -> None:
        if rest:
            for (piece, _), ids in zip(rest, self.contract([raw for _, raw in rest])):
                self.memo[piece] = ids

    def encode_all(self, texts: list[str], memo: int = MEMO) -> list[np.ndarray]:
        """The ids of each text; beyond memo remembered encodings, those of other texts are forgotten first."""
        cut = [self.find(t) for t in texts]
        wanted = set().union(*cut)
        if len(self.memo) > memo:
            self.memo = {p: self.memo[p] for p in wanted if p in self.memo}
        self.learn(wanted.difference(self.memo))
        of = self.memo.__getitem__
        return [np.frombuffer(b"".join(map(of, pieces)), dtype="<u4") for pieces in cut]

    def decode_all(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each id sequence; a long sequence goes in slices."""
        out: list[list[bytes]] = [[] for _ in ids]
        todo: list[tuple[int, np.ndarray]] = []
        size = 0
        for d, seq in enumerate(ids):
            for at in range(0, len(seq), DECODE_TOKENS):
                piece = seq[at : at + DECODE_TOKENS]
                if size + len(piece) > DECODE_TOKENS and todo:
                    self._decode(todo, out)
                    todo, size = [], 0
                todo.append((d, piece))
                size += len(piece)
        self._decode(todo, out)
        return [b"".join(x) for x in out]

    def _decode(self, todo, out) -> None:
        if not todo:
            return
        lengths = [len(s) for _, s in todo]
        d = np.repeat(np.arange(len(todo), dtype=np.int32), lengths)
        pos = np.concatenate([np.arange(n, dtype=np.int32) for n in lengths])
        table = pa.table({"d": d, "pos": pos, "id": np.concatenate([s for _, s in todo]).astype(np.int32)})
        self.db.register("ids", table)
        got = self.db.execute(_DECODE).fetchnumpy()
        self.db.unregister("ids")
        by = dict(zip(np.asarray(got["d"]).tolist(), got["chars"]))
        for i, (doc, _) in enumerate(todo):
            out[doc].append(by[i].encode("latin-1"))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(data: bytes, pattern: str) -> Codec:
    """The worker's codec, kept from task to task."""
    key = hashlib.sha1(data).hexdigest(), pattern
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(data, pattern)
    return _CODECS[key]


_SLICE_CHARS = 2_000_000


def _slices(texts: list[str]):
    """(from, to) of runs of texts with a bounded number of characters."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > _SLICE_CHARS:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def tokens(docs: DataFrame, ranks: bytes, pattern: str, with_ids: bool = False, memo: int = MEMO) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with with_ids also ids: each text encoded, and its ids decoded.

    memo bounds the encodings that a worker remembers; it trades memory for work and changes no result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(ranks)
    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.list_(pa.int32()))] * with_ids
    schema = pa.schema(fields)

    def run(batches):
        bpe = codec(held.value, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in _slices(texts):
                ids = bpe.encode_all(texts[a:b], memo)
                rows = [
                    {"n_tokens": len(x), "ids_sha256": hashlib.sha256(x.tobytes()).hexdigest(), "decoded_sha256": hashlib.sha256(raw).hexdigest()}
                    | ({"ids": x.astype(np.int32)} if with_ids else {})
                    for x, raw in zip(ids, bpe.decode_all(ids))
                ]
                made = pa.RecordBatch.from_pylist(rows, schema=schema)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *made.columns], ["doc_id", *schema.names])

    ddl = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.selectExpr("doc_id", "cast(text as string) as text").mapInArrow(run, ddl)
