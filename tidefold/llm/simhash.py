"""SimHash near-dedup: tiled exact comparison of 64-bit fingerprints.

Fingerprints of 4-word shingles are compared exactly, never by banding. Distinct fingerprints are dealt by
(population count, salt); two classes meet only if their population counts differ by at most the radius.
Within a meeting, numpy sorts both sides into tiles by the population counts of their bytes and skips tile
pairs whose bounding boxes are further apart than the radius (the sum of the bytes' count differences is a
lower bound of the distance); the rest goes through exclusive-or and bit counts. A meeting reports a spanning
forest of its links, not the links, so a group of k near copies costs O(k) rows for each meeting.

Components come from min-label propagation with pointer jumping over tables in the shared folder; no links
reach the driver. Every join there deals both sides anew, so adaptive execution can split a hot label.

Null texts count as empty; fewer words than a shingle give the whole sequence, no words fingerprint zero, which
is linked like any other. Rows with a null doc_id get a fingerprint, a null component_id and link nothing.
Repeated rows are copies of each other. Only doc_id and text are read. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import staged, unused

SHINGLE, RADIUS, SEED = 4, 4, 42
TILE = 256
#: Distinct fingerprints of one (population count, salt) class, at most about so many on average.
CLASS_ROWS = 500_000
_CHUNK = 1 << 14


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit i is set if it is set in over half of the shingles' XXH64. Only A-Z are lower-cased, only ASCII space parts words."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    flat = b" ".join(w)
    ends = np.cumsum(np.fromiter((len(x) + 1 for x in w), dtype=np.int64, count=len(w)))
    starts = ends - np.fromiter((len(x) + 1 for x in w), dtype=np.int64, count=len(w))
    k = min(shingle, len(w))
    first, last = starts[: len(w) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist()
    digest, view = xxhash.xxh64_intdigest, flat
    ones, n = np.zeros(64, dtype=np.int64), len(first)
    for at in range(0, n, _CHUNK):
        h = np.array([digest(view[a:b], SEED) for a, b in zip(first[at : at + _CHUNK], last[at : at + _CHUNK])], dtype=np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprinted(batches):
    for batch in batches:
        fps = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_fingerprinted, f"doc_id {kind}, fp long")


def _tiles(fps: np.ndarray):
    """fps ordered so that neighbours have like byte population counts; the tiles' starts, and their boxes' corners."""
    counts = np.bitwise_count(fps.view(np.uint8).reshape(-1, 8)).astype(np.int16)
    order = np.arange(len(fps))
    stack, leaves = [(order, 0)], []
    while stack:  # split at the median of the widest byte count until a tile is small
        idx, depth = stack.pop()
        if len(idx) <= TILE or depth > 40:
            leaves.append(idx)
            continue
        c = counts[idx]
        byte = int(np.argmax(c.max(axis=0) - c.min(axis=0)))
        by = idx[np.argsort(c[:, byte], kind="stable")]
        stack += [(by[: len(by) // 2], depth + 1), (by[len(by) // 2 :], depth + 1)]
    order = np.concatenate(leaves)
    starts = np.cumsum([0] + [len(x) for x in leaves])
    boxes = np.array([counts[x].min(axis=0) for x in leaves]), np.array([counts[x].max(axis=0) for x in leaves])
    return order, starts, boxes


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def forest(a: np.ndarray, b: np.ndarray | None, radius: int = RADIUS) -> list[tuple[int, int]]:
    """(member, root) stars over the fingerprints of a, or of a and b, that links join. b None: links within a."""
    n = len(a)
    every = a if b is None else np.concatenate([a, b])
    parent = np.arange(len(every))
    oa, sa, (la, ha) = _tiles(a)
    ob, sb, (lb, hb) = (oa, sa, (la, ha)) if b is None else _tiles(b)
    shift = 0 if b is None else n
    sorted_a, sorted_b = a[oa], (a if b is None else b)[ob]
    touched = False
    for i in range(len(sa) - 1):
        gap = np.maximum(lb - ha[i], 0) + np.maximum(la[i] - hb, 0)
        near = np.flatnonzero(gap.sum(axis=1) <= radius)
        if b is None:
            near = near[near >= i]
        if not len(near):
            continue
        left = sorted_a[sa[i] : sa[i + 1], None]
        cols = np.concatenate([np.arange(sb[j], sb[j + 1]) for j in near])
        for at in range(0, len(cols), 4096):
            part = cols[at : at + 4096]
            hit = np.bitwise_count(left ^ sorted_b[None, part]) <= radius
            r, c = np.nonzero(hit)
            if not len(r):
                continue
            x, y = oa[sa[i] + r], ob[part[c]] + shift
            while True:
                parent = _roots(parent)
                px, py = parent[x], parent[y]
                apart = px != py
                if not apart.any():
                    break
                touched = True
                x, y, px, py = x[apart], y[apart], px[apart], py[apart]
                np.minimum.at(parent, np.maximum(px, py), np.minimum(px, py))
    if not touched:
        return []
    parent = _roots(parent)
    member = np.flatnonzero(parent != np.arange(len(every)))
    signed = every.view(np.int64)
    return list(zip(signed[member].tolist(), signed[parent[member]].tolist()))


def _meeting(group: pd.DataFrame) -> pd.DataFrame:
    fps, side = group["fp"].to_numpy().astype(np.int64).view(np.uint64), group["side"].to_numpy()
    same = bool((side == 2).any())
    pairs = forest(fps, None) if same else forest(fps[side == 0], fps[side == 1]) if (side == 0).any() and (side == 1).any() else []
    return pd.DataFrame(pairs, columns=["u", "v"], dtype="int64")


def links(distinct: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """u, v: a spanning set of the links between distinct fingerprints (column fp); n: how many there are."""
    salts = max(4, -(-n // (8 * CLASS_ROWS)))
    # a class is (count, salt), numbered count * salts + salt; class p meets q >= p if their counts are near
    own = F.bit_count("fp") * salts + F.pmod(F.xxhash64("fp"), F.lit(salts))
    rows = distinct.select("fp", own.cast("int").alias("c"))
    low = F.greatest((F.floor(F.col("c") / salts) - radius) * salts, F.lit(0))
    high = F.least((F.floor(F.col("c") / salts) + radius + 1) * salts - 1, F.lit(65 * salts - 1))
    met = rows.select("fp", "c", F.explode(F.sequence(low.cast("int"), high.cast("int"))).alias("o"))
    met = met.select(
        "fp", F.least("c", "o").alias("p"), F.greatest("c", "o").alias("q"),
        F.when(F.col("c") == F.col("o"), 2).when(F.col("c") < F.col("o"), 0).otherwise(1).cast("byte").alias("side"),
    )
    return met.groupBy("p", "q").applyInPandas(_meeting, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node (as a signed long) that each node of the edges u, v can reach."""
    both = staged(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "simhash-edges")
    labels = staged(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")), "simhash-labels")
    while True:
        # each node takes the smallest label among its neighbours'
        seen = both.join(labels, both["v"] == labels["node"]).select("u", "label")
        own = labels.select(F.col("node").alias("u"), "label")
        step = staged(seen.unionByName(own).groupBy(F.col("u").alias("node")).agg(F.min("label").alias("label")), "simhash-labels")
        # and then its label's label
        up = step.select(F.col("node").alias("at"), F.col("label").alias("further"))
        new = staged(step.join(up, step["label"] == up["at"], "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label")), "simhash-labels")
        before = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        after = new.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        labels = new
        if before == after:  # labels only fall, so an equal sum is a fixpoint
            return labels


def simhash(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id in reach)."""
    fps = staged(fingerprints(docs), "simhash-fingerprints")
    classes = staged(fps.filter(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    edges = staged(links(classes.select("fp"), classes.count(), radius), "simhash-links")
    labels = components(edges)
    named = classes.join(labels, classes["fp"] == labels["node"], "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    named = staged(named, "simhash-named")
    least = staged(named.groupBy("label").agg(F.min("first").alias("component_id")), "simhash-components")
    of = named.join(least, "label").select(F.col("fp").alias("fp2"), "component_id")
    of = staged(of, "simhash-of")
    out = fps.join(of, fps["fp"] == of["fp2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id"))


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs less all but one document of each component: the one with the smallest doc_id stays, once. Null doc_ids stay."""
    fps = simhash(docs, radius).filter(F.col("doc_id").isNotNull()).select("doc_id", "component_id")
    keep = staged(fps.filter(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").count(), "simhash-kept")
    # merge joins at every size: the survivors' ids grow with the corpus and are never broadcast
    once = docs.join(keep.filter("count = 1").select("doc_id").hint("merge"), "doc_id", "left_semi")
    more = docs.join(keep.filter("count > 1").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return once.unionByName(more).unionByName(docs.filter(F.col("doc_id").isNull())).select(*docs.columns)


def shingled(text: str | None, shingle: int = 5) -> tuple[np.ndarray, int, int, int]:
    """The sorted distinct 64-bit hashes of the shingles, a hash of that set, and a 128-bit fingerprint of it as two longs."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, dtype=np.uint64), 0, 0, 0
    flat = b" ".join(w)
    lengths = np.fromiter((len(x) + 1 for x in w), dtype=np.int64, count=len(w))
    ends = np.cumsum(lengths)
    k = min(shingle, len(w))
    first, last = (ends - lengths)[: len(w) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist()
    digest = xxhash.xxh3_128_digest
    h = np.frombuffer(b"".join([digest(flat[a:b], SEED) for a, b in zip(first, last)]), dtype="<u8").reshape(-1, 2)
    ids, at = np.unique(h[:, 0], return_index=True)
    ones = np.zeros(128, dtype=np.int64)
    for i in range(0, len(at), _CHUNK):
        ones += np.unpackbits(h[at[i : i + _CHUNK]].view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    a, b = np.packbits(ones * 2 > len(at)).view("<i8").tolist()
    return ids, xxhash.xxh3_64_intdigest(ids.tobytes()) - (1 << 63), a, b


def _shingle_rows(shingle: int, whole: bool):
    def rows(batches):
        for batch in batches:
            made = [shingled(t, shingle) for t in batch.column("text").to_pylist()]
            longs = lambda i: pa.array([x[i] for x in made], pa.int64())
            cols = [longs(1), pa.array([len(x[0]) for x in made], pa.int64()), longs(2), longs(3)]
            if whole:
                yield pa.RecordBatch.from_arrays([*cols, pa.array([x[0].tobytes() for x in made], pa.binary())], ["key", "n", "a", "b", "ids"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), *cols], ["doc_id", "h", "key", "n", "a", "b"])

    return rows


def _by_size(rows: DataFrame, similarity: float, salts: int) -> DataFrame:
    """rows dealt to meetings p, q of (size class, salt) classes: sets as similar as asked are at most one size class apart."""
    own = (F.floor(F.log("n") / -np.log(similarity)) * salts + F.pmod(F.xxhash64("key"), F.lit(salts))).cast("int")
    rows = rows.withColumn("c", own)
    size = F.floor(F.col("c") / salts)
    low, high = F.greatest((size - 1) * salts, F.lit(0)).cast("int"), ((size + 2) * salts - 1).cast("int")
    met = rows.withColumn("o", F.explode(F.sequence(low, high)))
    side = F.when(F.col("c") == F.col("o"), 2).when(F.col("c") < F.col("o"), 0).otherwise(1).cast("byte")
    return met.withColumns({"p": F.least("c", "o"), "q": F.greatest("c", "o"), "side": side}).drop("c", "o")


def _close(group: pd.DataFrame, similarity: float, radius: int):
    """group sorted by size; for each tile of rows: its start, and where a later row of the other side is near enough in size and bits."""
    n, side = group["n"].to_numpy(), group["side"].to_numpy()
    fp = group[["a", "b"]].to_numpy().astype(np.int64).view(np.uint64)
    a, b = np.ascontiguousarray(fp[:, 0]), np.ascontiguousarray(fp[:, 1])
    for at in range(0, len(n), TILE):
        end = min(at + TILE, len(n))
        stop = int(np.searchsorted(n, n[end - 1] / similarity + 1e-6, side="right"))
        for lo in range(at, stop, 4096):
            x, y = slice(at, end), slice(lo, min(lo + 4096, stop))
            hit = np.bitwise_count(a[x, None] ^ a[None, y]) + np.bitwise_count(b[x, None] ^ b[None, y]) <= radius
            r, c = np.nonzero(hit)
            r, c = r + at, c + lo
            ok = (c > r) & (n[r] >= similarity * n[c] - 1e-6) & ((side[r] != side[c]) | (side[r] == 2))
            yield r[ok], c[ok]


def similar_links(nodes: DataFrame, docs: DataFrame, similarity: float, shingle: int, radius: int) -> DataFrame:
    """u, v: a spanning set of the links between shingle sets (nodes: key, n, a, b, first and h, a document that has it)."""
    def candidates(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("n", kind="stable", ignore_index=True)
        near = np.zeros(len(group), dtype=bool)
        for r, c in _close(group, similarity, radius):
            near[r] = near[c] = True
        return group.loc[near, ["key"]]

    def confirmed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("key").sort_values("n", kind="stable", ignore_index=True)
        sets = [np.frombuffer(x, dtype=np.uint64) for x in group["ids"]]
        label, pairs, keys = np.arange(len(group)), [], group["key"].tolist()
        for r, c in _close(group, similarity, radius):
            while len(r):  # pairs that a confirmed link joins already need no look
                apart = label[r] != label[c]
                r, c = r[apart], c[apart]
                linked = False
                for i, (x, y) in enumerate(zip(r.tolist(), c.tolist())):
                    both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if both >= similarity * (len(sets[x]) + len(sets[y]) - both) - 1e-9:
                        pairs.append((keys[x], keys[y]))
                        label[label == label[y]] = label[x]
                        linked = True
                        break
                r, c = (r[i + 1 :], c[i + 1 :]) if linked else (r[:0], c[:0])
        return pd.DataFrame(pairs, columns=["u", "v"], dtype="int64")

    n = nodes.count()
    met = _by_size(nodes.filter("n > 0").select("key", "n", "a", "b"), similarity, max(8, -(-n // (8 * CLASS_ROWS))))
    near = staged(met.groupBy("p", "q").applyInPandas(candidates, "key long").distinct(), "simhash-candidates")
    held = nodes.join(near.select(F.col("key").alias("key2")).hint("merge"), F.col("key") == F.col("key2"), "left_semi").select(F.col("first").alias("first2"), F.col("h").alias("h2"))
    texts = docs.join(held.hint("merge"), F.col("doc_id").eqNullSafe(F.col("first2")) & (F.col("h") == F.col("h2")), "left_semi").select("text")
    sets = staged(texts.mapInArrow(_shingle_rows(shingle, True), "key long, n long, a long, b long, ids binary"), "simhash-sets")
    met = _by_size(sets, similarity, max(2, -(-sets.count() // CLASS_ROWS)))
    return met.groupBy("p", "q").applyInPandas(confirmed, "u long, v long")


def one_of_similar(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, radius: int = 36) -> DataFrame:
    """docs less all but one document of each component of texts whose shingle sets have a Jaccard similarity of at least `similarity`.

    Candidates are sets of near size whose 128-bit fingerprints differ in at most radius bits (at 0.8 they differ in
    about 19, unrelated ones in 64); each link is confirmed on the sets themselves. The row with the smallest doc_id
    stays (nulls last, then by the text's hash), once. Texts without words are copies of each other.
    """
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = staged(texts.mapInArrow(_shingle_rows(shingle, False), f"doc_id {kind}, h long, key long, n long, a long, b long"), "simhash-shingled")
    once = rows.groupBy("key", "doc_id", "h").agg(F.count(F.lit(1)).alias("times"), F.first("n").alias("n"), F.first("a").alias("a"), F.first("b").alias("b"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("h"), F.col("times"))).alias("best")
    nodes = staged(once.groupBy("key").agg(best, F.first("n").alias("n"), F.first("a").alias("a"), F.first("b").alias("b")), "simhash-nodes")
    named = nodes.select("key", "n", "a", "b", F.col("best.doc_id").alias("first"), F.col("best.h").alias("h"))
    labels = components(staged(similar_links(named, texts, similarity, shingle, radius), "simhash-links"))
    of = nodes.join(labels, nodes["key"] == labels["node"], "left").groupBy(F.coalesce("label", "key").alias("group")).agg(F.min("best").alias("best"))
    key, h = unused(docs, "__id", "__h")
    keep = staged(of.select(F.col("best.doc_id").alias(key), F.col("best.h").alias(h), F.col("best.times").alias("times")), "simhash-kept")
    same = docs["doc_id"].eqNullSafe(F.col(key)) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == F.col(h))
    # merge joins at every size: the survivors' ids grow with the corpus and are never broadcast
    single = docs.join(keep.filter("times = 1").hint("merge"), same, "left_semi")
    more = docs.join(keep.filter("times > 1").hint("merge"), same, "left_semi")
    return single.unionByName(more.withColumn(h, F.coalesce("text", F.lit(""))).dropDuplicates(["doc_id", h]).drop(h)).select(*docs.columns)
