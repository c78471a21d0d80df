"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features: densities of lexicons that are learned from the training labels (words and word prefixes, weighted by
log-odds), proximity of second-person words to lexicon hits, capitals, punctuation and obfuscation rates (look-alike
characters, letters set apart, masked letters), and lengths. The trees (histogram splits, logistic loss) and the
isotonic map are fitted here; lexicon features and calibration are cross-fitted, so neither sees its own rows' labels.

Training rows are a bounded sample, whose texts stay on the executors: per class the SAMPLE labelled rows with the least hash of doc_id, weighted back
to the classes' shares. Rows with a null label or text are left out; a doc_id with several labels counts as toxic if
one says so. With no rows of one class, every score is the share of toxic labels (0 without labels).

Null texts are scored as empty ones. Scores depend on the text only. Only doc_id and text (doc_id, toxic) are read.
Repeated rows get equal scores. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import staged

#: Training rows of each class at most; the trees are fitted on the driver, from one short vector a row.
SAMPLE = 3000
#: Prefix lengths, the least number of toxic documents with a lexicon entry, and the least log-odds.
PREFIXES, LEAST_DOCS, LEAST_ODDS = (3, 4, 5, 6, 7), 4, 1.0
FOLDS = 5

SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen ihr euch sie ihnen tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()
)
NEAR = 5

_WORD = re.compile(r"[^\W_]+(?:[@$!*'][^\W_]+)*")
_LOOKALIKE = str.maketrans("013457@$!", "oieastasi")
_MIXED = re.compile(r"[^\W\d_][\d@$!*]+[^\W\d_]")
_APART = re.compile(r"(?<!\S)(?:[^\W\d_][\s.\-_*]){3,}[^\W\d_](?!\S)")

FEATURES = (
    "word_density", "word_max", "word_strong", "prefix_density", "prefix_max", "prefix_strong", "distinct_strong", "you_near", "you_rate",
    "obfuscated_hits", "mixed_rate", "apart_rate", "capitals", "shouted", "exclaim", "punctuation", "digits", "mean_length", "log_words",
)


def plain(word: str) -> str:
    return word.translate(_LOOKALIKE).replace("*", "").replace("'", "")


def tokens_of(word: str):
    yield "w" + word
    for n in PREFIXES:
        if len(word) > n:
            yield f"p{word[:n]}"


def evidence(text: str) -> set[str]:
    out: set[str] = set()
    for w in {plain(x) for x in _WORD.findall(text.lower())}:
        out.update(tokens_of(w))
    return out


def lexicon(toxic: dict[str, np.ndarray], clean: dict[str, np.ndarray], n_toxic: np.ndarray, n_clean: np.ndarray, out: int | None) -> dict[str, float]:
    """Log-odds of the entries that toxic documents have more often. Counts of documents are by fold; fold `out` is left out."""
    part = (lambda v: v.sum()) if out is None else (lambda v: v.sum() - v[out])
    t, c, none = part(n_toxic) + 1, part(n_clean) + 1, np.zeros(FOLDS)
    odds = {x: math.log((part(n) + 0.5) / t) - math.log((part(clean.get(x, none)) + 0.5) / c) for x, n in toxic.items() if part(n) >= LEAST_DOCS}
    return {x: v for x, v in odds.items() if v >= LEAST_ODDS}


class Featurizer:
    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.memo = lexicon, {}

    def _weights(self, raw: str) -> tuple[float, float, bool]:
        got = self.memo.get(raw)
        if got is None:
            word, lex = plain(raw), self.lexicon
            w = lex.get("w" + word, 0.0)
            p = max((lex.get(f"p{word[:n]}", 0.0) for n in PREFIXES if len(word) > n), default=0.0)
            if len(self.memo) > 100_000:
                self.memo.clear()
            got = self.memo[raw] = (w, p, w > 0 and word != raw)
        return got

    def __call__(self, text: str) -> list[float]:
        words = _WORD.findall(text.lower())
        n, chars = max(len(words), 1), max(len(text), 1)
        counts = Counter(words)
        wsum = wmax = psum = pmax = 0.0
        strong, pstrong, distinct, obfuscated, mixed = 0, 0, 0, 0, 0
        hits: set[str] = set()
        for word, k in counts.items():
            w, p, hidden = self._weights(word)
            if w or p:
                wsum, psum, wmax, pmax = wsum + k * w, psum + k * p, max(wmax, w), max(pmax, p)
                if w >= 3:
                    strong, distinct = strong + k, distinct + 1
                    hits.add(word)
                pstrong += k * (p >= 3)
                obfuscated += k * hidden
            if not word.isalpha() and _MIXED.search(word):
                mixed += k
        near = 0
        if hits:
            at = [i for i, w in enumerate(words) if w in hits]
            near = sum(any(w in SECOND_PERSON for w in words[max(0, i - NEAR) : i + NEAR + 1]) for i in at)
        upper = sum(map(str.isupper, text))
        shouted = sum(1 for w in text.split() if len(w) > 2 and w.isupper())
        marks = len(text) - sum(len(w) * k for w, k in counts.items()) - text.count(" ") - text.count("\n")
        return [
            wsum / n, wmax, strong / n, psum / n, pmax, pstrong / n, math.log1p(distinct), near / max(len(hits), 1), sum(counts[w] for w in SECOND_PERSON if w in counts) / n,
            obfuscated / n, mixed / n, len(_APART.findall(text)) / n, upper / chars, shouted / n, text.count("!") / n, marks / chars,
            sum(map(str.isdigit, text)) / chars, sum(len(w) * k for w, k in counts.items()) / n, math.log1p(len(words)),
        ]


@dataclass
class Trees:
    """Boosted regression trees of fixed depth over binned features."""

    depth: int = 3
    rounds: int = 60
    rate: float = 0.15
    bins: int = 48
    ridge: float = 1.0
    least_weight: float = 5.0
    base: float = 0.0
    cuts: list = field(default_factory=list)
    trees: list = field(default_factory=list)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Trees:
        grid = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.cuts = [np.unique(np.quantile(x[:, j], grid)) for j in range(x.shape[1])]
        b, n_bins, cols = self._binned(x), self.bins, x.shape[1]
        share = np.clip((w * y).sum() / w.sum(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(share / (1 - share)))
        margin = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = w * (p - y), w * p * (1 - p)
            node, feature, cut = np.zeros(len(y), dtype=np.int64), [], []
            for level in range(self.depth):
                k = 1 << level
                at = (node[:, None] * cols + np.arange(cols)) * n_bins + b
                hist = [np.bincount(at.ravel(), weights=np.repeat(v, cols), minlength=k * cols * n_bins).reshape(k, cols, n_bins).cumsum(axis=2) for v in (g, h, w)]
                total = [v[:, :, -1:] for v in hist]
                score = lambda a, c: a * a / (c + self.ridge)
                gain = score(hist[0], hist[1]) + score(total[0] - hist[0], total[1] - hist[1]) - score(total[0], total[1])
                gain[(hist[2] < self.least_weight) | (total[2] - hist[2] < self.least_weight)] = 0
                flat = gain.reshape(k, -1)
                best = flat.argmax(axis=1)
                f, c = best // n_bins, best % n_bins
                c = np.where(flat[np.arange(k), best] > 1e-9, c, n_bins)  # no split: all go left
                feature.append(f), cut.append(c)
                node = node * 2 + (b[np.arange(len(y)), f[node]] > c[node])
            leaves = 1 << self.depth
            value = -self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.ridge)
            self.trees.append((feature, cut, value))
            margin += value[node]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, rows, out = self._binned(x), np.arange(len(x)), np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for f, c in zip(feature, cut):
                node = node * 2 + (b[rows, f[node]] > c[node])
            out += value[node]
        return out


def isotonic(m: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the blocks' mean margins and rates, both non-decreasing."""
    order = np.argsort(m, kind="stable")
    blocks: list[list[float]] = []
    for mi, yi, wi in zip(m[order], y[order], w[order]):
        blocks.append([mi * wi, yi * wi, wi])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Trees | None
    at: np.ndarray
    rate: np.ndarray
    constant: float = 0.0

    def scores(self, texts: list[str], featurize: Featurizer) -> np.ndarray:
        if self.trees is None or not texts:
            return np.full(len(texts), self.constant)
        m = self.trees.margin(np.array([featurize(t) for t in texts]))
        # within a block of the isotonic map the margin decides, by a millionth
        return np.clip(np.interp(m, self.at, self.rate) * (1 - 1e-6) + 1e-6 / (1 + np.exp(-m)), 0, 1)


def fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, fold: np.ndarray, entries: dict[str, float]) -> Model:
    """Trees over all rows, calibrated by margins that each fold gets from trees without it."""
    margin = np.zeros(len(y))
    for k in range(FOLDS):
        out = fold == k
        if out.any() and (~out).any() and y[~out].min() < y[~out].max():
            margin[out] = Trees().fit(x[~out], y[~out], w[~out]).margin(x[out])
    at, rate = isotonic(margin, y, w)
    return Model(entries, Trees().fit(x, y, w), at, rate)


def _fold():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on labelled rows whose crc32(doc_id) mod 5 is not 0."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (_fold() != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = known.filter("toxic = 1").orderBy(*order).limit(sample).unionByName(known.filter("toxic = 0").orderBy(*order).limit(sample))
    texts = docs.filter(F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = staged(rows.select("doc_id", "toxic", "text", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold")), "toxicity-sample")
    have: dict[int, np.ndarray] = {0: np.zeros(FOLDS), 1: np.zeros(FOLDS)}
    for r in rows.groupBy("toxic", "fold").count().collect():
        have[r["toxic"]][r["fold"]] = r["count"]
    n = have[0].sum() + have[1].sum()
    if not have[0].sum() or not have[1].sum():
        return Model({}, None, np.zeros(1), np.zeros(1), float(have[1].sum() / n) if n else 0.0)
    sc = docs.sparkSession.sparkContext
    toxic = _by_fold(rows.filter("toxic = 1"), None, LEAST_DOCS)
    clean = _by_fold(rows.filter("toxic = 0"), sc.broadcast(frozenset(toxic)), 1)
    parts = [lexicon(toxic, clean, have[1], have[0], k) for k in range(FOLDS)]
    held = sc.broadcast(parts)

    def featurized(batches):
        made = [Featurizer(lex) for lex in held.value]
        for batch in batches:
            x = [made[k](t) for k, t in zip(batch.column("fold").to_pylist(), batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("toxic"), batch.column("fold"), pa.array(x, pa.list_(pa.float64()))], ["key", "toxic", "fold", "x"])

    keyed = rows.select(F.md5(F.col("doc_id").cast("string")).alias("key"), F.col("toxic").cast("int").alias("toxic"), "fold", "text")
    matrix = sorted(keyed.mapInArrow(featurized, "key string, toxic int, fold int, x array<double>").collect(), key=lambda r: r["key"])
    weight = {k: share[k] / have[k].sum() * n / sum(share.values()) for k in have}
    y = np.array([r["toxic"] for r in matrix], dtype=float)
    return fit(np.array([r["x"] for r in matrix]), y, np.array([weight[int(v)] for v in y]), np.array([r["fold"] for r in matrix]), lexicon(toxic, clean, have[1], have[0], None))


def _by_fold(rows: DataFrame, wanted, least: int) -> dict[str, np.ndarray]:
    """Documents with each lexicon entry, by fold; only entries of at least `least` documents come to the driver."""

    def count(batches):
        only = None if wanted is None else wanted.value
        seen: Counter = Counter()

        def told():
            keys = list(seen)
            return pa.RecordBatch.from_arrays([pa.array([e for e, _ in keys], pa.string()), pa.array([f for _, f in keys], pa.int32()), pa.array([seen[k] for k in keys], pa.int64())], ["entry", "fold", "n"])

        for batch in batches:
            for fold, text in zip(batch.column("fold").to_pylist(), batch.column("text").to_pylist()):
                found = evidence(text)
                seen.update((e, fold) for e in (found if only is None else found & only))
                if len(seen) > 200_000:  # partial counts go on to the shuffle
                    yield told()
                    seen.clear()
        yield told()

    counts = rows.select("fold", "text").mapInArrow(count, "entry string, fold int, n long")
    sums = counts.groupBy("entry").agg(*(F.coalesce(F.sum(F.when(F.col("fold") == k, F.col("n"))), F.lit(0)).alias(f"f{k}") for k in range(FOLDS)))
    return {r["entry"]: np.array(r[1:], dtype=float) for r in sums.filter(sum(F.col(f"f{k}") for k in range(FOLDS)) >= least).collect()}


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        featurize = Featurizer(m.lexicon)
        for batch in batches:
            s = m.scores([t or "" for t in batch.column("text").to_pylist()], featurize)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    out = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", (_fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """docs less the rows that score at or over the threshold; columns and types stay."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        featurize = Featurizer(m.lexicon)
        for batch in batches:
            s = m.scores([t or "" for t in batch.column("text").to_pylist()], featurize)
            yield batch.filter(pa.array(s < threshold))

    return docs.mapInArrow(run, docs.schema)
