"""Quality classifier: a generalised additive model with pairwise interactions, learned by cyclic boosting."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossweave.llm.held import release
from crossweave.llm.registry import query, refuse_names, table
from crossweave.llm.words import sub_batches, word_hashes

FEATURES = ("words", "word_bytes", "symbols", "upper", "digits", "wide", "stops", "commas", "marks", "spaces", "lines",
            "distinct", "most_common", "adjacent", "repeated_lines", "line_share", "short_words", "long_words")
_CLASS = np.zeros(256, dtype=np.int64)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r", b"\n", b".?", b",;:", b"!")):
    _CLASS[list(_chars)] = _k + 1
_CLASS[128:] = 9


def features(texts: list[bytes]) -> np.ndarray:
    """texts x FEATURES of whole UTF-8 texts. All are finite, also for an empty text."""
    n = len(texts)
    size = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    owner = np.repeat(np.arange(n), size)
    count = np.bincount(owner * 10 + _CLASS[data], minlength=10 * n).reshape(n, 10).astype(float)
    hashes, ends = word_hashes(texts)
    starts = np.concatenate(([0], ends[:-1]))
    words = (ends - starts).astype(float)
    mine = np.repeat(np.arange(n), ends - starts)
    order = np.lexsort((hashes, mine))
    h, o = hashes[order], mine[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(h)))
    distinct = np.bincount(o[at], minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, o[at], runs)
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (mine[1:] == mine[:-1])
    adjacent = np.bincount(mine, weights=same, minlength=n)
    short, long = np.zeros(n), np.zeros(n)
    repeated, share, lines = np.zeros(n), np.zeros(n), np.zeros(n)
    for i, text in enumerate(texts):
        rows = [r for r in text.split(b"\n") if r.strip()]
        lines[i] = len(rows)
        if len(rows) > 1:
            tally = Counter(rows)
            repeated[i] = 1 - len(tally) / len(rows)
            share[i] = max(len(r) * c for r, c in tally.items() if c > 1) / len(text) if len(tally) < len(rows) else 0
        sizes = np.fromiter(map(len, text.split()), dtype=np.int64)
        if len(sizes):
            short[i], long[i] = (sizes <= 2).mean(), (sizes > 14).mean()
    b, w = np.maximum(size, 1), np.maximum(words, 1)
    letters = np.maximum(count[:, 1] + count[:, 2], 1)
    return np.stack([np.log1p(words), (b - count[:, 4] - count[:, 5]) / w, count[:, 0] / b, count[:, 1] / letters, count[:, 3] / b, count[:, 9] / b,
                     count[:, 6] / w, count[:, 7] / w, count[:, 8] / w, count[:, 4] / b, np.log1p(lines) - np.log1p(words), distinct / w, most / w,
                     adjacent / w, repeated, share, short, long], axis=1)


class AdditiveModel:
    """score = sigmoid(intercept + sum of per-feature tables + sum of pair tables), all looked up by bin."""

    def __init__(self, bins: int = 48, rounds: int = 120, pair_rounds: int = 60, pairs: int = 8, rate: float = 0.15, coarse: int = 12,
                 least: int = 20, seed_rate: float = 0.5):
        self.bins, self.rounds, self.pair_rounds, self.n_pairs, self.rate = bins, rounds, pair_rounds, pairs, rate
        self.coarse, self.least, self.base = coarse, least, seed_rate

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        n, d = x.shape
        share = float(np.clip((y.sum() + 1) / (n + 2), 1e-6, 1 - 1e-6)) if n else self.base
        self.intercept = float(np.log(share / (1 - share)))
        cut = lambda k: [np.unique(np.quantile(x[:, j], np.arange(1, k) / k)) if n else np.zeros(0) for j in range(d)]
        self.edges, self.wide = cut(self.bins), cut(self.coarse)
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs, self.grids = [], []
        if not n or y.min() == y.max():
            return self
        fine, rough = self.place(x, self.edges), self.place(x, self.wide)
        logit = np.full(n, self.intercept)
        for _ in range(self.rounds):  # one feature after the other, each by a small step on what the others leave
            for j, t in enumerate(self.tables):
                g, h = self.slopes(y, logit)
                step = self.rate * self.curve(*(np.bincount(fine[:, j], weights=v, minlength=len(t)) for v in (g, h, np.ones(n))))
                t += step
                logit += step[fine[:, j]]
        g, h = self.slopes(y, logit)
        gain = {}
        for a, b in combinations(range(d), 2):
            shape = len(self.wide[a]) + 1, len(self.wide[b]) + 1
            cell = rough[:, a] * shape[1] + rough[:, b]
            sums = [np.bincount(cell, weights=v, minlength=shape[0] * shape[1]).reshape(shape) for v in (g, h, np.ones(n))]
            gain[a, b] = self.surface(*sums)[1]
        self.pairs = sorted(sorted(gain), key=lambda p: -gain[p])[:self.n_pairs]
        self.grids = [np.zeros((len(self.wide[a]) + 1, len(self.wide[b]) + 1)) for a, b in self.pairs]
        for _ in range(self.pair_rounds):
            for (a, b), grid in zip(self.pairs, self.grids):
                g, h = self.slopes(y, logit)
                cell = rough[:, a] * grid.shape[1] + rough[:, b]
                step = self.rate * self.surface(*(np.bincount(cell, weights=v, minlength=grid.size).reshape(grid.shape) for v in (g, h, np.ones(n))))[0]
                grid += step
                logit += step.ravel()[cell]
        return self

    @staticmethod
    def place(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)], axis=1)

    @staticmethod
    def slopes(y: np.ndarray, logit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    def best_cut(self, g, h, c) -> tuple[float, int]:
        """(gain, last bin of the left side) of the best split of a row of bins; gain 0 where none is allowed."""
        left_g, left_h, left_c = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(c)[:-1]
        if not len(left_g):
            return 0.0, 0
        all_g, all_h = g.sum(), h.sum()
        worth = left_g ** 2 / (left_h + 1) + (all_g - left_g) ** 2 / (all_h - left_h + 1) - all_g ** 2 / (all_h + 1)
        worth[(left_c < self.least) | (c.sum() - left_c < self.least)] = 0
        k = int(worth.argmax())
        return float(worth[k]), k

    def curve(self, g, h, c) -> np.ndarray:
        """Values of a tree with up to three leaves on ordered bins."""
        pieces = [(0, len(g))]
        for _ in range(2):
            found = [(*self.best_cut(g[a:b], h[a:b], c[a:b]), a, b) for a, b in pieces]
            gain, k, a, b = max(found)
            if gain <= 0:
                break
            pieces = [p for p in pieces if p != (a, b)] + [(a, a + k + 1), (a + k + 1, b)]
        out = np.empty(len(g))
        for a, b in pieces:
            out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
        return out

    def surface(self, g, h, c) -> tuple[np.ndarray, float]:
        """(values, gain) of a tree that cuts one axis and then each side along the other, the better of both orders."""
        best = (np.zeros(g.shape), 0.0)
        for turn in (False, True):
            a, b, n = (v.T if turn else v for v in (g, h, c))
            gain, k = self.best_cut(a.sum(1), b.sum(1), n.sum(1))
            values = np.empty(a.shape)
            for rows in (slice(0, k + 1), slice(k + 1, None)):
                more, m = self.best_cut(a[rows].sum(0), b[rows].sum(0), n[rows].sum(0))
                gain += more
                for columns in (slice(0, m + 1), slice(m + 1, None)):
                    values[rows, columns] = a[rows, columns].sum() / (b[rows, columns].sum() + 1)
            if gain > best[1]:
                best = values.T if turn else values, gain
        return best

    def score(self, x: np.ndarray) -> np.ndarray:
        fine, rough = self.place(x, self.edges), self.place(x, self.wide)
        logit = np.full(len(x), self.intercept)
        for j, t in enumerate(self.tables):
            logit += t[fine[:, j]]
        for (a, b), grid in zip(self.pairs, self.grids):
            logit += grid[rough[:, a], rough[:, b]]
        return 1 / (1 + np.exp(-logit))


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality") -> AdditiveModel:
    """The model, from the texts of at most `sample` labelled ids that are not held out, drawn by a hash of the id.

    That bound is the only use of a sample (and bounds what is broadcast and collected); scores are for all rows. Ids
    labelled both ways, null labels and null ids are left out. Without rows of both classes the model is the smoothed share of label 1.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).where(
        F.col("y").isin(0.0, 1.0) & F.col("id").isNotNull() & ~held_out("id"))
    known = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z")
    drawn = known.orderBy(F.xxhash64("id"), "id").limit(sample).select("id", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for part in sub_batches(zip(batch.column("y").to_pylist(), ((t or "").encode() for t in batch.column("text").to_pylist())), 1):
                yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in part], pa.float64()), pa.array(list(features([t for _, t in part])), pa.list_(pa.float64()))],
                                                 names=["y", "x"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "id")
    # one text an id, the least where ids repeat, so that no more than `sample` rows come back
    rows = texts.groupBy("id", "y").agg(F.min("text").alias("text")).select("y", "text").mapInArrow(run, "y double, x array<double>").collect()
    rows.sort(key=lambda r: (r.y, r.x))  # the fit does not depend on the order in which tasks end
    return AdditiveModel().fit(np.array([r.x for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r.y for r in rows]))


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = 20_000, text_col: str = "text") -> DataFrame:
    """docs, all its columns, with a column __score (0 to 1, higher for label 1), in one pass over the texts without a shuffle.

    Null and empty texts get a score like any other text; null ids are scored but not learned from; repeated
    rows are scored each; an empty table gives no rows; other columns are carried along, but one named __score is refused.
    """
    refuse_names(docs, "__score")
    model = train(docs, labels, sample, text_col=text_col)
    out = docs.withColumn("__score", F.lit(None).cast("double"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            score = [np.zeros(0)]
            for part in sub_batches((((t or "").encode(),) for t in batch.column(text_col).to_pylist()), 0):
                score.append(model.score(features([t for t, in part])))
            yield batch.set_column(batch.num_columns - 1, batch.schema.field(batch.num_columns - 1), pa.array(np.concatenate(score)))

    return out.mapInArrow(run, out.schema)


@query("op7_additive_quality")
def op7_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out().alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.3).cast("int").alias("predicted"))
