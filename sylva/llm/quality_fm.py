"""A quality classifier: a factorisation machine over words, structure and metadata.

Features of a text are its distinct words hashed to buckets, bins of its
structure statistics, and bins of its length as metadata. A score is a
logistic function of a bias, weights and all pairwise interactions, whose
strengths are dot products of low-rank factors. The interactions are summed in
linear time: half of the square of the sum less the sum of the squares.

The model is fitted on at most SAMPLE labelled rows, those with the smallest
hashes of their ids; everything else covers all rows. What leaves the fit is
a fixed number of weights, whatever the input.

Defined results: a null text is empty and is scored like an empty one; a null
id counts as held out; repeated rows are scored each; several labels of one id
are averaged, and of several texts of one labelled id the smallest is learnt
from; without usable labels every score is 0.5; there are no ties but those of
the sample's hashes, settled by id; a very long text is measured whole by one
worker; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import Words, mix, split_words, slices
from .common import crc_mod, table
from .quality_rules import _SYMBOL, _lines, repeats

#: Labelled rows that the fit sees at most.
SAMPLE = 6_000
#: Buckets of hashed words, bins of a statistic, rank of the factors.
BUCKETS = 1 << 14
BINS = 12
RANK = 6
EPOCHS = 4
THRESHOLD = 0.3

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:?"]] = True
_SHOUT = np.zeros(256, bool)
_SHOUT[ord("!")] = True
STATS = 11


def _statistics(words: Words, offsets: np.ndarray, data: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """A row of STATS numbers for each text."""
    n = np.maximum(words.counts(), 1)
    size = np.maximum(np.diff(offsets), 1)

    def share(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(mask[data], out=sums[1:])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    in_windows, _, longest = repeats(words)
    newline = np.zeros(256, bool)
    newline[10] = True
    return np.stack(
        [
            np.log1p(words.counts()),
            np.log1p(np.diff(offsets)),
            np.diff(offsets) / n,
            distinct / n,
            share(_SYMBOL) / n,
            share(_UPPER) / size,
            share(_DIGIT) / size,
            share(_STOP) / n,
            share(_SHOUT) / n,
            in_windows / n,
            _lines(data, offsets, words.start) / (share(newline) + 1.0),
        ],
        axis=1,
    )


def _features(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, statistics, edges, buckets) of slices: text i has the sorted buckets from edges[i] to edges[i+1]."""
    for first, data, offsets in slices(texts):
        words = split_words(first, data, offsets)
        bucket = (mix(words.hash) >> np.uint64(40)).astype(np.int64) % BUCKETS
        both = np.unique(words.doc * BUCKETS + bucket)
        edges = np.searchsorted(both, np.arange(words.docs + 1) * BUCKETS)
        yield first, _statistics(words, offsets, data, np.diff(edges)), edges, both % BUCKETS


class Model:
    """Bin edges of the statistics, weights and factors."""

    def __init__(self, cuts: np.ndarray, seed: int = 7):
        self.cuts = cuts
        size = BUCKETS + STATS * BINS
        self.bias = 0.0
        self.w = np.zeros(size)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (size, RANK))

    def rows(self, stats: np.ndarray, edges: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(edges, features, values): each text's bins, of value 1, and its words, together of length 1."""
        docs = len(edges) - 1
        bins = np.stack([np.searchsorted(self.cuts[j], stats[:, j], "right") + BUCKETS + j * BINS for j in range(STATS)], axis=1)
        count = np.diff(edges)
        to = np.concatenate([[0], np.cumsum(count + STATS)])
        feature = np.empty(to[-1], np.int64)
        value = np.ones(to[-1])
        place = np.arange(len(buckets)) + np.repeat(to[:-1] + STATS - edges[:-1], count)
        feature[place] = buckets
        value[place] = np.repeat(1 / np.sqrt(np.maximum(count, 1)), count)
        feature[(to[:-1, None] + np.arange(STATS)).ravel()] = bins.ravel()
        return to, feature, value

    def margin(self, to: np.ndarray, feature: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Margins and the sums of the factors, in time linear in the features."""
        linear = np.add.reduceat(self.w[feature] * value, to[:-1])
        part = self.v[feature] * value[:, None]
        total = np.add.reduceat(part, to[:-1], axis=0)
        squares = np.add.reduceat(np.einsum("ij,ij->i", part, part), to[:-1])
        return self.bias + linear + 0.5 * (np.einsum("ij,ij->i", total, total) - squares), total

    def fit(self, rows: tuple[np.ndarray, np.ndarray, np.ndarray], y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.1, decay: float = 1e-5) -> None:
        """Adaptive gradient descent on the logistic loss, in small batches of a fixed order."""
        to, feature, value = rows
        gw, gv, gb = np.full(len(self.w), 1e-6), np.full(self.v.shape, 1e-6), 1e-6
        rng = np.random.default_rng(11)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for k in range(0, len(order), 64):
                batch = order[k : k + 64]
                width = to[batch + 1] - to[batch]
                cut = np.concatenate([[0], np.cumsum(width)])
                at = np.arange(cut[-1]) - np.repeat(cut[:-1] - to[batch], width)
                f, x = feature[at], value[at]
                m, total = self.margin(cut, f, x)
                g = (1 / (1 + np.exp(-np.clip(m, -30, 30))) - y[batch]) / len(batch)
                each = np.repeat(g, width) * x
                used, where = np.unique(f, return_inverse=True)
                dw = np.bincount(where, each) + decay * self.w[used]
                inner = np.repeat(total, width, axis=0) - self.v[f] * x[:, None]
                dv = np.stack([np.bincount(where, each * inner[:, r]) for r in range(RANK)], axis=1) + decay * self.v[used]
                gw[used] += dw * dw
                gv[used] += dv * dv
                gb += g.sum() ** 2
                self.w[used] -= rate * dw / np.sqrt(gw[used])
                self.v[used] -= 0.5 * rate * dv / np.sqrt(gv[used])
                self.bias -= rate * g.sum() / np.sqrt(gb)


def fit_quality(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "quality",
                modulus: int = 5, sample: int = SAMPLE) -> Model | None:
    """A model fitted on at most ``sample`` labelled rows whose crc32 remainder is not 0."""
    marks = labels.groupBy(F.col(id_col).alias("_id")).agg(F.avg(label).alias("_y")).where((crc_mod("_id", modulus) != 0) & F.col("_y").isNotNull())
    chosen = marks.orderBy(F.xxhash64(F.lit(3), "_id"), "_id").limit(sample)
    rows = docs.select(docs[id_col].alias("_id"), docs[text].alias("_text")).join(F.broadcast(chosen), "_id")
    # Of rows that repeat an id the smallest text is taken, so that the sample is the same in every run.
    rows = rows.groupBy("_id").agg(F.first("_y").alias("_y"), F.min(F.coalesce("_text", F.lit(""))).alias("_text")).select("_y", "_text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stats, edges, buckets in _features(batch.column(1)):
                flat = pa.FixedSizeListArray.from_arrays(pa.array(stats.ravel()), STATS).cast(pa.list_(pa.float64()))
                lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(buckets.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(edges) - 1), flat, lists], ["y", "stats", "buckets"])

    # A row of numbers for each sampled text, ``sample`` at most.
    got = rows.mapInArrow(measure, "y double, stats array<double>, buckets array<int>").toArrow()
    y = got.column("y").to_numpy()
    if not len(y) or y.min() == y.max():
        return None
    stats = np.stack(got.column("stats").to_pylist())
    lists = [np.sort(np.array(b, np.int64)) for b in got.column("buckets").to_pylist()]
    order = np.lexsort((y, *stats.T[::-1]))  # rows come in any order; the fit must not depend on it
    stats, y, lists = stats[order], y[order], [lists[i] for i in order]
    edges = np.concatenate([[0], np.cumsum([len(b) for b in lists])])
    cuts = np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    model = Model(np.ascontiguousarray(cuts))
    model.fit(model.rows(stats, edges, np.concatenate(lists)), y)
    return model


def score_quality(docs: DataFrame, model: Model | None, text: str = "text", id_col: str = "doc_id", modulus: int = 5) -> DataFrame:
    """One row per document: doc_id, held_out, score (probability of label 1) and predicted."""
    frame = docs.select(docs[id_col].alias("doc_id"), (crc_mod(id_col, modulus) == 0).alias("held_out"), docs[text].alias("_text"))
    kind = frame.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stats, edges, buckets in _features(batch.column(2)):
                docs = len(edges) - 1
                score = np.full(docs, 0.5)
                if model is not None:
                    margin, _ = model.margin(*model.rows(stats, edges, buckets))
                    score = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
                ids = [batch.column(i).slice(first, docs) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(score)], ["doc_id", "held_out", "score"])

    out = frame.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op4_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
