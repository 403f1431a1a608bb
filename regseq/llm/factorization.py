"""Quality classifier: a factorisation machine over hashed words, statistics and metadata.

A text's features are its distinct words (hashed), each statistic's bin, and the bin of its
length as metadata.  The score is a linear term plus all pairwise interactions through
vectors of RANK numbers, in time linear in the features by
sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).

The machine is fitted by Adam on a bounded sample of labelled texts (`SAMPLE_ROWS`) of the
training fold, broadcast, and applied to every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from regseq.llm import docstats
from regseq.llm import textbytes as tb
from regseq.llm.common import fold, labelled_sample, out_schema, shuffle_free_map

SAMPLE_ROWS = 8_000
BUCKETS = 1 << 15
BINS = 12
RANK = 8
EPOCHS = 8
BATCH = 256
#: Weight of all words of a text together, against 1 for each statistic.
WORD_MASS = 2.0

_COLUMNS = [("score", T.DoubleType()), ("predicted", T.IntegerType())]


class Machine(NamedTuple):
    edges: np.ndarray  # statistics x (BINS - 1)
    bias: float
    weights: np.ndarray
    vectors: np.ndarray


class Rows(NamedTuple):
    """Sparse rows: feature numbers and values end to end, and each row's bounds."""

    index: np.ndarray
    value: np.ndarray
    first: np.ndarray


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word buckets of each text, and their bounds."""
    starts, ends = tb.spans(data, offsets, tb.NOT_SPACE)
    doc = tb.doc_of(np.searchsorted(starts, offsets))
    bucket = (tb.word_hashes(data, starts, ends) >> np.uint64(64 - 15)).astype(np.int64)
    both = np.unique(doc * BUCKETS + bucket)
    return both % BUCKETS, np.searchsorted(both // BUCKETS, np.arange(len(offsets)))


def _rows(words: np.ndarray, first: np.ndarray, stats: np.ndarray, edges: np.ndarray) -> Rows:
    n, k = stats.shape
    bins = np.column_stack([np.searchsorted(edges[j], stats[:, j], "left") + BUCKETS + j * BINS for j in range(k)])
    count = np.diff(first)
    bounds = np.concatenate([[0], np.cumsum(count + k)])
    index, value = np.empty(bounds[-1], np.int64), np.ones(bounds[-1])
    at = np.repeat(bounds[:-1] - first[:-1], count) + np.arange(len(words))
    index[at] = words
    value[at] = WORD_MASS / np.sqrt(np.repeat(np.maximum(count, 1), count))
    index[(bounds[1:] - k)[:, None] + np.arange(k)] = bins
    return Rows(index, value, bounds)


def _logits(m: Machine, r: Rows) -> tuple[np.ndarray, np.ndarray]:
    """Scores before the logistic function, and each row's sums over v x."""
    row = tb.doc_of(r.first)
    n = len(r.first) - 1
    vx = m.vectors[r.index] * r.value[:, None]
    sums = np.column_stack([np.bincount(row, vx[:, f], n) for f in range(vx.shape[1])])
    own = np.bincount(row, (vx**2).sum(axis=1), n)
    return m.bias + np.bincount(row, m.weights[r.index] * r.value, n) + 0.5 * ((sums**2).sum(axis=1) - own), sums


def fit(r: Rows, y: np.ndarray, features: int, edges: np.ndarray, seed: int = 7) -> Machine:
    rng = np.random.default_rng(seed)
    p = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    m = Machine(edges, float(np.log(p / (1 - p))), np.zeros(features), rng.normal(0, 0.02, (features, RANK)))
    if not len(y) or y.min() == y.max():
        return m._replace(vectors=np.zeros_like(m.vectors))
    theta = np.column_stack([m.weights, m.vectors])
    one, two, bias, b1, b2 = np.zeros_like(theta), np.zeros_like(theta), m.bias, 0.0, 0.0
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), BATCH):
            pick = order[lo : lo + BATCH]
            count = np.diff(r.first)[pick]
            first = np.concatenate([[0], np.cumsum(count)])
            at = np.repeat(r.first[pick] - first[:-1], count) + np.arange(first[-1])
            part = Rows(r.index[at], r.value[at], first)
            z, sums = _logits(m._replace(bias=bias, weights=theta[:, 0], vectors=theta[:, 1:]), part)
            g = (1 / (1 + np.exp(-z)) - y[pick]) / len(pick)
            row = tb.doc_of(first)
            gx = g[row] * part.value
            grad = np.column_stack([np.bincount(part.index, gx, features), *(np.bincount(part.index, gx * (sums[row, f] - theta[part.index, 1 + f] * part.value), features) for f in range(RANK))])
            grad += 1e-6 * theta
            step += 1
            one = 0.9 * one + 0.1 * grad
            two = 0.99 * two + 0.01 * grad**2
            theta = theta - 0.02 * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.99**step)) + 1e-8)
            b1, b2 = 0.9 * b1 + 0.1 * g.sum(), 0.99 * b2 + 0.01 * g.sum() ** 2
            bias -= 0.02 * (b1 / (1 - 0.9**step)) / (np.sqrt(b2 / (1 - 0.99**step)) + 1e-8)
    return m._replace(bias=float(bias), weights=theta[:, 0].copy(), vectors=theta[:, 1:].copy())


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for s in tb.slices(batches):
        words, first = _words(s.data, s.offsets)
        x = docstats.feature_matrix(docstats.doc_stats(s.data, s.offsets))
        yield pa.RecordBatch.from_arrays(
            [s.batch.column(s.batch.schema.get_field_index("quality")), pa.ListArray.from_arrays(first.astype(np.int32), pa.array(words.astype(np.int32))), pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.reshape(-1)))],
            names=["quality", "words", "stats"],
        )


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Machine:
    """Fitted on at most sample_rows labelled texts of the training fold."""
    k = len(docstats.FEATURES)
    got = labelled_sample(docs, labels, "quality", sample_rows).mapInArrow(_sparse, "quality int, words array<int>, stats array<double>").toArrow()
    stats = np.asarray(got["stats"].combine_chunks().flatten(), float).reshape(-1, k)
    y = np.asarray(got["quality"], float)
    words = got["words"].combine_chunks()
    words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
    count = np.diff(np.asarray(words.offsets, np.int64))
    flat = words.flatten().to_numpy()
    # A stable order makes the fit independent of how Spark returned the rows.
    order = np.lexsort((*stats.T, y))
    begin = np.concatenate([[0], np.cumsum(count)])
    size = count[order]
    first = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(begin[:-1][order] - first[:-1], size) + np.arange(first[-1])
    stats, y = stats[order], y[order]
    edges = np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T.copy() if len(y) else np.zeros((k, BINS - 1))
    return fit(_rows(flat[at], first, stats, edges), y, BUCKETS + k * BINS, edges)


def classify(docs: DataFrame, machine: Machine) -> DataFrame:
    """docs with score (0 to 1: how likely quality 1 is) and predicted (1 from 0.5 on), from the text alone.

    Null and empty texts have no words; their statistics are scored like any.  Rows keep their
    number, repeated rows get equal scores; columns with the results' names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in tb.slices(batches):
            x = docstats.feature_matrix(docstats.doc_stats(s.data, s.offsets))
            z, _ = _logits(shared.value, _rows(*_words(s.data, s.offsets), x, shared.value.edges))
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield tb.with_columns(s.batch, {"score": p, "predicted": (p >= 0.5).astype(np.int32)})

    return shuffle_free_map(docs, run, out_schema(docs, _COLUMNS))


def op10_factorization_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    machine = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classify(docs.select("doc_id", (fold(3) == 1).alias("held_out"), "text"), machine).drop("text")
