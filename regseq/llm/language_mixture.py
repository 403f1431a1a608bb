"""Language proportions of documents by expectation-maximisation over word likelihoods.

Training counts hashed byte trigrams of words for each language over all training texts (one
aggregation; what comes to the driver is languages x BUCKETS counts).  A text is a mixture:
each word was written in one language, with the likelihood of its trigrams there.  EM finds
the proportions.  The language set is chosen by penalised likelihood: sets grow along the
proportions of the full mixture, and one more language must raise the log-likelihood by more
than its share of the Bayesian information criterion.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regseq.llm import textbytes as tb
from regseq.llm.common import fold, out_schema, shuffle_free_map

BUCKET_BITS = 15
SMOOTHING = 0.05
STEPS = 12
#: Log-likelihood that one more language must bring, in units of log(words) / 2.
PENALTY = 2.0

LETTER = tb.ALNUM.copy()
LETTER[0x30:0x3A] = False
#: Lower case for letters, a space for everything else.
_FACE = np.where(LETTER, tb.LOWER, 0x20).astype(np.uint64)

_COLUMNS = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("proportions", T.MapType(T.StringType(), T.DoubleType()))]


class Model(NamedTuple):
    languages: list[str]
    logs: np.ndarray  # languages x buckets


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the trigrams around each letter byte, and each word's first and last letter's place among them."""
    starts, ends = tb.spans(data, offsets, LETTER)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none
    face = np.full(len(data) + 2, 0x20, np.uint64)
    face[1:-1] = _FACE[data]
    left, right = face[:-2].copy(), face[2:].copy()
    left[starts], right[ends - 1] = 0x20, 0x20
    code = (left << np.uint64(16)) | (face[1:-1] << np.uint64(8)) | right
    bucket = ((code * np.uint64(tb.BASE)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    letter = LETTER[data]
    place = np.cumsum(letter)
    return bucket[letter], place[starts] - 1, place[ends - 1]


def train(docs: DataFrame) -> Model:
    """From text and non-null lang of all rows of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for s in tb.slices(batches):
            lang = s.batch.column(s.batch.schema.get_field_index("lang")).to_pylist()
            buckets, first, stop = _trigrams(s.data, s.offsets)
            if not len(buckets):
                continue
            starts, _ = tb.spans(s.data, s.offsets, LETTER)
            name, code = np.unique(np.array(lang, object).astype(str), return_inverse=True)
            doc = np.searchsorted(s.offsets, starts, "right") - 1
            per = np.repeat(code.reshape(-1)[doc], stop - first)
            got = np.bincount((per << BUCKET_BITS) + buckets, minlength=len(name) << BUCKET_BITS).reshape(len(name), -1)
            for k, v in zip(name.tolist(), got, strict=True):
                counts[k] = counts[k] + v if k in counts else v
        for k, v in counts.items():
            some = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(v[some])], names=["lang", "bucket", "n"])

    rows = docs.filter("lang is not null and text is not null").select("lang", "text").mapInArrow(run, "lang string, bucket int, n long")
    got = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages, code = np.unique(np.array(got["lang"].to_pylist(), object).astype(str), return_inverse=True)
    counts = np.zeros((len(languages), 1 << BUCKET_BITS))
    counts[code.reshape(-1), got["bucket"].to_numpy()] = got["n"].to_numpy()
    counts += SMOOTHING
    return Model(languages.tolist(), np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32))


def _em(w: np.ndarray, doc: np.ndarray, first: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each document from its words' relative likelihoods, and log-likelihoods."""
    pi, n = start, np.maximum(np.diff(first), 1)[:, None]
    for step in range(STEPS + 1):
        r = w * pi[doc]
        total = np.maximum(r.sum(axis=1, keepdims=True), 1e-300)
        if step == STEPS:
            return pi, tb.sums_by(np.log(total[:, 0]), first, float)
        r /= total
        pi = np.column_stack([tb.sums_by(r[:, k], first, float) for k in range(w.shape[1])]) / n


def mixtures(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Language proportions (documents x languages); zeros for documents without letters."""
    n, k = len(offsets) - 1, len(model.languages)
    buckets, lo, hi = _trigrams(data, offsets)
    out = np.zeros((n, k))
    if not len(buckets) or not k:
        return out
    starts, _ = tb.spans(data, offsets, LETTER)
    first = np.searchsorted(starts, offsets)
    logs = np.empty((len(lo), k))
    for j in range(k):
        run = np.zeros(len(buckets) + 1)
        np.cumsum(model.logs[j][buckets], out=run[1:])
        logs[:, j] = run[hi] - run[lo]
    single = np.column_stack([tb.sums_by(logs[:, j], first, float) for j in range(k)])
    top = logs.max(axis=1, keepdims=True)
    w = np.exp(np.maximum(logs - top, -60))
    doc = tb.doc_of(first)
    words = np.diff(first)
    have = words > 0
    base = tb.sums_by(top[:, 0], first, float)
    pi, full = _em(w, doc, first, np.full((n, k), 1 / k))
    price = PENALTY * 0.5 * np.log(np.maximum(words, 2))
    # Sets of 1, 2, ... languages in order of the full mixture; the best single language begins.
    rank = np.argsort(-(pi + 10 * (single == single.max(axis=1, keepdims=True))), axis=1, kind="stable")
    out[np.flatnonzero(have), rank[have, 0]] = 1.0
    best = single[np.arange(n), rank[:, 0]]
    # No set can pass the full mixture, so a document is done once that would not pay for a language more.
    live = np.flatnonzero(have & (full + base - best > price))
    for size in range(2, k + 1):
        if not len(live):
            break
        keep = np.isin(doc, live)
        chosen = rank[live, :size]
        sub_first = np.concatenate([[0], np.cumsum(words[live])])
        sub_doc = tb.doc_of(sub_first)
        sub = np.take_along_axis(w[keep], chosen[sub_doc], axis=1)
        mixed, value = _em(sub, sub_doc, sub_first, np.full((len(live), size), 1 / size))
        value += base[live]
        better = value - best[live] > price[live]
        rows = live[better]
        out[rows] = 0
        out[rows[:, None], chosen[better]] = mixed[better]
        best[rows] = value[better]
        live = rows[full[rows] + base[rows] - best[rows] > price[rows]]
    return out


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score (its proportion) and proportions, from nothing but the text.

    lang_pred is "und", with score 0 and no proportions, where text is null or has no letter
    (or where nothing was learnt).  Ties go to the language that sorts first.  Rows keep
    their number; columns with the results' names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for s in tb.slices(batches):
            pi = mixtures(m, s.data, s.offsets)
            lettered = tb.sums_by(LETTER[s.data] & (s.data < 0x80), s.offsets) > 0
            unsure = np.flatnonzero(~lettered & (pi.sum(axis=1) > 0))
            for i in unsure.tolist():
                # Bytes beyond ASCII may be symbols.
                text = s.data[s.offsets[i] : s.offsets[i + 1]].tobytes().decode("utf-8", "replace")
                if not any(map(str.isalpha, text)):
                    pi[i] = 0
            best = pi.argmax(axis=1) if len(m.languages) else np.zeros(len(pi), np.int64)
            found = pi.sum(axis=1) > 0
            names = np.array([*m.languages, "und"], object)[np.where(found, best, len(m.languages))]
            score = np.where(found, pi.max(axis=1, initial=0.0), 0.0)
            row, col = np.nonzero(pi)
            maps = pa.MapArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(pi) + 1)).astype(np.int32)), pa.array(np.array(m.languages, object)[col].tolist(), pa.string()), pa.array(pi[row, col]))
            yield tb.with_columns(s.batch, {"lang_pred": pa.array(names.tolist(), pa.string()), "score": np.minimum(score, 1.0), "proportions": maps})

    return shuffle_free_map(docs, run, out_schema(docs, _COLUMNS))


def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.filter(fold(3) != 1))
    found = identify(docs.select("doc_id", (fold(3) == 1).alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")
