"""Quality rules: fixed minimum rules, then gradient-boosted trees over document statistics.

The trees are fitted on a bounded sample of labelled documents (`SAMPLE_ROWS`), flattened
into numpy node arrays (gbt.Trees) and sent to the tasks; the counts and the scores cover
every whole text.  More symbols, repeated lines or repeated words can never raise a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regseq.llm import docstats, gbt
from regseq.llm import textbytes as tb
from regseq.llm.common import labelled_sample, out_schema, shuffle_free_map, small_batches

#: Bound of the labelled sample that the trees are fitted on.
SAMPLE_ROWS = 20_000
#: A document is rejected when its probability of quality 1 is below this.
THRESHOLD = 0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "distinct_share": 1}

_COLUMNS = [*((k, T.LongType()) for k in docstats.COUNTS), ("base_failed", T.BooleanType()), ("quality_score", T.DoubleType()), ("kept", T.BooleanType())]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for s in tb.slices(batches):
        x = docstats.feature_matrix(docstats.doc_stats(s.data, s.offsets))
        flat = pa.array(x.reshape(-1))
        yield pa.RecordBatch.from_arrays([s.batch.column(s.batch.schema.get_field_index("quality")), pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), flat)], names=["quality", "x"])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> gbt.Trees:
    """Fits the trees on at most sample_rows labelled documents of the training fold."""
    sample = labelled_sample(docs, labels, "quality", sample_rows)
    got = sample.mapInArrow(_features, "quality int, x array<double>").toArrow()
    x = np.asarray(got["x"].combine_chunks().flatten(), float).reshape(-1, len(docstats.FEATURES))
    y = np.asarray(got["quality"], float)
    # A stable order makes the fit independent of how Spark returned the rows.
    order = np.lexsort((*x.T, y))
    return gbt.fit(x[order], y[order], np.array([MONOTONE.get(k, 0) for k in docstats.FEATURES]))


def quality_rules(docs: DataFrame, trees: gbt.Trees, threshold: float = THRESHOLD, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """docs with the counts, `base_failed`, `quality_score` and `kept` beside its columns.

    A null or empty text has no words, so it fails the base rules.  Rows keep their order and
    number: nothing is shuffled, repeated rows get equal results, and columns of the same
    names as the results are replaced.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in tb.slices(batches):
            stats = docstats.doc_stats(s.data, s.offsets)
            words, rep = stats["n_words"], stats["n_repeat_words"]
            failed = (words < min_words) | (100 * rep > max_repeat_percent * words)
            p = shared.value.score(docstats.feature_matrix(stats))
            yield tb.with_columns(s.batch, {k: stats[k] for k in docstats.COUNTS} | {"base_failed": failed, "quality_score": p, "kept": ~failed & (p >= threshold)})

    return shuffle_free_map(docs, score, out_schema(docs, _COLUMNS))


def filter_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents kept, with their columns as they were."""
    own = {c: f"__own_{c}" for c in docs.columns if c in dict(_COLUMNS)}
    flagged = quality_rules(docs.withColumnsRenamed(own), train(docs, labels)).filter(F.col("kept"))
    return flagged.select([F.col(own.get(c, c)).alias(c) for c in docs.columns])


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules(docs.select("doc_id", "text"), train(docs, labels)).drop("text")


__all__ = ["filter_quality", "op7_quality_rules", "quality_rules", "train"]
