"""Importance resampling towards a target distribution, drawn by parallel sorting by regular sampling.

Features are runs of words, hashed into BUCKETS buckets.  A bucket's gain is the log of how much
more frequent it is in the target than in the corpus, a document's weight the sum of its
features' gains, kept as arrays of BUCKETS numbers.  Scores add Gumbel noise that the document's
id fixes, so that the highest scores are a draw in proportion to the weights.

The draw sorts all scores: every run of a task is sorted where it is and gives samples at
regular distances; the samples' own regular places split all rows into segments; a segment is
sorted for itself, and the counts of those before it make its ranks exact.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regseq.llm.common import small_batches, stored

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
#: Samples that a sorted run gives at most.
SAMPLES = 64
#: Rows of a sorted run at most; a task may hold several.
RUN = 1 << 18
#: Words whose bucket a task remembers.
REMEMBER = 1 << 19

#: A-Z in lower case; what is no digit, no letter of a-z and no byte beyond ASCII is a space.
_WORDS = bytes(b + 0x20 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


class Buckets(dict):
    """The bucket of each feature's bytes."""

    def __init__(self, buckets: int) -> None:
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBER:
            self.clear()
        self[feature] = out = zlib.crc32(feature) % self.buckets
        return out

    def of(self, text: bytes, most: int) -> tuple[int, np.ndarray]:
        """The number of words, and the bucket of every run of 1 to `most` words."""
        words = text.translate(_WORDS).split()
        features = words if most == 1 else [b" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]
        return len(words), np.fromiter(map(self.__getitem__, features), np.int64, len(features))


def _texts(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(*columns, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def bucket_counts(docs: DataFrame, most: int, buckets: int) -> np.ndarray:
    """Features in each bucket over all rows; tasks hand on sums, and `buckets` numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = Buckets(buckets), np.zeros(buckets, np.int64)
        for b in batches:
            for text in b.column("text"):
                total += np.bincount(known.of(text.as_py(), most)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in _texts(docs).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each of B buckets, in doubles."""
    b = len(corpus)
    s, t = float(corpus.sum()) + b, float(target.sum()) + b
    return np.array([math.floor(1000 * math.log((y + 1.0) * s / ((x + 1.0) * t))) for x, y in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise in thousandths, from the id; a null id is the empty text."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gain: np.ndarray, most: int, seed: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        known = Buckets(len(g))
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            rows = []
            for doc, text in zip(ids, b.column("text"), strict=True):
                n, at = known.of(text.as_py(), most)
                weight = int(g[at].sum())
                rows.append((n, len(at), weight, weight + noise(doc, seed)))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return _texts(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def _keys(b: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(-score, doc_id), which ascend in the order of the draw; rows without doc_id come last of equal ones."""
    ids = b.column("doc_id").fill_null(np.iinfo(np.int64).max)
    return -b.column("score").to_numpy(), ids.to_numpy()


def regular_samples(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Keys at regular distances of all sorted runs, with the rows each stands for; SAMPLES of a run at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sample(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            score, doc = _keys(pa.Table.from_batches(held))
            order = np.lexsort((doc, score))
            step = -(-len(order) // SAMPLES)
            at = order[step - 1 :: step]
            return pa.RecordBatch.from_arrays([pa.array(score[at]), pa.array(doc[at]), pa.array(np.full(len(at), step))], names=["score", "doc_id", "n"])

        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= RUN:
                yield sample(held)
                held = []
        if held:
            yield sample(held)

    got = rows.select("score", "doc_id").mapInArrow(run, "score long, doc_id long, n long").collect()
    return np.array([tuple(r) for r in got], np.int64).reshape(-1, 3)


def splitters(samples: np.ndarray, segments: int) -> np.ndarray:
    """Up to segments - 1 keys that cut the sampled rows into equal shares."""
    order = samples[np.lexsort((samples[:, 1], samples[:, 0]))]
    if not len(order):
        return order[:, :2]
    seen = np.cumsum(order[:, 2])
    want = seen[-1] * np.arange(1, segments) // segments
    return np.unique(order[np.minimum(np.searchsorted(seen, want), len(order) - 1), :2], axis=0)


def segmented(rows: DataFrame, cuts: np.ndarray) -> DataFrame:
    """rows with the number of cuts not above their key."""
    shared = rows.sparkSession.sparkContext.broadcast(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for b in batches:
            score, doc = _keys(b)
            # The cuts merged in: of equal keys the cut comes first.
            own = np.concatenate([np.zeros(len(c), np.int8), np.ones(len(score), np.int8)])
            order = np.lexsort((own, np.concatenate([c[:, 1], doc]), np.concatenate([c[:, 0], score])))
            place = np.empty(len(order), np.int64)
            place[order] = np.cumsum(own[order] == 0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place[len(c) :].astype(np.int32))], names=[*b.schema.names, "segment"])

    return rows.mapInArrow(run, f"{', '.join(f'{k} {t}' for k, t in rows.dtypes)}, segment int")


def ranked_scores(rows: DataFrame, segments: int | None = None) -> DataFrame:
    """rows (doc_id, score, ...) with rank, 1, 2, 3, ... by score descending, then doc_id, all in parallel."""
    spark = rows.sparkSession
    segments = segments or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = segmented(rows, splitters(regular_samples(rows), segments))
    # One row a segment.
    sizes = sorted(map(tuple, dealt.groupBy("segment").count().collect()))
    before = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    offsets = spark.createDataFrame([(s, b) for (s, _), b in zip(sizes, before[: len(sizes)], strict=True)], "segment int, before long")
    # Whole segments go to tasks by ranges of equal rows; a hash would put some tasks three.
    dealt = dealt.repartitionByRange("segment")
    merged = Window.partitionBy("segment").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), *(c for c in ("weight", "n_features") if c in rows.columns))
    return dealt.withColumn("rank", F.row_number().over(merged)).join(F.broadcast(offsets), "segment").withColumn("rank", F.col("rank") + F.col("before")).drop("segment", "before")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, most: int = 1, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs; rank is null where it is not drawn.

    Of the N rows with at least `least` words the floor(percent N / 100) of highest score are
    drawn.  Null texts have no words: weight 0, never drawn.  Equal scores go by doc_id; rows
    of one doc_id have the same noise, and repeated rows take one place each.  Rows without
    doc_id have the noise of an empty id and come last of equal scores.  An empty target gives
    gains that favour rare buckets.  Other columns are not read.  The empty table gives the
    empty table.
    """
    small_batches(docs.sparkSession)
    gain = gains(bucket_counts(docs, most, buckets), bucket_counts(target, most, buckets))
    rows = stored(scores(docs, gain, most, seed))
    ready = rows.filter(F.col("n_words") >= least)
    take = percent * ready.count() // 100
    out = ranked_scores(ready).withColumn("rank", F.when(F.col("rank") <= take, F.col("rank")))
    rest = rows.filter(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long"))
    return out.unionByName(rest).select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


def op13_regular_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: CRC-32 is spelt out, once for each distinct word.
ORACLE_SQL = r"""
WITH tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
src AS (SELECT row_number() OVER () AS r, doc_id, 'd' AS part, text FROM documents UNION ALL SELECT 0, NULL, 'b', text FROM benchmark),
o AS (SELECT r, part, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM src),
h AS (SELECT word, hex(encode(word)) AS x FROM (SELECT DISTINCT word FROM o)),
cut AS (SELECT word, list_transform(range(length(x) // 2), lambda j: ('0x' || substr(x, (2 * j + 1)::INT, 2))::BIGINT) AS l FROM h),
w AS (SELECT word, xor(list_reduce(list_concat([4294967295::BIGINT], l), lambda c, v: xor(c >> 8, t[xor(c & 255, v) + 1])), 4294967295::BIGINT) % 10000 AS bucket FROM cut, tab),
n AS (SELECT bucket, count(*) FILTER (part = 'd') AS s, count(*) FILTER (part = 'b') AS t FROM o JOIN w USING (word) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM n) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM n) + 10000)::DOUBLE)))::BIGINT AS gain FROM n),
f AS (SELECT r, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM o JOIN w USING (word) JOIN g USING (bucket) WHERE part = 'd' GROUP BY r),
z AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h FROM src LEFT JOIN f USING (r) WHERE part = 'd'),
y AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM z),
k AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS k, count(*) OVER (PARTITION BY n_features >= 20) AS many FROM y)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN n_features >= 20 AND k <= 10 * many // 100 THEN k END::BIGINT AS rank FROM k
"""
