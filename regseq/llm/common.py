"""What several operators share: folds, labelled samples, schemas, shared folders."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fold(n: int, key: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod n; null ids are in fold 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % n, F.lit(0)).cast("int")


def out_schema(df: DataFrame, more: Iterable[tuple[str, T.DataType]]) -> T.StructType:
    """df's schema with columns put in place of those of the same names, or behind."""
    fields = {f.name: f.dataType for f in df.schema.fields} | dict(more)
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def shuffle_free_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """mapInArrow with columns in the schema's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in fn(batches):
            yield b.select(schema.names)

    return df.mapInArrow(run, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(text, label) of at most `rows` labelled documents of the training fold (crc32 mod 3 is not 1).

    The sample is chosen by a hash of the id, so it does not depend on the order of rows.
    Only the ids and labels of the sample, bounded by `rows`, are broadcast.
    """
    picked = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold(3) != 1))
        .select("doc_id", F.col(label).cast("int").alias(label))
        .dropDuplicates(["doc_id"])
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", label)


#: Whole texts are long rows: so many of them at most go to a Python worker at once.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to BATCH_ROWS rows, where they are larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see.

    On a cluster spark.checkpoint.dir names it.  Where that is unset, as in tests, it is a
    temporary folder of this machine.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = f"file://{tempfile.mkdtemp(prefix='regseq-')}"
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/regseq-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written to a new table in the shared folder and read again, which cuts its lineage."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
