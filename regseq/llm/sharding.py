"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Records are hashed into SLOTS slots, whose number never changes.  Bytes are summed per slot
(one small shuffle of sums), and the map from slots to shards, SLOTS rows whatever the
input, is made or edited on the driver and stored as a table with one version after another.
Texts are not moved to find a record's shard: only ids and sizes are.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regseq.llm.common import shared_folder

SLOTS = 1 << 14
SHARDS = 40
#: Bytes of a record beside its text.
RECORD = 16
#: Rebalancing stops when no shard is further than this share from the mean.
TOLERANCE = 0.01


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot): a null text has no bytes and the checksum of the empty text."""
    crc = F.coalesce(F.crc32("text"), F.lit(0)).cast("long")
    sized = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + RECORD).cast("long").alias("size"), crc.alias("text_crc32"))
    return sized.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int"))


def slot_sizes(rows: DataFrame, slots: int = SLOTS) -> pd.DataFrame:
    """Bytes and rows of every slot, empty ones too; at most `slots` rows come to the driver."""
    got = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).toPandas().set_index("virtual_slot")
    return got.reindex(range(slots), fill_value=0).astype("int64")


def assign(sizes: pd.DataFrame, shards: int) -> pd.Series:
    """A first map: the largest slot left goes to the shard with the fewest bytes."""
    heap = [(0, k) for k in range(shards)]
    out = {}
    for slot, size in sorted(sizes["bytes"].items(), key=lambda x: (-x[1], x[0])):
        total, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (total + size, shard))
    return pd.Series(out, name="shard").sort_index()


def rebalance(old: pd.Series, sizes: pd.DataFrame, shards: int, tolerance: float = TOLERANCE) -> pd.Series:
    """The map edited for new sizes or another number of shards: slots stay where they are as far as
    the shards' bytes then are within `tolerance` of the mean, and only moved slots change."""
    new = old.copy()
    size = sizes["bytes"]
    mean = size.sum() / shards
    total = size.groupby(new).sum().reindex(range(max(shards, int(new.max()) + 1)), fill_value=0)
    loose = [s for s in new.index if new[s] >= shards]
    for shard in range(shards):
        # From a shard of too many bytes slots leave, largest first, while it keeps its share.
        over = total[shard] - mean
        for slot in size[new == shard].sort_values(ascending=False, kind="stable").index if over > tolerance * mean else []:
            if size[slot] and size[slot] <= over:
                loose.append(slot)
                over -= size[slot]
                total[shard] -= size[slot]
    heap = [(int(total[k]), k) for k in range(shards)]
    heapq.heapify(heap)
    for slot in sorted(loose, key=lambda s: (-size[s], s)):
        have, shard = heapq.heappop(heap)
        new[slot] = shard
        heapq.heappush(heap, (have + int(size[slot]), shard))
    return new


def store_map(spark: SparkSession, path: str, version: int, shards: pd.Series, sizes: pd.DataFrame) -> None:
    """Adds a version to the map's table; earlier ones stay."""
    rows = pd.DataFrame({"virtual_slot": shards.index, "shard": shards.to_numpy(), "bytes": sizes["bytes"].reindex(shards.index).to_numpy(), "rows": sizes["rows"].reindex(shards.index).to_numpy()})
    schema = "virtual_slot int, shard int, bytes long, rows long"
    spark.createDataFrame(rows, schema).withColumn("version", F.lit(version)).coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the map, by default the last."""
    table = spark.read.schema("virtual_slot int, shard int, bytes long, rows long, version int").parquet(path)
    version = table.agg(F.max("version")).first()[0] if version is None else version
    return table.filter(F.col("version") == version).drop("version")


def place(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """rows with their shard and their place in it, gapless from 0.

    A shard is its slots one after another.  Numbering runs inside slots, so no task gets a
    shard; the offsets of slots come from the map, whose SLOTS rows are broadcast.
    """
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slot_map.withColumn("offset", F.coalesce(F.sum("rows").over(before), F.lit(0))).select("virtual_slot", "shard", "offset")
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("__at", F.row_number().over(inside) - 1)
    return numbered.join(F.broadcast(offsets), "virtual_slot").withColumn("slot", (F.col("offset") + F.col("__at")).cast("long")).drop("offset", "__at")


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot) of every row, by bytes.

    The law is "bytes": the shards' sizes are as near to equal as whole slots allow, so
    grown_shard is null.  Repeated rows, and rows without doc_id but of equal texts, share a
    virtual slot.  The map is stored as version 1 at `path` (a new shared folder by default).
    The empty table gives the empty table.
    """
    spark = docs.sparkSession
    rows = records(docs, slots)
    sizes = slot_sizes(rows, slots)
    path = path or shared_folder(spark)
    store_map(spark, path, 1, assign(sizes, shards), sizes)
    placed = place(rows, load_map(spark, path))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op9_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
