"""Best-fit packing into sequences of bounded length by minimum bin slack.

Documents become token ids (an end id behind each), and ids become pieces.  How pieces fit
together hangs on their lengths alone, so the packing is planned on the number of pieces of
each length, a table of at most CAPACITY rows whatever the input.  The largest length left
opens a bin; subset sums of the lengths left, as bits of one integer, say how full the bin can
get, and the fullest combination is taken, for as many bins at once as the counts allow.
Pieces then are numbered inside their length in two levels, and a piece's number says which
bin it is in and where: texts and ids never move.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regseq.llm import textbytes as tb
from regseq.llm.bpe import _printable, public_path
from regseq.llm.common import small_batches, stored
from regseq.operators.scan import prefix_scan

CAPACITY = 2048
END = 0

# Fixed value: how this public vocabulary's tokenizer cuts texts into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class ByteBpe:
    """A byte-level BPE file as a table of ranks; texts that this cannot cut go to the file's own library.

    Both give the same ids; the first takes a quarter of the time.
    """

    def __init__(self, spec: str) -> None:
        import tiktoken

        self.spec, self.whole = spec, None
        parsed = json.loads(spec)
        own = {x["content"]: x["id"] for x in parsed["added_tokens"]}
        byte = {c: b for b, c in enumerate(_printable())}
        ranks = {bytes(byte[c] for c in token): i for token, i in parsed["model"]["vocab"].items() if token not in own}
        self.fast = tiktoken.Encoding("corpus", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=own)

    def ids(self, text: str) -> list[int]:
        try:
            return self.fast.encode(text, allowed_special="all")
        except ValueError:  # white space too long for its matcher
            return self.slow(text)

    def slow(self, text: str) -> list[int]:
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_str(self.spec)
            self.whole.no_truncation()
            self.whole.no_padding()
        return self.whole.encode(text, add_special_tokens=False).ids


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): ids of each whole text and the end id, cut only where
    there are more than `capacity`; then the first piece takes the rest."""
    small_batches(docs.sparkSession)
    with open(path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(spec.value)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.array([*bpe.ids(text.as_py() or ""), end], "<u4")
                cuts = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
                out += [(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        del bpe
        tb.give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


class Use(NamedTuple):
    """A combination's share of one length: `times` bins from `bin` on take `each` of it, the pieces from `first` on, at `at`."""

    length: int
    first: int
    each: int
    times: int
    bin: int
    at: int


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many to take of each length so that their sum is as near to `room` as it gets, from below.

    A bit of an integer stands for each sum.  A length is offered in lots of 1, 2, 4, ... of
    it, as many as there are and fit; larger lengths come first, so a sum that they reach alone
    is read back as theirs.
    """
    reached, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, lot = min(counts[length], room // length), 1
        while left:
            lot = min(lot, left)
            steps.append((length, lot, reached))
            reached |= (reached << (length * lot)) & mask
            left -= lot
            lot *= 2
        if reached >> room & 1:
            break
    taken: dict[int, int] = {}
    total = reached.bit_length() - 1
    for length, lot, before in reversed(steps):
        if not before >> total & 1:
            taken[length] = taken.get(length, 0) + lot
            total -= length * lot
    return taken


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Use]:
    """Bins for `counts` pieces of each length (1 to capacity): minimum bin slack, the largest length left first.

    One combination serves as many bins as the counts allow before subset sums are taken
    again, so the work hangs on the number of lengths and not on that of pieces.
    """
    left = {k: n for k, n in counts.items() if n}
    used = dict.fromkeys(left, 0)
    out, number = [], 0
    while left:
        top = max(left)
        rest = left | {top: left[top] - 1}
        chosen = fullest(rest, capacity - top)
        chosen[top] = chosen.get(top, 0) + 1
        times = min(left[k] // n for k, n in chosen.items())
        at = 0
        for k in sorted(chosen, reverse=True):
            out.append(Use(k, used[k], chosen[k], times, number, at))
            at += k * chosen[k]
            used[k] += chosen[k] * times
            left[k] -= chosen[k] * times
            if not left[k]:
                del left[k]
        number += times
    return out


def placed(numbered: DataFrame, uses: list[Use]) -> DataFrame:
    """Pieces with `number` (from 0 inside their length), with their sequence_id and offset.

    The plan, a few rows for each length, goes to every task.
    """
    table = np.array(sorted(uses, key=lambda u: (u.length, u.first)), np.int64).reshape(-1, 6)
    shared = numbered.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        begin = {int(k): int(i) for i, k in reversed(list(enumerate(t[:, 0])))}
        size = np.bincount(t[:, 0]) if len(t) else []
        for b in batches:
            length, number = (b.column(c).to_numpy() for c in ("length", "number"))
            row = np.zeros(len(length), np.int64)
            for k in np.unique(length).tolist():
                own = length == k
                row[own] = begin[k] + np.searchsorted(t[begin[k] : begin[k] + size[k], 1], number[own], "right") - 1
            u = t[row]
            copy, place = np.divmod(number - u[:, 1], np.maximum(u[:, 2], 1))
            keep = [n for n in b.schema.names if n != "number"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), pa.array(u[:, 4] + copy), pa.array(u[:, 5] + place * length)], names=[*keep, "sequence_id", "offset"])

    return numbered.mapInArrow(run, PIECES + ", sequence_id long, offset long")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row.

    A null or empty text is one piece of the end id alone.  Rows of one doc_id, repeated ones
    too, are documents of their own, and so are rows without doc_id.  Other columns are not
    read.  The empty table gives the empty table.
    """
    rows = stored(pieces(docs, path, capacity, end))
    # At most `capacity` rows.
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    numbered = prefix_scan(rows, ["length"], ["doc_id", "piece", "start", "ids_crc32"], {"number": ("sum", F.lit(1).cast("long"))})
    return placed(numbered.withColumn("number", F.col("number") - 1).select("doc_id", "piece", "start", "length", "ids_crc32", "number"), plan(counts, capacity))


def op11_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), public_path("byte_bpe_50k.json"))
