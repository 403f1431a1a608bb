"""Arrow kernels over the bytes of sequences, for work that would explode every base into a row.

Each reads whole sequences in portions of bounded size and hands on distinct or summed rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of sequence that a kernel works on at once; a longer sequence is a portion of its own.
PORTION = 1 << 21
#: Grams of up to so many kinds are counted in a dense table.
DENSE = 1 << 16

_CODE = np.full(256, 4, np.int64)
_CODE[[65, 67, 71, 84]] = range(4)


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of a column of texts: null ones are empty."""
    text = column.cast(pa.large_binary()).fill_null(b"")
    _, bounds, data = text.buffers()
    bounds = np.frombuffer(bounds, np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), bounds


def portions(batches: Iterator[pa.RecordBatch], column: str = "seq") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, bounds): null sequences are empty."""
    for b in batches:
        data, bounds = _letters(b.column(b.schema.get_field_index(column)))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + PORTION, "right")) - 1)
            yield b.slice(at, to - at), data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
            at = to


def _starts(bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of all windows that lie wholly in a sequence, and their sequences."""
    n = np.maximum(np.diff(bounds) - width + 1, 0)
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + bounds[:-1][of], of


def _binary(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


#: Bits of a table that k-mers are looked up in before they leave a task.
SLOT_BITS = 25


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Codes of three bits; 7 is any other letter.
_PLAIN = np.full(256, 7, np.uint64)
_PLAIN[[65, 67, 71, 84, 78]] = range(5)


def _codes(data: np.ndarray, k: int) -> np.ndarray:
    """Three bits a letter of the window of k letters (at most 21) that begins at each place, by doubling."""
    power, size = _PLAIN[data], 1
    whole: np.ndarray | None = None
    done = 0
    while True:
        if k & size:
            if whole is None:
                whole = power
            else:
                n = min(len(whole), len(power) - done)
                whole = whole[:n] << np.uint64(3 * size) | power[done : done + n]
            done += size
        if 2 * size > k:
            return whole
        power = power[:-size] << np.uint64(3 * size) | power[size:]
        size *= 2


def _kmer_words(data: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """Words of eight bytes, the last one overlapping, that tell the windows apart."""
    words = []
    for first in dict.fromkeys([*range(0, max(k - 7, 1), 8), max(k - 8, 0)]):
        word = np.zeros(len(at), np.uint64)
        for j in range(first, min(first + 8, k)):
            word = word << np.uint64(8) | data[at + j]
        words.append(word)
    return words


def _slots(words: list[np.ndarray], codes: np.ndarray | None, plain: np.ndarray | bool) -> np.ndarray:
    """A k-mer's slot: by its code where it has one, whatever stands around it, else by its words."""
    h = np.zeros(len(words[0] if words else codes), np.uint64)
    for w in words:
        h = _mixed(h ^ w)
    if codes is not None:
        h = np.where(plain, _mixed(codes ^ np.uint64(0x9E3779B97F4A7C15)), h)
    return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def kmer_table(kmers: DataFrame) -> np.ndarray:
    """One bit for each slot of the k-mers (slot): 2 to the SLOT_BITS bits, whatever their number."""
    place = F.col("slot") + 1
    maps = kmers.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    table = np.zeros(1 << SLOT_BITS - 3, np.uint8)
    for r in maps.collect():
        bits = np.frombuffer(r["bits"], np.uint8)
        at = (r["bucket"] - 1) * len(bits)
        table[at : at + len(bits)] |= bits
    return table


def distinct_kmers(seqs: DataFrame, k: int, table: np.ndarray | None = None, slots: bool = False) -> DataFrame:
    """(id, n, kmer[, slot]) of seqs (id, seq): each k-mer of a sequence once, as bytes, beside their number.

    With a table (see kmer_table) only k-mers whose slot it holds leave the task, some of them
    by chance; n counts all of the sequence.
    """
    shared = seqs.sparkSession.sparkContext.broadcast(table) if table is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, bounds in portions(batches):
            at, of = _starts(bounds, k)
            if not len(at):
                continue
            coded = 3 * k <= 63 and len(data) >= k
            codes = _codes(data, k) if coded else None
            if coded and 3 * k + len(bounds).bit_length() <= 64 and not (_PLAIN[data] == 7).any():
                # All letters have a code: one key a window, and the k-mer can be read off it.
                key = np.sort(of.astype(np.uint64) << np.uint64(3 * k) | codes[at])
                key = key[np.concatenate([[True], key[1:] != key[:-1]])]
                of, code = (key >> np.uint64(3 * k)).astype(np.int64), key & np.uint64((1 << 3 * k) - 1)
                n = np.bincount(of, minlength=rows.num_rows)
                slot = _slots([], code, True) if slots or shared is not None else None
                if shared is not None:
                    hit = shared.value[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 > 0
                    of, code, slot = of[hit], code[hit], slot[hit]
                text = np.frombuffer(b"ACGTN", np.uint8)[(code[:, None] >> np.uint64(3) * np.arange(k, dtype=np.uint64)[::-1] & np.uint64(7)).astype(np.int64)]
            else:
                words = _kmer_words(data, at, k)
                order = np.lexsort((*words, of))
                new = np.zeros(len(at), bool)
                new[0] = True
                for key in (of, *words):
                    key = key[order]
                    new[1:] |= key[1:] != key[:-1]
                first = order[new]
                at, of, words = at[first], of[first], [w[first] for w in words]
                n = np.bincount(of, minlength=rows.num_rows)
                slot = None
                if slots or shared is not None:
                    plain = ~(_PLAIN[data[at[:, None] + np.arange(k)]] == 7).any(axis=1) if coded else False
                    slot = _slots(words, codes[at] if coded else None, plain)
                if shared is not None:
                    hit = shared.value[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 > 0
                    at, of, slot = at[hit], of[hit], slot[hit]
                text = data[at[:, None] + np.arange(k)]
            cols = [rows.column("id").take(pa.array(of)), pa.array(n[of]), _binary(text)]
            yield pa.RecordBatch.from_arrays([*cols, *([pa.array(slot)] if slots else [])], names=["id", "n", "kmer", *(["slot"] if slots else [])])

    fields = [T.StructField("id", seqs.schema["id"].dataType), T.StructField("n", T.LongType()), T.StructField("kmer", T.BinaryType())]
    return seqs.select("id", "seq").mapInArrow(run, T.StructType(fields + ([T.StructField("slot", T.LongType())] if slots else [])))


def gram_counts(seqs: DataFrame, width: int) -> DataFrame:
    """(gram, n): counts of `width` bases in a row, summed in each portion; grams with other letters are left out."""
    if not 1 <= width <= 31:
        raise ValueError("width: 1 to 31")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, bounds in portions(batches):
            at, _ = _starts(bounds, width)
            letters = _CODE[data]
            code, ok = np.zeros(len(at), np.int64), np.ones(len(at), bool)
            for j in range(width):
                here = letters[at + j]
                ok &= here < 4
                code = code << 2 | here & 3
            code = code[ok]
            if 4**width <= DENSE:
                n = np.bincount(code, minlength=4**width)
                code = np.flatnonzero(n)
                n = n[code]
            else:
                code, n = np.unique(code, return_counts=True)
            text = np.frombuffer(b"ACGT", np.uint8)[code[:, None] >> 2 * np.arange(width)[::-1] & 3]
            yield pa.RecordBatch.from_arrays([_binary(text.reshape(-1, width)).cast(pa.string()), pa.array(n)], names=["gram", "n"])

    return seqs.select("seq").mapInArrow(run, "gram string, n long")


def position_counts(aligned: DataFrame) -> DataFrame:
    """(motif_id, pos, A, C, G, T) of aligned (motif_id, seq), summed in each portion."""
    names = ["motif_id", "pos", *"ACGT"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, bounds in portions(batches):
            motif = rows.column("motif_id").dictionary_encode("encode")
            of = np.repeat(np.arange(rows.num_rows), np.diff(bounds))
            if not len(of):
                continue
            pos = np.arange(len(of)) - bounds[:-1][of]
            width = int(pos.max()) + 1
            cell = motif.indices.to_numpy()[of] * width + pos
            counts = [np.bincount(cell[data == ord(x)], minlength=len(motif.dictionary) * width) for x in "ACGT"]
            some = np.unique(cell)
            cols = [motif.dictionary.take(pa.array(some // width)), pa.array((some % width).astype(np.int32)), *(pa.array(c[some]) for c in counts)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    fields = [T.StructField("motif_id", aligned.schema["motif_id"].dataType), T.StructField("pos", T.IntegerType()), *(T.StructField(x, T.LongType()) for x in "ACGT")]
    return aligned.select("motif_id", "seq").mapInArrow(run, T.StructType(fields))


def hidden_tiles(seqs: DataFrame, columns: list[str], tile: int) -> DataFrame:
    """(id, size, t, bits0, before0, ...): for each `tile` bases of seqs (id, seq, ...) and each column, which of them
    are N, 64 to a word from the lowest bit on, and how many N the sequence holds before each word.

    An empty sequence has no row.  What a column has beyond the end of seq is left out.
    """
    width = -(-tile // 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, bounds in portions(batches):
            size = np.diff(bounds)
            n = -(-size // tile)
            first = np.cumsum(n) - n
            of = np.repeat(np.arange(len(n)), n)
            if not len(of):
                continue
            t = np.arange(len(of)) - first[of]
            words = -(-np.minimum(size[of] - t * tile, tile) // 64)
            ends = np.concatenate([[0], np.cumsum(words)])
            used = np.arange(width) < words[:, None]
            cols = [rows.column("id").take(pa.array(of)), pa.array(size[of]), pa.array(t)]
            for c in columns:
                data, at = _letters(rows.column(c))
                data, at = data[at[0] : at[-1]], at - at[0]
                hidden = (data | 32) == ord("n")
                # Each sequence begins with a tile of its own.
                laid = np.zeros(len(of) * tile, bool)
                if len(size) == 1:
                    laid[: min(len(hidden), size[0])] = hidden[: size[0]]
                else:
                    place = np.flatnonzero(hidden)
                    row = np.searchsorted(at, place, "right") - 1
                    place = place - at[row]
                    inside = place < size[row]
                    laid[(first[row] * tile + place)[inside]] = True
                laid = laid.reshape(-1, tile)
                if tile % 64:
                    laid = np.pad(laid, ((0, 0), (0, width * 64 - tile)))
                bits = np.packbits(laid, axis=1, bitorder="little").view("<u8")[used]
                count = np.cumsum(np.bitwise_count(bits), dtype=np.int64)
                before = np.concatenate([[0], count])
                before = before[:-1] - np.repeat(before[ends[first[of]]], words)
                lists = lambda x: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x))
                cols += [lists(bits.view(np.int64)), lists(before.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    fields = [T.StructField("id", seqs.schema["id"].dataType), T.StructField("size", T.LongType()), T.StructField("t", T.LongType())]
    for i in range(len(columns)):
        fields += [T.StructField(f"bits{i}", T.ArrayType(T.LongType())), T.StructField(f"before{i}", T.ArrayType(T.IntegerType()))]
    return seqs.select("id", *dict.fromkeys(["seq", *columns])).mapInArrow(run, T.StructType(fields))


def motif_scores(seqs: DataFrame, motifs: list[tuple[object, np.ndarray]], motif_type: T.DataType, least: float | None) -> DataFrame:
    """(id, motif_id, site, strand, score) of every window, or of those that score `least`.

    motifs: names, and log-odds by position and base (A, C, G, T); other letters add 0.
    """
    tables = [(name, np.hstack([odds, np.zeros((len(odds), 1))])) for name, odds in motifs]
    names = ["id", "motif_id", "site", "strand", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, bounds in portions(batches):
            code = _CODE[data]
            turned = np.where(code < 4, 3 - code, 4)
            for name, odds in tables:
                width = len(odds)
                at, of = _starts(bounds, width)
                for strand, letters, table in (("+", code, odds), ("-", turned, odds[::-1])):
                    score = np.zeros(len(at))
                    # Sums run from the motif's first position on, as the strand reads it.
                    for j in range(width) if strand == "+" else reversed(range(width)):
                        score += table[j][letters[at + j]]
                    keep = np.flatnonzero(score >= least) if least is not None else np.arange(len(at))
                    if not len(keep):
                        continue
                    doc = of[keep]
                    cols = [rows.column("id").take(pa.array(doc)), pa.array([name] * len(keep)), pa.array((at[keep] - bounds[doc]).astype(np.int32)), pa.array([strand] * len(keep)), pa.array(score[keep])]
                    yield pa.RecordBatch.from_arrays(cols, names=names)

    fields = [T.StructField("id", seqs.schema["id"].dataType), T.StructField("motif_id", motif_type), T.StructField("site", T.IntegerType()), T.StructField("strand", T.StringType()), T.StructField("score", T.DoubleType())]
    return seqs.select("id", "seq").mapInArrow(run, T.StructType(fields))
