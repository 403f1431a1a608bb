"""LM scoring by a weighted backoff automaton over n-grams of 1 to 3 words.

The model is that of all training texts, all their tokens and all their n-grams, those seen once
too; nothing bounds it.  With n() the training counts and MASS a constant,

    p(c) = (n(c) + 1) / (N + V + 1)
    p(c | b) = (n(bc) + MASS p(c)) / (n(b) + MASS)
    p(c | ab) = (n(abc) + MASS p(c | b)) / (n(ab) + MASS)

so every history's probabilities sum to one.  A history that was seen is a state; an n-gram that
was seen is an arc with its log-probability; a state's failure arc costs log MASS / (n + MASS)
and leads to the next shorter history; at the root every word has its smoothed probability.

The automaton of a whole corpus fits no task, but that part of it which a block of texts can
reach does, and needs its n-grams' counts only:
1. Texts are packed into blocks of about BLOCK bytes, written once to the shared folder.
2. Each block asks for its distinct n-grams: their hashes, sorted and delta-coded, with the
   block's own training counts, dealt by ranges of the hash.  A block names an n-gram once, so
   no frequent word, pair or passage makes a hot range.
3. A range sums the counts of all blocks and answers every block in the order of its question.
4. A block meets its answers, builds its part of the automaton and reads its texts left to right.

Blocks and ranges have bounded sizes; their numbers grow with the input.  N-grams are named by
hashes of log2(bytes) + SPARE bits, so that an n-gram shares its name with another with a chance
of at most 2**-SPARE at any size of the input.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regseq.llm import textbytes as tb
from regseq.llm.common import fold, out_schema, small_batches, stored

MASS = 8.0
LANE = 256
#: Bytes of text of a block (a longer text is a block of its own) and, about, of a range.
BLOCK = 4 << 20
RANGE = 8 << 20
SPARE = 20
#: The token that ends each text; it also stands before the first word as its history.
END = tb.mix(np.array([0xE0D], np.uint64))[0]
CODEC = pa.Codec("zstd", compression_level=3)


class Grams(NamedTuple):
    """The n-grams of some texts: names ascending (the last bit tells words), and each token's place among them."""

    names: np.ndarray
    word: np.ndarray
    pair: np.ndarray  # of the token and that before it, which is END before a text
    triple: np.ndarray  # the pair's place for the first token of a text
    end: int  # place of END
    first: np.ndarray  # bounds of the texts


class Automaton(NamedTuple):
    seen: np.ndarray  # of each n-gram: whether it is an arc, and, of 1 or 2 words, a state
    logs: np.ndarray
    fail: np.ndarray


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words and its end, and the texts' bounds."""
    starts, ends = tb.spans(data, offsets, tb.NOT_SPACE)
    first = np.searchsorted(starts, offsets)
    n = len(offsets) - 1
    out = np.full(len(starts) + n, END, np.uint64)
    out[np.arange(len(starts)) + tb.doc_of(first)] = tb.word_hashes(data, starts, ends)
    return out, first + np.arange(n + 1)


def grams(h: np.ndarray, first: np.ndarray, bits: int) -> Grams:
    """The n-grams of texts of the tokens h, named by `bits` bits."""
    before = np.full(len(h), END, np.uint64)
    before[1:] = h[:-1]
    before[first[:-1]] = END
    pair = tb.mix(before * np.uint64(tb.BASE) + h)
    triple = pair.copy()
    triple[1:] = tb.mix(pair[:-1] * np.uint64(tb.BASE) + tb.mix(pair[1:]))
    triple[first[:-1]] = pair[first[:-1]]
    cut, one = np.uint64(65 - bits), np.uint64(1)
    name = np.concatenate([h, pair, triple])
    del pair, triple, before
    name >>= cut
    name <<= one
    name[: len(h)] |= one
    names, place = np.unique(name, return_inverse=True)
    word, pair, triple = place.astype(np.int32).reshape(3, -1)
    return Grams(names, word, pair, triple, int(np.searchsorted(names, END >> cut << one | one)), first)


def own_counts(g: Grams, train: np.ndarray) -> np.ndarray:
    """How often each n-gram is in those of the texts that `train` holds."""
    on = np.repeat(train, np.diff(g.first))
    n = np.bincount(g.word[on], minlength=len(g.names)) + np.bincount(g.pair[on], minlength=len(g.names))
    on[g.first[:-1]] = False
    return n + np.bincount(g.triple[on], minlength=len(g.names))


def build(g: Grams, n: np.ndarray, space: int, mass: float = MASS) -> Automaton:
    """n: the n-grams' training counts.  space: N + V + 1.  Logarithms are to base 10."""
    p = np.empty(len(n))
    p[g.word] = (n[g.word] + 1) / space
    before = np.full(len(g.word), g.end)
    before[1:] = g.word[:-1]
    before[g.first[:-1]] = g.end
    p[g.pair] = (n[g.pair] + mass * p[g.word]) / (n[before] + mass)
    inner = np.ones(len(g.word), bool)
    inner[g.first[:-1]] = False
    at = np.flatnonzero(inner)
    p[g.triple[at]] = (n[g.triple[at]] + mass * p[g.pair[at]]) / (n[g.pair[at - 1]] + mass)
    return Automaton(n > 0, np.log10(p), np.log10(mass / (n + mass)))


def walk(a: Automaton, g: Grams) -> np.ndarray:
    """Weight of each token.  Lanes of LANE tokens are read left to right, each carrying its state; a lane inside a
    text starts two tokens before, which makes its state whole."""
    n = np.diff(g.first)
    lanes = -(-n // LANE)
    doc = np.repeat(np.arange(len(n)), lanes)
    part = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    begin = g.first[:-1][doc] + part * LANE
    warm = np.where(part > 0, 2, 0)
    length = np.minimum(begin + LANE, g.first[1:][doc]) - begin + warm
    order = np.argsort(-length, kind="stable")
    begin, warm, length = (begin - warm)[order], warm[order], length[order]
    # A state is the place of its history, -1 for the root; `words` is how many words it has.
    words = np.where((warm == 0) & a.seen[g.end], 1, 0)
    state = np.where(words > 0, g.end, -1)
    out = np.zeros(len(g.word))
    for step in range(int(length[0]) if len(length) else 0):
        live = int(np.searchsorted(-length, -step, "left"))
        here, s, w = begin[:live] + step, state[:live], words[:live]
        weight = np.zeros(live)
        arc = g.triple[here]
        hit = (w == 2) & a.seen[arc]
        weight[hit] = a.logs[arc[hit]]
        down = np.flatnonzero((w == 2) & ~hit)
        weight[down] = a.fail[s[down]]
        s[down], w[down] = g.word[here[down] - 1], 1
        pair = g.pair[here]
        met = (w == 1) & a.seen[pair]
        rows = np.flatnonzero(met)
        weight[rows] += a.logs[pair[rows]]
        down = np.flatnonzero((w == 1) & ~met)
        weight[down] += a.fail[s[down]]
        root = np.flatnonzero(~hit & ~met)
        weight[root] += a.logs[g.word[here[root]]]
        s[:], w[:] = pair, 2
        known = a.seen[g.word[here[root]]]
        s[root], w[root] = np.where(known, g.word[here[root]], -1), np.where(known, 1, 0)
        count = warm[:live] <= step
        out[here[count]] = weight[count]
    return out


def _packed(*columns: np.ndarray) -> bytes:
    """Numbers as planes of their bytes, those of most zeros last, compressed."""
    planes = b"".join(c.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns)
    return CODEC.compress(planes, asbytes=True)


def _unpacked(data: bytes, n: int, columns: int) -> list[np.ndarray]:
    planes = np.frombuffer(CODEC.decompress(data, n * 8 * columns, asbytes=True), np.uint8).reshape(columns, 8, n)
    return [np.ascontiguousarray(c.T).view(np.uint64).reshape(-1) for c in planes]


def _message(batch: pa.RecordBatch) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=CODEC)) as out:
        out.write_batch(batch)
    return sink.getvalue()


def _batch(message: bytes) -> pa.RecordBatch:
    return next(iter(pa.ipc.open_stream(message)))


def _blocks(docs: DataFrame, wanted: bool) -> DataFrame:
    """(block, wanted, size, payload): docs in blocks; those of a corpus that is not scored have numbers below 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for i, s in enumerate(tb.slices(batches, most=BLOCK)):
            block = task + i if wanted else -1 - task - i
            yield pa.RecordBatch.from_pydict({"block": [block], "wanted": [wanted], "size": [len(s.data)], "payload": [_message(s.batch)]})

    return docs.mapInArrow(run, "block long, wanted boolean, size long, payload binary")


def _asked(blocks: DataFrame, bits: int, lead: int) -> DataFrame:
    """(range, block, wanted, n, payload): each block's n-grams and own counts, by the first `lead` bits of the names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.arange(1, 1 << lead, dtype=np.uint64) << np.uint64(bits - lead)
        for batch in batches:
            for block, wanted, payload in zip(*(batch.column(c) for c in ("block", "wanted", "payload")), strict=True):
                docs, wanted = _batch(payload.as_py()), wanted.as_py()
                g = grams(*tokens(*tb.text_bytes(docs.column("text"))), bits)
                n = own_counts(g, docs.column("__train").to_numpy(zero_copy_only=False))
                names = g.names
                if not wanted:
                    names, n = names[n > 0], n[n > 0]
                bounds = np.concatenate([[0], np.searchsorted(names, edges), [len(names)]])
                part = np.flatnonzero(np.diff(bounds))
                data = [_packed(np.diff(names[bounds[i] : bounds[i + 1]], prepend=np.uint64(0)), n[bounds[i] : bounds[i + 1]]) for i in part.tolist()]
                k = len(part)
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array([block.as_py()] * k, pa.int64()), pa.array([wanted] * k, pa.bool_()), pa.array(np.diff(bounds)[part].astype(np.int32)), pa.array(data, pa.binary())], names=["range", "block", "wanted", "n", "payload"])
        tb.give_back()

    return blocks.select("block", "wanted", "payload").mapInArrow(run, "range int, block long, wanted boolean, n int, payload binary")


def _answers(asked: DataFrame, ranges: int) -> DataFrame:
    """(block, range, n, payload, tokens, types): counts over all blocks, in the order of the questions; a row without
    block has the range's share of N and V."""

    def answer(r: int, rows: list[tuple]) -> Iterator[dict]:
        parts = [_unpacked(payload, n, 2) for _, _, n, payload in rows]
        names, place = np.unique(np.concatenate([np.cumsum(d) for d, _ in parts]), return_inverse=True)
        total = np.bincount(place, np.concatenate([n for _, n in parts]), len(names)).astype(np.int64)
        word = total[(names & np.uint64(1)) > 0]
        yield {"block": None, "range": r, "n": 0, "payload": None, "tokens": int(word.sum()), "types": int((word > 0).sum())}
        at = 0
        for block, wanted, n, _ in rows:
            if wanted:
                yield {"block": block, "range": r, "n": n, "payload": _packed(total[place[at : at + n]]), "tokens": 0, "types": 0}
            at += n

    schema = pa.schema([("block", pa.int64()), ("range", pa.int32()), ("n", pa.int32()), ("payload", pa.binary()), ("tokens", pa.int64()), ("types", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = -1
        for batch in batches:
            for r, *row in zip(*(batch.column(c) for c in ("range", "block", "wanted", "n", "payload")), strict=True):
                if r.as_py() != last and held:
                    yield pa.RecordBatch.from_pylist(list(answer(last, held)), schema)
                    held = []
                last = r.as_py()
                held.append(tuple(x.as_py() for x in row))
        if held:
            yield pa.RecordBatch.from_pylist(list(answer(last, held)), schema)
        tb.give_back()

    dealt = asked.repartitionById(ranges, F.col("range")).sortWithinPartitions("range", "block")
    return dealt.mapInArrow(run, "block long, range int, n int, payload binary, tokens long, types long")


_COLUMNS = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())]


def score(docs: DataFrame, training: Column, corpus: DataFrame | None = None, mass: float = MASS) -> DataFrame:
    """docs without text, with n_tokens, n_known, train_tokens, base_score and score (log10 of the model's probability).

    The model learns from those rows of docs where `training` is true, and from all texts of `corpus`, if given.
    A null or empty text is its end alone.  Rows keep their number, repeated rows get equal scores; columns with the
    results' names are replaced.  An empty table gives an empty one.  Without any training text N and V are 0.
    """
    small_batches(docs.sparkSession)
    base = docs.drop(*(k for k, _ in _COLUMNS))
    rest = base.drop("text")
    blocks = _blocks(base.withColumn("__train", F.coalesce(training, F.lit(False))), True)
    if corpus is not None:
        blocks = blocks.union(_blocks(corpus.select("text", F.lit(True).alias("__train")), False))
    blocks = stored(blocks)
    size, n_blocks = blocks.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    bits = min(64, int(size).bit_length() + SPARE + 1)
    lead = int(size // RANGE).bit_length()
    answers = stored(_answers(_asked(blocks, bits, lead), 1 << lead))
    n_tokens, n_types = answers.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    space = int(n_tokens + n_types + 1)
    schema = out_schema(rest, _COLUMNS)

    def read(message: bytes, parts: list[bytes], sizes: list[int]) -> pa.RecordBatch:
        batch = _batch(message)
        g = grams(*tokens(*tb.text_bytes(batch.column("text"))), bits)
        n = np.concatenate([_unpacked(p, k, 1)[0] for p, k in zip(parts, sizes, strict=True)]).astype(np.int64)
        first, count = g.first[:-1], n[g.word]
        results = {
            "n_tokens": np.diff(g.first), "n_known": np.add.reduceat((count > 0).astype(np.int64), first), "train_tokens": np.full(len(first), n_tokens, np.int64),
            "base_score": np.add.reduceat(np.log10((count + 1) / space), first), "score": np.add.reduceat(walk(build(g, n, space, mass), g), first),
        }
        return tb.with_columns(batch, results).select(schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        message, parts, sizes = None, [], []
        for batch in batches:
            for r, n, payload in zip(*(batch.column(c).to_pylist() for c in ("range", "n", "payload")), strict=True):
                if r >= 0:
                    parts.append(payload)
                    sizes.append(n)
                    continue
                if message is not None:
                    yield read(message, parts, sizes)
                message, parts, sizes = payload, [], []
        if message is not None:
            yield read(message, parts, sizes)
        tb.give_back()

    whole = blocks.filter("wanted").select("block", F.lit(-1).alias("range"), F.lit(0).alias("n"), "payload")
    met = whole.union(answers.filter("block is not null").select("block", "range", "n", "payload"))
    return met.repartition(max(1, int(n_blocks)), "block").sortWithinPartitions("block", "range").mapInArrow(run, schema)


def op4_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs.select("doc_id", (fold(7) == 2).alias("held_out"), "text"), fold(7) != 2)
