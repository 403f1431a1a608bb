"""BPE encoding and decoding by a trie of distinct words.

A task takes the distinct words of a slice of texts, sorts them, and walks the trie that
their sorted order spells out depth first: the stack holds, for each prefix on the path, the
last token of the prefix's encoding.  A word goes back to the prefix it shares with the one
before and only the rest is computed, so every shared prefix is encoded once.  The state of
one more character is the only token that ends there and stands rightly behind the last
token of what is before it: two tokens stand rightly if merging their joint text gives just
the two.  The words' encodings are then laid out over the texts by index.

The tokenizer is a public vocabulary file (path is a parameter) read here: normalisation to
NFC, lower case, white space dropped, words split by the file's pattern, bytes as printable
characters, and "</w>" at the end of words.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from regseq.llm import textbytes as tb
from regseq.llm.common import out_schema, small_batches

#: Words that a task remembers; it forgets all beyond that.
REMEMBER = 1 << 20
#: Pairs of tokens of which it remembers whether they may stand side by side.
REMEMBER_PAIRS = 200_000
#: Bytes up to which a word is named by a hash.
HASHED = 256
#: Bytes of text, new words and tokens that are worked on at once: what a task holds besides its model and memory.
SLICE, WORDS, PORTION = 1 << 18, 1 << 14, 1 << 15

_COLUMNS = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]


def _printable() -> list[str]:
    """The character that stands for each byte: itself if it is printable, else the next free one from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    return [chr(b if b in shown else next(free)) for b in range(256)]


class WordBpe:
    """The tokenizer of a vocabulary file, with what it has worked out so far."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {(self.vocab[a], self.vocab[b]): (k, self.vocab[a + b]) for k, (a, b) in enumerate(merges)}
        self.token = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token |= {i: t for t, i in self.special.items()}
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"].replace("\\s", "\\p{White_Space}"))
        #: The same on printable ASCII without white space.
        self.ascii = re.compile(split["pattern"]["Regex"].replace("\\p{L}", "a-z").replace("\\p{N}", "0-9"))
        self.bytes = dict(enumerate(_printable()))
        #: Each ending of a token, with the token that it is, or -1.
        self.endings: dict[str, int] = {}
        for text in self.vocab:
            core, tail = (text[: -len(self.end)], self.end) if text.endswith(self.end) and text != self.end else (text, "")
            for i in range(len(core)):
                self.endings.setdefault(core[i:] + tail, -1)
            self.endings[text] = self.vocab[text]
        self.fits: dict[tuple[int, int], bool] = {}

    def symbols(self, token: int) -> list[int]:
        """A token's characters, as tokens."""
        text = self.token[token]
        tail = [self.vocab[text[-len(self.end) - 1 :]]] if text.endswith(self.end) and len(text) > len(self.end) else []
        return [self.vocab[c] for c in (text[: -len(self.end) - 1] if tail else text)] + tail

    def merged(self, parts: list[int]) -> list[int]:
        """Plain merging: again and again the leftmost pair of the least rank."""
        rank = self.rank.get
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                r = rank((parts[i], parts[i + 1]))
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [best[1]]
        return parts

    def stands(self, left: int, right: int) -> bool:
        """Does right stand rightly behind left; with a left of -1, at the beginning."""
        if len(self.fits) >= REMEMBER_PAIRS:
            self.fits.clear()
        if left < 0:
            ok = self.merged(self.symbols(right)) == [right]
        else:
            ok = (left, right) not in self.rank and self.merged(self.symbols(left) + self.symbols(right)) == [left, right]
        self.fits[left, right] = ok
        return ok

    def last(self, text: str, n: int, path: list[tuple[int, int]], end: str) -> tuple[int, int]:
        """(last token, where it begins) of the encoding of text[:n]; path has those of its proper prefixes, by length."""
        ending, fits = self.endings.get, self.fits.get
        begin = n
        while begin:
            begin -= 1
            token = ending(text[begin:n] + end if end else text[begin:n])
            if token is None:
                break
            if token >= 0:
                left = path[begin][0]
                ok = fits((left, token))
                if self.stands(left, token) if ok is None else ok:
                    return token, begin
        raise ValueError(f"no token ends {text[:n]!r}")

    def encode_sorted(self, texts: list[str]) -> Iterator[list[int]]:
        """Encodings of distinct ascending words (of printable characters), depth first through their trie."""
        path: list[tuple[int, int]] = [(-1, 0)]
        before = ""
        last, end = self.last, self.end
        for text in texts:
            # The path goes back to the prefix that both words have.
            shared = _common(before, text, min(len(path) - 1, len(text) - 1))
            del path[shared + 1 :]
            for n in range(shared + 1, len(text)):
                path.append(last(text, n, path, ""))
            token, begin = last(text, len(text), path, end)
            out = [token]
            while begin:
                token, begin = path[begin]
                out.append(token)
            out.reverse()
            yield out
            before = text

    def pieces(self, word: str) -> list[str | int]:
        """A raw word, without ASCII white space, as special tokens' ids and printable words."""
        parts = self.cut_special.split(word) if self.cut_special and "<" in word else [word]
        out: list[str | int] = []
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
                continue
            if part.isascii():
                part = part.lower()
                if part.isprintable():
                    out += self.ascii.findall(part)
                    continue
            else:
                if not unicodedata.is_normalized("NFC", part):
                    part = unicodedata.normalize("NFC", part)
                # Lower case character by character: a sigma does not look at what follows.
                part = part.replace("Σ", "σ").lower()
            out += [found.encode().decode("latin-1").translate(self.bytes) for found in self.pattern.findall(part)]
        return out

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """The token ids of raw words."""
        if not words:
            return []
        split = [[w.lower()] if w.isascii() and w.isalpha() else self.pieces(w) for w in b"\n".join(words).decode().split("\n")]
        texts = sorted({p for ps in split for p in ps if isinstance(p, str)})
        ids = dict(zip(texts, self.encode_sorted(texts), strict=True))
        return [ids[ps[0]] if len(ps) == 1 and isinstance(ps[0], str) else [i for p in ps for i in (ids[p] if isinstance(p, str) else (p,))] for ps in split]


def _common(a: str, b: str, most: int) -> int:
    """How many characters a and b begin with in common, at most `most`."""
    if a[:most] == b[:most]:
        return most
    low, high = 0, most - 1
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


class Known:
    """Encodings that a task has worked out, as flat arrays: hashes ascending, and where each word's ids are."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.keys, self.begin, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.int32)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Where the keys are, -1 for those that are not known."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def add(self, keys: np.ndarray, portions: Iterable[list[list[int]]]) -> None:
        """Takes the keys' encodings, a portion of words at a time."""
        flat, sizes = [self.ids], []
        for ids in portions:
            sizes.append(np.array([len(x) for x in ids], np.int32))
            flat.append(np.fromiter((i for x in ids for i in x), np.int32, int(sizes[-1].sum())))
        size = np.concatenate(sizes)
        begin = len(self.ids) + np.cumsum(size, dtype=np.int64) - size
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")
        self.ids = np.concatenate(flat)
        self.keys, self.begin, self.size = keys[order], np.concatenate([self.begin, begin])[order], np.concatenate([self.size, size])[order]


def _ranges(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The indices begin[i] to begin[i] + size[i] - 1 of all i, end to end, and the bounds."""
    bounds = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    return np.repeat(begin - bounds[:-1], size) + np.arange(bounds[-1]), bounds


def _encoded(s: tb.Slice, bpe: WordBpe, known: Known) -> tuple[np.ndarray, np.ndarray]:
    """The token ids of a slice's texts end to end, and each text's bounds."""
    starts, ends = tb.spans(s.data, s.offsets, tb.NOT_SPACE)
    hashes = tb.word_hashes(s.data, starts, ends, tb.BYTE)
    # Hashes name words of bounded length only; a longer one is a word of its own wherever it stands.
    long = np.flatnonzero(ends - starts > HASHED)
    hashes[long] = np.arange(len(long), dtype=np.uint64)
    if len(known.keys) > REMEMBER:
        known.clear()
    keys, at, word = np.unique(hashes, return_index=True, return_inverse=True)
    new = np.flatnonzero(known.places(keys) < 0)
    raw = s.data.tobytes()
    if len(new):
        parts = (at[new[i : i + WORDS]] for i in range(0, len(new), WORDS))
        known.add(keys[new], (bpe.encode_words([raw[a:b] for a, b in zip(starts[p].tolist(), ends[p].tolist(), strict=True)]) for p in parts))
    place = known.places(keys)[word.reshape(-1)]
    flat, bounds = _ranges(known.begin[place], known.size[place])
    ids, first = known.ids[flat], bounds[np.searchsorted(starts, s.offsets)]
    if len(long):
        known.clear()
    return ids, first


class Spelling:
    """The bytes of all tokens, each followed by a space, in one array; and so their ids in decimal."""

    def __init__(self, bpe: WordBpe) -> None:
        top = max(bpe.token) + 1
        self.tokens = self._table([(bpe.token[i] + " ").encode() if i in bpe.token else b"" for i in range(top)])
        self.ids = self._table([f"{i} ".encode() for i in range(top)])

    @staticmethod
    def _table(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = np.array([len(p) for p in parts], np.int64)
        return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, size


def _joined(table: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray, first: np.ndarray) -> Iterator[bytes]:
    """Each text's tokens as the table spells them, without the last space."""
    data, begin, size = table
    row = 0
    while row < len(first) - 1:
        # A portion of texts at a time keeps the indices small.
        to = max(row + 1, int(np.searchsorted(first, first[row] + PORTION, "right")) - 1)
        part = ids[first[row] : first[to]]
        flat, bounds = _ranges(begin[part], size[part])
        text = data[flat].tobytes()
        cuts = bounds[first[row : to + 1] - first[row]].tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield text[a : max(a, b - 1)]
        row = to


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs with `ids`, the token ids of each whole text, and `decoded`, the text they decode to."""
    return _run(docs, path, [("ids", T.ArrayType(T.IntegerType())), ("decoded", T.StringType())])


def digests(docs: DataFrame, path: str) -> DataFrame:
    """docs with the number of tokens and SHA-256 of the ids and of the decoded text.

    Null texts are empty: no tokens, and digests of the empty string.  Rows keep their number;
    columns with the results' names are replaced.
    """
    return _run(docs, path, _COLUMNS)


def decode(ids: list[int], bpe: WordBpe) -> str:
    """The file names no decoder: tokens as they are, joined by a space."""
    return " ".join(bpe.token[i] for i in ids)


def _run(docs: DataFrame, path: str, columns: list) -> DataFrame:
    small_batches(docs.sparkSession)
    with open(path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = out_schema(docs, columns)
    names = [k for k, _ in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The model lives as long as the task: workers that wait for others hold nothing.
        bpe, known = WordBpe(json.loads(spec.value)), Known()
        spelling = Spelling(bpe)
        for s in tb.slices(batches, most=SLICE):
            ids, first = _encoded(s, bpe, known)
            more: dict[str, object] = {"n_tokens": np.diff(first)}
            if "ids" in names:
                more["ids"] = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids))
                more["decoded"] = pa.array([d.decode() for d in _joined(spelling.tokens, ids, first)], pa.string())
            else:
                more |= {k: pa.array([hashlib.sha256(x).hexdigest() for x in _joined(v, ids, first)], pa.string()) for k, v in (("ids_sha256", spelling.ids), ("decoded_sha256", spelling.tokens))}
            yield tb.with_columns(s.batch, more).select(schema.names)
        del bpe, known, spelling
        tb.give_back()

    return docs.mapInArrow(run, schema)


def public_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizer file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(docs, public_path()).drop("text")
