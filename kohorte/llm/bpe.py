"""BPE encoding by a pair occurrence index, and decoding.

The distinct pieces of an Arrow batch are laid out as one array of symbols. An index maps each mergeable pair to
all its positions there; the pairs are applied in ascending rank, each at all its positions at once, and the
positions of the pairs that a merge creates are added to the index. Pieces met before keep their ids in a
bounded table of the worker.

Texts: null counts as empty; an empty text has no ids; special tokens inside a text become their own id, as the
tokenizers library has it. Input columns beside the id and the text are not carried along.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohorte.llm.textops import give_back, released, slices, text_batch

# The piece pattern and the byte alphabet of byte-level BPE.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]

REMEMBERED = 250_000    # pieces a worker keeps
POOL = 6 << 20         # bytes of text whose new pieces are merged together
INDEXED = 1 << 17       # pairs put into the index at a time, each with several numbers of 8 bytes


def byte_of_char() -> dict[str, int]:
    """Character that stands for a byte in the vocabulary file -> byte."""
    rest = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tables of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model, chars = content["model"], byte_of_char()
        if model["type"] != "BPE" or content["pre_tokenizer"]["type"] != "ByteLevel" or content["normalizer"]:
            raise ValueError("a byte-level BPE vocabulary without normalizer is expected")
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.bytes = {i: bytes(chars[c] for c in token) for token, i in vocab.items()}
        self.bytes |= {i: token.encode() for token, i in self.special.items()}
        self.base = np.zeros(256, np.int64)
        for c, b in chars.items():
            self.base[b] = vocab[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = [vocab[a + b] for a, b in pairs]
        if len(set(made)) != len(made):
            raise ValueError("two merges make the same token: ascending ranks would not follow the file")
        self.width = max(self.bytes) + 1
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array(made, np.int64)
        keys = self.left * self.width + self.right
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        names = [regex.escape(t) for t in sorted(self.special, key=len, reverse=True)]
        self.split = regex.compile("(" + "|".join(names) + ")") if names else None
        self.pieces = regex.compile(PIECES)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it can't be merged."""
        keys = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], -1)


class PairIndex:
    """Rank of a pair -> positions of its left symbol."""

    def __init__(self):
        self.positions: dict[int, list[np.ndarray]] = {}
        self.ranks: list[int] = []

    def add(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        known = ranks >= 0
        if not known.any():
            return
        ranks, positions = ranks[known], positions[known]
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
        for lo, hi in zip(cuts, cuts[1:]):
            rank = int(ranks[lo])
            if rank not in self.positions:
                self.positions[rank] = []
                heapq.heappush(self.ranks, rank)
            self.positions[rank].append(positions[lo:hi])

    def pop(self) -> tuple[int, np.ndarray]:
        rank = heapq.heappop(self.ranks)
        found = self.positions.pop(rank)
        return rank, found[0] if len(found) == 1 else np.concatenate(found)


def alternate(positions: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Of a pair of equal symbols, every other position of an unbroken run, from its left end."""
    positions = np.unique(positions)
    breaks = np.ones(len(positions), bool)
    breaks[1:] = following[positions[:-1]] != positions[1:]
    run = np.maximum.accumulate(np.where(breaks, np.arange(len(positions)), 0))
    return positions[(np.arange(len(positions)) - run) % 2 == 0]


def merge_pool(pieces: list[bytes], vocabulary: Vocabulary) -> list[bytes]:
    """Ids of each (non-empty) piece as little-endian unsigned 32-bit integers."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    ends = np.cumsum(sizes)
    n = int(ends[-1])
    symbol = vocabulary.base[np.frombuffer(b"".join(pieces), np.uint8)].astype(np.int32)
    following = np.arange(1, n + 1, dtype=np.int32)
    following[ends - 1] = -1
    preceding = np.arange(-1, n - 1, dtype=np.int32)
    preceding[ends - sizes] = -1
    index, inner = PairIndex(), np.flatnonzero(following >= 0).astype(np.int32)
    for lo in range(0, len(inner), INDEXED):
        some = inner[lo:lo + INDEXED]
        index.add(vocabulary.rank(symbol[some], symbol[some + 1]), some)
    while index.ranks:
        rank, at = index.pop()
        left, right = vocabulary.left[rank], vocabulary.right[rank]
        at = at[symbol[at] == left]
        after = following[at]
        fits = (after >= 0) & (symbol[after] == right)
        at = at[fits]
        if left == right:
            at = alternate(at, following)
        if not len(at):
            continue
        after = following[at]
        beyond = following[after]
        symbol[at] = vocabulary.made[rank]
        symbol[after] = -1
        following[at] = beyond
        inside = beyond >= 0
        preceding[beyond[inside]] = at[inside]
        before = preceding[at]
        led = before >= 0
        index.add(vocabulary.rank(symbol[before[led]], symbol[at[led]]), before[led])
        index.add(vocabulary.rank(symbol[at[inside]], symbol[beyond[inside]]), at[inside])
    alive = symbol >= 0
    packed = symbol[alive].astype("<u4").tobytes()
    upto = (4 * np.cumsum(alive)[ends - 1]).tolist()
    return [packed[a:b] for a, b in zip([0, *upto], upto)]


class Encoder:
    """Encodes lists of texts; keeps the ids of at most ``REMEMBERED`` pieces between calls."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.known: dict[str, bytes] = {}
        self.uneven = regex.compile(r" (?=\s)|(?<=\s) ")

    def _parts(self, text: str) -> list[str]:
        """Consecutive parts of ``text`` none of which a piece crosses.

        A single space between two non-space characters always begins a piece.
        """
        if self.uneven.search(text):
            return self.vocabulary.pieces.findall(text)
        first, *rest = text.split(" ")
        return ([first] if first else []) + [" " + r for r in rest if r] + ([" "] if rest and not rest[-1] else [])

    def _sections(self, text: str) -> list[tuple[bool, list[str]]]:
        if self.vocabulary.split is None or not any(s in text for s in self.vocabulary.special):
            return [(False, self._parts(text))]
        cut = self.vocabulary.split.split(text)
        return [(i % 2 == 1, [c] if i % 2 else self._parts(c)) for i, c in enumerate(cut) if c]

    def _learn(self, parts: set[str]) -> None:
        """Ids of new parts: those of their pieces, new pieces through the pair index."""
        known, several, new = self.known, {}, set()
        for part in parts:
            pieces = self.vocabulary.pieces.findall(part)
            if len(pieces) > 1:
                several[part] = pieces
                new.update(pieces)
            else:       # most parts are a piece, and stand for it
                new.add(part)
        new = list(new - known.keys())
        if new:
            known.update(zip(new, merge_pool([p.encode() for p in new], self.vocabulary)))
        for part, pieces in several.items():
            known[part] = b"".join([known[p] for p in pieces])

    def forget(self) -> None:
        """Let go of the pieces: the worker stays for other tasks, also those of other operators."""
        self.known = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.forget()
        parts: set[str] = set()
        for text in texts:      # cut twice rather than kept: the parts of a pool take ten times its bytes
            for special, found in self._sections(text):
                if not special:
                    parts.update(found)
        parts -= self.known.keys()
        self._learn(parts)
        del parts
        give_back()     # what was learned with takes more than what is kept
        known = self.known
        special = {s: np.array([i], "<u4").tobytes() for s, i in self.vocabulary.special.items()}
        return [b"".join([special[p] if is_special else known[p] for is_special, found in self._sections(text) for p in found])
                for text in texts]


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(Vocabulary(path))
    return _loaded[path]


@released
def encoded_batches(vocabulary: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = encoder(vocabulary)
    try:
        for batch in batches:
            for first, texts in slices(text_batch(batch), POOL):
                ids = own.encode(texts.to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array(ids, pa.binary())], names=["key", "ids"])
    finally:
        own.forget()


@released
def decoded_batches(vocabulary: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = encoder(vocabulary).vocabulary.bytes
    spelled = np.array([table.get(i, b"") for i in range(max(table) + 1)], dtype=object)
    for batch in batches:
        for first, packed in slices(batch.column(1)):
            texts = [b"".join(spelled[np.frombuffer(p, "<u4")].tolist()).decode("utf-8", "replace") for p in packed.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, len(packed)), packed, pa.array(texts, pa.string())], names=["key", "ids", "text"])


def encode(docs: DataFrame, vocabulary: str, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column`` and ``ids``: the text's ids as packed little-endian unsigned 32-bit integers.

    ``vocabulary`` is the path of a byte-level BPE file of the tokenizers library, present on every node.
    """
    rows = docs.select(F.col(id_column).alias("key"), F.col(text_column).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(partial(encoded_batches, vocabulary), f"key {kind}, ids binary").withColumnRenamed("key", id_column)


def decode(encoded: DataFrame, vocabulary: str, *, id_column: str = "doc_id") -> DataFrame:
    """``id_column``, ``ids`` (null: none) and ``text``, what the ids spell; bytes that are not UTF-8 become U+FFFD."""
    rows = encoded.select(F.col(id_column).alias("key"), "ids")
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(partial(decoded_batches, vocabulary), f"key {kind}, ids binary, text string").withColumnRenamed("key", id_column)


def encode_decode(docs: DataFrame, vocabulary: str, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``decode`` of ``encode``, in one Python worker a task."""
    rows = docs.select(F.col(id_column).alias("key"), F.col(text_column).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return decoded_batches(vocabulary, encoded_batches(vocabulary, batches))

    return rows.mapInArrow(run, f"key {kind}, ids binary, text string").withColumnRenamed("key", id_column)
