"""Token-id files: an adaptive context-mixing range coder over independent, checksummed blocks.

A block starts from empty tables. Its ids are cut into lanes that are coded in lockstep, one id a lane and step, with
shared tables. Three orders predict the next id: order 2 and order 1 the id that followed their context last, with a
confidence; order 0 all ids by their counts so far. How much each is trusted is learned from how often it was right at
the same confidences. An id takes its share of the range: that of the order-2 guess, of the order-1 guess, or of its
order-0 count. The range coder has 64-bit low and range, gives out 32 bits at a time and carries into words given out.

File: a table of blocks (part, block, n_docs, n_ids, data). ``data`` is a header, the documents' ids and lengths, and the
lanes' words, with a CRC-32 of all of it; a document is never cut, so any block is read by itself. Blocks ascend
in document id. Null texts are empty; an empty text has the end id alone; repeated ids are kept, as rows of their own.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kohorte.llm.bpe import Vocabulary
from kohorte.llm.scratch import partitions
from kohorte.llm.textops import flat, slices, span_hashes, text_batch

BLOCK_IDS = 1 << 20
LANES, LANE_IDS = 4096, 256         # at most so many lanes, of at least so many ids
HASH_BITS = 18
JOINED = 20_000     # parts given to the library at a time
REMEMBERED = 1_500_000      # parts a worker keeps, about 60 bytes each
FIRST_SLOTS = 1 << 16
LONGEST = 1000      # bytes of a part; its hash is that of a polynomial modulo 2**64
TRUST_BITS = 3
TRUST = 1 << TRUST_BITS             # confidences 0 to 7
MAGIC = b"KMX2"
HEADER = struct.Struct("<4sIQIIIII")    # magic, CRC, ids, largest id + 1, lanes, documents, bytes of documents, words

BLANKS = frozenset(b" \t\n\v\f\r")
LETTER, BLANK, OTHER = 1, 2, 3      # of ASCII; bytes of other characters are 0
KINDS = np.full(256, OTHER, np.uint8)
KINDS[128:] = 0
KINDS[[c for c in range(128) if chr(c).isalpha()]] = LETTER
KINDS[list(BLANKS)] = BLANK
OTHER_BLANKS = "[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

ONE, WORD, FULL = np.uint64(1), np.uint64(32), np.uint64(1 << 32)

# By confidences (order 2 * TRUST + order 1) and, for 256 cases, which guesses were right (order 2 * 2 + order 1 times 64 more):
# the gain of a guess's confidence, and whether the id takes its place.
TRUST2, TRUST1 = np.divmod(np.arange(TRUST * TRUST), TRUST)
GAIN2, GAIN1 = (np.concatenate([np.where(np.tile(right, TRUST * TRUST), np.where(t < TRUST - 1, 1, 0), -1) for right in rights])
                for t, rights in ((TRUST2, (False, False, True, True)), (TRUST1, (False, True, False, True))))
LOST2, LOST1 = (np.concatenate([~np.tile(right, TRUST * TRUST) & (t <= 1) for right in rights])
                for t, rights in ((TRUST2, (False, False, True, True)), (TRUST1, (False, True, False, True))))


class Mixer:
    """The adaptive model of a block; the coder and the decoder take the same steps.

    A guess and its confidence are one number of a table, guess * TRUST + confidence. What a step learns depends on the two
    confidences and on which guesses were right: 256 cases, looked up in small tables.
    """

    def __init__(self, size: int, lanes: int, decoding: bool = False):
        self.size, self.decoding = size, decoding
        self.bits = max(4, (size - 1).bit_length() + 2)     # order-0 shares add up to 1 << bits
        self.total_bits = self.bits + 3
        self.counts = np.zeros(size, np.int64)
        self.kind = np.dtype(np.int32 if size < 1 << 31 - TRUST_BITS else np.int64)
        self.table1, self.table2 = np.full(size, -TRUST, self.kind), np.full(1 << HASH_BITS, -TRUST, self.kind)    # guess -1: none
        self.gain1, self.gain2 = GAIN1.astype(self.kind), GAIN2.astype(self.kind)
        self.hits = np.tile(np.array([[2], [2], [4]], np.int64), (1, TRUST * TRUST))     # order 2, 1, 0 by confidences
        self.before = np.zeros(lanes, np.int64)
        self.mixed, self.mixed2 = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
        self.step, self.recent, self.cases = 0, [], []
        self._rebuild()

    def _rebuild(self) -> None:
        spare, seen = (1 << self.bits) - self.size, max(int(self.counts.sum()), 1)
        shares = 1 + self.counts * spare // seen
        shares[0] += (1 << self.bits) - int(shares.sum())
        self.upto = np.zeros(self.size + 1, np.uint64)
        self.upto[1:] = np.cumsum(shares)
        if self.decoding:
            self.owner = np.repeat(np.arange(self.size, dtype=self.kind), shares)
        total = (1 << self.total_bits) - (1 << self.bits)
        every = self.hits.sum(axis=0)
        self.share2 = np.where(TRUST2 > 0, total * self.hits[0] // every, 0).astype(np.uint64)
        self.share1 = np.where(TRUST1 > 0, total * self.hits[1] // every, 0).astype(np.uint64)

    def predict(self) -> tuple[np.ndarray, ...]:
        """Guesses of orders 2 and 1 (-1: none), the width of the first one's range, and of both (0: no guess)."""
        self.context = ((self.mixed2 + self.mixed) >> np.uint32(32 - HASH_BITS)).astype(np.int64)
        self.found2, self.found1 = self.table2.take(self.context), self.table1.take(self.before)
        self.guess2, self.guess1 = self.found2 >> TRUST_BITS, self.found1 >> TRUST_BITS
        self.state = (((self.found2 & (TRUST - 1)) << TRUST_BITS) | (self.found1 & (TRUST - 1))).astype(np.int64)
        width2, width1 = self.share2.take(self.state), self.share1.take(self.state)
        width1 *= self.guess1 != self.guess2
        width1 += width2
        return self.guess2, self.guess1, width2, width1

    def ranges(self, ids: np.ndarray, by2: np.ndarray, by1: np.ndarray, width2: np.ndarray, both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the range of each id begins and ends."""
        bits, rest = np.uint64(self.bits), np.uint64(1 << self.total_bits) - both
        first, last = self.upto.take(ids), self.upto[1:].take(ids)
        for edge in (first, last):
            edge *= rest
            edge >>= bits
            edge += both
        np.copyto(first, width2, where=by1)
        np.copyto(first, np.uint64(0), where=by2)
        np.copyto(last, both, where=by1)
        np.copyto(last, width2, where=by2)
        return first, last

    def learn(self, ids: np.ndarray) -> None:
        own = ids.astype(self.kind)
        right = (own == self.guess2).view(np.uint8) << np.uint8(1)
        right |= (own == self.guess1).view(np.uint8)
        right <<= np.uint8(2 * TRUST_BITS)
        case = self.state + right
        fresh = (own << TRUST_BITS) | 1
        for table, at, found, gain, lost in ((self.table2, self.context, self.found2, self.gain2, LOST2),
                                             (self.table1, self.before, self.found1, self.gain1, LOST1)):
            found += gain.take(case)
            np.copyto(found, fresh, where=lost.take(case))
            table[at] = found
        small = ids.astype(np.uint32)
        self.mixed2 = self._of_before(small)
        self.mixed = small * np.uint32(0x85EBCA77)
        self.before = ids
        self.recent.append(ids)
        self.cases.append(case)
        self.step += 1
        if self.step & (self.step - 1) == 0 or self.step % 64 == 0:
            self.counts += np.bincount(np.concatenate(self.recent), minlength=self.size)
            seen = np.bincount(np.concatenate(self.cases), minlength=4 * TRUST * TRUST).reshape(4, -1)
            self.hits += np.stack([seen[2] + seen[3], seen[1], seen[0]])
            self.recent, self.cases = [], []
            if self.hits.max() > 1 << 24:
                self.hits = self.hits // 2 + 1
            self._rebuild()

    def _of_before(self, ids: np.ndarray) -> np.ndarray:
        """The share of what is now the id before last in the next context."""
        last = self.small if self.step else np.zeros(len(ids), np.uint32)
        self.small = ids
        return last * np.uint32(0x9E3779B1)


def _lanes(n: int) -> tuple[int, int]:
    lanes = max(1, min(LANES, n // LANE_IDS))
    return lanes, -(-n // lanes)


def code(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of each lane one after the other, and their numbers."""
    lanes, steps = _lanes(len(ids))
    grid = np.zeros(lanes * steps, np.int64)
    grid[:len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model = Mixer(size, lanes)
    total = np.uint64(model.total_bits)
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    out, begin = np.zeros(lanes * (steps + 3), np.uint32), np.arange(lanes) * (steps + 3)
    end = begin.copy()      # after the last word of each lane

    def carry(at: np.ndarray) -> None:
        while len(at):
            out[at] += np.uint32(1)
            at = at[out[at] == 0] - 1

    for step in range(steps):
        now = grid[step]
        guess2, guess1, width2, both = model.predict()
        by2 = now == guess2
        by2 &= width2 > 0
        by1 = now == guess1
        by1 &= both > width2
        by1 &= ~by2
        first, last = model.ranges(now, by2, by1, width2, both)
        width >>= total
        last -= first
        first *= width
        first += low
        over = first < low
        if over.any():
            carry(end[over] - 1)
        low = first
        width *= last
        small = np.flatnonzero(width < FULL)
        if len(small):
            at, some = end.take(small), low.take(small)
            out[at] = (some >> WORD).astype(np.uint32)
            end[small] = at + 1
            low[small] = some << WORD
            width[small] = width.take(small) << WORD
        model.learn(now)
    for shift in (32, 0):
        out[end] = ((low >> np.uint64(shift)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        end += 1
    filled = end - begin
    return out.reshape(lanes, -1)[np.arange(steps + 3) < filled[:, None]], filled


def uncode(words: np.ndarray, filled: np.ndarray, n: int, size: int) -> np.ndarray:
    lanes = len(filled)
    steps = -(-n // lanes)
    at = np.concatenate([[0], np.cumsum(filled)[:-1]]).astype(np.int64)
    words = np.concatenate([words, np.zeros(2, np.uint32)]).astype(np.uint64)
    model = Mixer(size, lanes, decoding=True)
    total, bits = np.uint64(model.total_bits), np.uint64(model.bits)
    most, whole = np.uint64((1 << model.total_bits) - 1), np.uint64(1 << model.total_bits)
    value = (words[at] << WORD) | words[at + 1]
    at += 2
    width = np.full(lanes, (1 << 64) - 1, np.uint64)
    grid = np.empty((steps, lanes), np.int64)
    for step in range(steps):
        guess2, guess1, width2, both = model.predict()
        width >>= total
        place = np.minimum(value // width, most)
        by2, by1 = place < width2, place < both
        plain = np.flatnonzero(~by1)
        by1 &= ~by2
        now = np.where(by2, guess2, guess1)
        some = both.take(plain)
        inner = place.take(plain) - some + ONE
        inner <<= bits
        inner -= ONE
        inner //= whole - some
        now[plain] = model.owner.take(np.minimum(inner, np.uint64((1 << model.bits) - 1)).astype(np.int64))
        first, last = model.ranges(now, by2, by1, width2, both)
        last -= first
        first *= width
        value -= first
        width *= last
        small = np.flatnonzero(width < FULL)
        if len(small):
            where = at.take(small)
            value[small] = (value.take(small) << WORD) | words.take(np.minimum(where, len(words) - 1))
            width[small] = width.take(small) << WORD
            at[small] = where + 1
        grid[step] = now
        model.learn(now)
    return grid.T.reshape(-1)[:n]


def pack(docs: list[tuple[int | None, np.ndarray]]) -> bytes:
    """A block of documents (id or None, ids)."""
    ids = np.concatenate([d for _, d in docs]) if docs else np.zeros(0, np.uint32)
    size = int(ids.max()) + 1 if len(ids) else 1
    table = zlib.compress(np.array([k or 0 for k, _ in docs], "<i8").tobytes() + np.array([len(d) for _, d in docs], "<u4").tobytes()
                          + bytes(k is None for k, _ in docs))
    words, filled = code(ids, size) if len(ids) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
    body = table + filled.astype("<u4").tobytes() + words.astype("<u4").tobytes()
    rest = HEADER.pack(MAGIC, 0, len(ids), size, len(filled), len(docs), len(table), len(words))[8:]
    return MAGIC + struct.pack("<I", zlib.crc32(rest + body)) + rest + body


def unpack(data: bytes) -> list[tuple[int | None, np.ndarray]]:
    magic, crc, n, size, lanes, n_docs, table, n_words = HEADER.unpack_from(data)
    if magic != MAGIC or zlib.crc32(data[8:]) != crc:
        raise ValueError("damaged block of token ids")
    at = HEADER.size
    listed = zlib.decompress(data[at:at + table])
    keys, sizes, none = (np.frombuffer(listed, kind, n_docs, at * n_docs) for kind, at in (("<i8", 0), ("<u4", 8), ("?", 12)))
    filled = np.frombuffer(data, "<u4", lanes, at + table).astype(np.int64)
    words = np.frombuffer(data, "<u4", n_words, at + table + 4 * lanes)
    ids = uncode(words, filled, n, size).astype(np.uint32) if n else np.zeros(0, np.uint32)
    return [(None if no else int(k), part) for k, no, part in zip(keys, none, np.split(ids, np.cumsum(sizes.astype(np.int64))[:-1]))] if n_docs else []


class LibraryEncoder:
    """Ids by the tokenizers library. Each distinct part of the texts is given to it once and remembered by its hash.

    A part ends before a space, tab or line end that follows another character, and between a letter and another
    ASCII character that is none: no piece of the byte-level pattern crosses there. Texts with other white space, a special
    token or a part of more than ``LONGEST`` bytes are given to the library whole. Two different parts have one hash with a
    probability of about 2**-58 (``textops``).
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark runs as many tasks as there are cores
        from tokenizers import Tokenizer
        vocabulary = Vocabulary(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = list(vocabulary.special)
        self.spelled = np.array([len(vocabulary.bytes.get(i, b"")) for i in range(vocabulary.width)])
        self.forget()

    def forget(self) -> None:
        self.slots = np.zeros(FIRST_SLOTS, np.uint64)       # hash of the part at a place of the table; 0: none
        self.numbers = np.zeros(FIRST_SLOTS, np.int32)
        self.ids = np.zeros(0, np.uint32)                   # of all parts, one after the other
        self.starts = np.zeros(1, np.int64)                 # where each part's begin, and one more at the end

    def _place(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def _numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each part, -1 if it is new."""
        place = self._place(hashes)
        there = self.slots.take(place)
        found = np.where(there == hashes, self.numbers.take(place), -1)
        left = np.flatnonzero((there != hashes) & (there != 0))
        place = place[left]
        while len(left):
            place = (place + 1) & (len(self.slots) - 1)
            there, own = self.slots.take(place), hashes.take(left)
            same = there == own
            found[left[same]] = self.numbers.take(place[same])
            on = ~same & (there != 0)
            left, place = left[on], place[on]
        return found

    def _insert(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        place, left = self._place(hashes), np.arange(len(hashes))
        while len(left):
            at = place[left]
            free = self.slots[at] == 0
            self.slots[at[free]] = hashes[left[free]]       # of several for one place the last one has it
            mine = free & (self.slots[at] == hashes[left])
            self.numbers[at[mine]] = numbers[left[mine]]
            left = left[~mine]
            place[left] = (place[left] + 1) & (len(self.slots) - 1)

    def _learn(self, hashes: np.ndarray, parts: list[bytes]) -> np.ndarray:
        """The numbers that new parts get."""
        ids, counts, order = self._encoded(parts)
        old = len(self.starts) - 1
        while 2 * (old + len(parts)) > len(self.slots):
            used = np.flatnonzero(self.slots)
            kept, numbers = self.slots[used], self.numbers[used]
            self.slots, self.numbers = np.zeros(2 * len(self.slots), np.uint64), np.zeros(2 * len(self.slots), np.int32)
            self._insert(kept, numbers)
        numbers = np.empty(len(parts), np.int32)
        numbers[order] = np.arange(old, old + len(parts))
        self._insert(hashes, numbers)
        self.ids = np.concatenate([self.ids, ids])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts)])
        return numbers

    def _encoded(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the parts one after the other, how many each has, and in which order the parts come."""
        joined = [i for i, p in enumerate(parts) if p[-1] not in BLANKS]
        alone = [i for i, p in enumerate(parts) if p[-1] in BLANKS]
        found, counts = [], []

        def one_by_one(some: list[int]) -> None:
            for e in self.tokenizer.encode_batch_fast([parts[i].decode() for i in some], add_special_tokens=False):
                found.append(np.array(e.ids, np.uint32))
                counts.append(np.array([len(found[-1])]))

        for at in range(0, len(joined), JOINED):
            some = joined[at:at + JOINED]
            # Behind another character white space begins a piece; a part without any gets a line end, which is a piece of its own.
            spelled = [p if p[0] in BLANKS else b"\n" + p for p in (parts[i] for i in some)]
            text = b"".join(spelled).decode()
            if any(s in text for s in self.special):
                one_by_one(some)
                continue
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            sizes = np.array([len(p) for p in spelled])
            added = sizes > np.array([len(parts[i]) for i in some])
            cuts = np.searchsorted(np.cumsum(self.spelled[ids]), np.cumsum(sizes), side="left") + 1
            begins = np.concatenate([[0], cuts[:-1]])
            own = np.ones(len(ids), bool)
            own[begins[added]] = False
            found.append(ids[own])
            counts.append(cuts - begins - added)
        for at in range(0, len(alone), JOINED):
            one_by_one(alone[at:at + JOINED])
        return np.concatenate(found), np.concatenate(counts), np.array(joined + alone)

    def encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's begin (one more at the end)."""
        if len(self.starts) > REMEMBERED:
            self.forget()
        raw, at = flat(texts)
        whole = pc.match_substring_regex(texts, OTHER_BLANKS)
        for s in self.special:
            whole = pc.or_(whole, pc.match_substring(texts, s))
        whole = whole.to_numpy(zero_copy_only=False) & (np.diff(at) > 0)
        kind = KINDS[raw]
        begins = np.zeros(len(raw) + 1, bool)
        blank = kind == BLANK
        begins[1:-1] = blank[1:] & ~blank[:-1]
        begins[1:-1] |= (kind[1:] == OTHER) & (kind[:-1] == LETTER)
        del kind, blank
        begins[at] = True
        begins[-1] = False
        first = np.flatnonzero(begins)
        sizes = np.diff(first, append=len(raw))
        upto = np.searchsorted(first, at)       # the parts of each text
        long = np.flatnonzero(sizes > LONGEST)
        if len(long):
            whole[np.searchsorted(at, first[long], side="right") - 1] = True
        odd = np.flatnonzero(whole)
        for row in odd:
            begins[at[row] + 1:at[row + 1]] = False
        if len(odd):
            first = np.flatnonzero(begins)
            sizes = np.diff(first, append=len(raw))
            upto = np.searchsorted(first, at)
        plain = np.ones(len(first), bool)
        plain[upto[odd]] = False
        begin, size = first[plain], sizes[plain]
        hashes = span_hashes(raw, begin, size)
        found = self._numbers(hashes)
        new = np.flatnonzero(found < 0)
        if len(new):
            distinct, one, inverse = np.unique(hashes[new], return_index=True, return_inverse=True)
            one = new[one]
            data = raw.tobytes()
            numbers = self._learn(distinct, [data[a:a + n] for a, n in zip(begin[one].tolist(), size[one].tolist())])
            found[new] = numbers[inverse]
        store, starts = self.ids, self.starts
        begin, end = np.empty(len(first), np.int64), np.empty(len(first), np.int64)
        begin[plain], end[plain] = starts.take(found), starts[1:].take(found)
        if len(odd):
            own = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts.take(pa.array(odd)).to_pylist(), add_special_tokens=False)]
            ends = len(store) + np.cumsum([len(x) for x in own])
            begin[~plain], end[~plain] = np.concatenate([[len(store)], ends[:-1]]), ends
            store = np.concatenate([store, *own])
        counts = end - begin
        behind = np.concatenate([[0], np.cumsum(counts)])
        take = np.repeat(begin - behind[:-1], counts)
        take += np.arange(len(take))
        return store.take(take), behind[upto]

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, at = self.encoded(pa.array(texts, pa.string()))
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip(at.tolist(), at[1:].tolist())]


_loaded: dict[str, LibraryEncoder] = {}


def library(path: str) -> LibraryEncoder:
    if path not in _loaded:
        _loaded[path] = LibraryEncoder(path)
    return _loaded[path]


def blocks(docs: DataFrame, vocabulary: str, *, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text",
           block_ids: int = BLOCK_IDS) -> DataFrame:
    """The blocks of a file of all documents in ascending id order, each followed by ``end_id``. Null ids come last; rows with
    null or equal ids are documents of their own, in the order of their texts' hashes."""
    rows = docs.select(F.col(id_column).cast("long").alias("key"), F.col(text_column).alias("text"))
    # A large group of one id is dealt out by its texts.
    order = [F.asc_nulls_last("key"), "mark"]
    ranged = rows.withColumn("mark", F.xxhash64("text")).repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(
        *order, "text").select("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, number = library(vocabulary), TaskContext.get().partitionId(), 0
        held: list[tuple[int, np.ndarray]] = []
        n = 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {"part": [part], "block": [number], "n_docs": [len(held)], "n_ids": [n], "data": [pack(held)]}, schema=kind)

        for batch in batches:
            for first, texts in slices(text_batch(batch)):
                ids, at = own.encoded(texts)
                ids = np.insert(ids, at[1:], end_id)
                at += np.arange(len(at))
                for key, a, b in zip(batch.column(0).slice(first, len(texts)).to_pylist(), at.tolist(), at[1:].tolist()):
                    held.append((key, ids[a:b]))
                    n += b - a
                    if n >= block_ids:
                        yield block()
                        held, n, number = [], 0, number + 1
        if held:
            yield block()

    kind = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("data", pa.binary())])
    return ranged.mapInArrow(run, "part int, block int, n_docs long, n_ids long, data binary")


def read(file: DataFrame, *, id_column: str = "doc_id") -> DataFrame:
    """(part, block, nth, ``id_column``, offset, ids): the documents of each block; ``offset`` counts the ids before it in
    the block, ``ids`` are packed little-endian unsigned 32-bit integers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, data in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                docs = unpack(data)
                sizes = [len(d) for _, d in docs]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(docs), pa.int32()), pa.array([number] * len(docs), pa.int32()),
                     pa.array(range(len(docs)), pa.int32()), pa.array([k for k, _ in docs], pa.int64()),
                     pa.array(np.cumsum([0] + sizes[:-1]) if docs else [], pa.int64()),
                     pa.array([d.astype("<u4").tobytes() for _, d in docs], pa.binary())],
                    names=["part", "block", "nth", "key", "offset", "ids"])

    out = file.select("part", "block", "data").mapInArrow(run, "part int, block int, nth int, key long, offset long, ids binary")
    return out.withColumnRenamed("key", id_column)


def block_starts(file: DataFrame) -> DataFrame:
    """(part, block, begin): the ids of all blocks before each. One number a part goes through the driver."""
    sizes = file.select("part", "block", "n_ids")
    totals = sorted((r["part"], r["n"]) for r in sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    at, begins = 0, []
    for part, n in totals:
        begins += [F.lit(part), F.lit(at).cast("long")]
        at += n
    inner = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = F.element_at(F.create_map(*begins), F.col("part")) if begins else F.lit(0).cast("long")
    return sizes.select("part", "block", (inner + base).alias("begin"))
