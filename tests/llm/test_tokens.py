import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kohorte.llm import bpe, mixcoder, queries, separators
from kohorte.llm.scratch import Scratch

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  ", "a  b", "a \n b", "\n\n x\n", "it's we'll I'M  don't", "a" * 5000, "<|endoftext|>x <|endoftext|> <|endoftext|>",
       "日本語 テキスト　x", "a\x85b \x1c\x1d c\x0b\x0c d", "12345 678 ½ ²", "x ", " x", "\U0001F600\U0001F600", "é́ ​ x y", "word " * 3000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sdlt<|>ae"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_encoders_equal_the_library(text):
    want = _library().encode(text, add_special_tokens=False).ids
    for own in (bpe.encoder(PATH), mixcoder.library(PATH)):
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == want


def _library(kept=[]):  # noqa: B006
    if not kept:
        kept.append(Tokenizer.from_file(PATH))
    return kept[0]


def rows():
    return [(i, t) for i, t in enumerate(ODD)] + [(500, None), (501, ODD[3]), (501, ODD[3])]


def test_digests_of_ids_and_texts(spark, documents, library):
    got = sorted(tuple(r) for r in queries.coded(documents(rows())).collect())
    want = []
    for key, text in rows():
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((key, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    assert queries.coded(documents(rows()).limit(0)).count() == 0
    extra = documents(rows()).withColumn("ids", F.lit(1)).withColumn("key", F.lit(2))
    assert bpe.decode(bpe.encode(extra, PATH), PATH).count() == len(rows())


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 3000), st.sampled_from([1, 2, 300, 50257, 400000]), st.integers(0, 10**6), st.booleans())
def test_coder_gives_ids_back(n, size, seed, repeated):
    rng = np.random.default_rng(seed)
    ids = rng.integers(0, size, n).astype(np.uint32)
    if repeated and n > 10:
        ids[n // 2:2 * (n // 2)] = ids[:n // 2]
    cuts = sorted(rng.integers(0, n + 1, 3).tolist())
    docs = [(int(k), d) for k, d in zip((3, 7, 7, 9), np.split(ids, cuts))]
    data = mixcoder.pack(docs)
    back = mixcoder.unpack(data)
    assert [k for k, _ in back] == [3, 7, 7, 9] and all((a == b).all() and len(a) == len(b) for (_, a), (_, b) in zip(docs, back))
    at = int(rng.integers(8, len(data)))
    with pytest.raises(ValueError):
        mixcoder.unpack(data[:at] + bytes([data[at] ^ 1]) + data[at + 1:])


def test_coder_learns_contexts():
    rng = np.random.default_rng(0)
    plain = rng.integers(0, 50000, 20000).astype(np.uint32)
    loops = np.tile(rng.integers(0, 50000, 50).astype(np.uint32), 400)
    assert len(mixcoder.pack([(0, loops)])) < 0.35 * len(mixcoder.pack([(0, plain)]))
    assert mixcoder.unpack(mixcoder.pack([])) == []


def test_token_file(spark, documents, library):
    file = Scratch(spark, "t").keep(mixcoder.blocks(documents(rows()), PATH, block_ids=1000), "blocks")
    assert file.count() > 2
    found = mixcoder.read(file).join(mixcoder.block_starts(file), ["part", "block"]).withColumn("start", F.col("begin") + F.col("offset"))
    at, want = 0, []
    for key, text in sorted(rows(), key=lambda r: r[0]):
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((key, at, zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [(r["doc_id"], r["start"], zlib.crc32(r["ids"])) for r in found.orderBy("start").collect()] == want
    empty = Scratch(spark, "t").keep(mixcoder.blocks(documents(rows()).limit(0), PATH), "blocks")
    assert mixcoder.read(empty).join(mixcoder.block_starts(empty), ["part", "block"]).count() == 0


@pytest.mark.parametrize("block_bytes", [2, 6, 64, 1 << 20])
def test_separator_scan(spark, block_bytes):
    rng = random.Random(3)
    docs = [[rng.randrange(2, 500) for _ in range(rng.choice([0, 0, 1, 3, 40]))] for _ in range(60)]
    data = [(f"f{i}", bytearray(np.array([x for d in docs[a:b] for x in [*d, 1]] + tail, ">u2").tobytes()))
            for i, (a, b, tail) in enumerate([(0, 25, []), (25, 60, [9, 9, 9]), (60, 60, []), (60, 60, [5])])]
    files = spark.createDataFrame(data, "file string, payload binary")
    got = separators.documents(separators.scan_files(files, 1, block_bytes=block_bytes))
    want = []
    for name, part, tail in (("f0", docs[:25], 0), ("f1", docs[25:], 3), ("f3", [], 1)):
        start = 0
        for i, d in enumerate(part):
            want.append((name, i, start, len(d), True))
            start += len(d) + 1
        if tail:
            want.append((name, len(part), start, tail, False))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_counts_of_flat_files(spark, documents, library, tmp_path):
    encoded = bpe.encode(documents(rows()), PATH)
    files = Scratch(spark, "t").keep(separators.flat_files(encoded, end_id=queries.END_ID, file_bytes=3000), "files")
    got = sorted((r["doc_id"], r["n_tokens"]) for r in separators.named(files, separators.documents(separators.scan_files(files, queries.END_ID))).collect())
    sizes = sorted((k, len(library.encode(t or "", add_special_tokens=False).ids)) for k, t in rows())
    assert got == sizes
    separators.write_flat(encoded, str(tmp_path / "flat"), end_id=queries.END_ID)
    read = separators.documents(separators.scan(separators.read_blocks(spark, str(tmp_path / "flat"), block_bytes=512), queries.END_ID))
    assert sorted(r["n_tokens"] for r in read.collect()) == sorted(n for _, n in sizes)
    none = separators.flat_files(encoded.limit(0), end_id=queries.END_ID)
    assert separators.named(none, separators.documents(separators.scan_files(none, queries.END_ID))).count() == 0


def test_token_files_of_null_and_repeated_ids(spark, documents):
    """Null ids come last; every row is a document of its own, also where one id has most of them."""
    docs = [(None, "no id"), (5, "five"), (None, None), (2, "two"), (None, "no id"), *[(5, f"five {i}") for i in range(40)]]
    file = Scratch(spark, "t").keep(mixcoder.blocks(documents(docs), PATH, block_ids=50), "blocks")
    found = mixcoder.read(file).join(mixcoder.block_starts(file), ["part", "block"]).withColumn("start", F.col("begin") + F.col("offset"))
    got = found.orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [2, *[5] * 41, *[None] * 3]
    own = mixcoder.library(PATH)
    want = sorted((repr(k), ids + b"\0\0\0\0") for (k, t), ids in zip(docs, own.encode([t or "" for _, t in docs])))
    assert sorted((repr(r["doc_id"]), bytes(r["ids"])) for r in got) == want
    assert [r["start"] for r in got] == [sum(len(x["ids"]) // 4 for x in got[:i]) for i in range(len(got))]
    assert mixcoder.unpack(mixcoder.pack([(None, mixcoder.np.zeros(1, "u4")), (0, mixcoder.np.zeros(2, "u4"))]))[0][0] is None


def test_workers_forget_pieces_at_the_end_of_a_task():
    """A worker that goes on to other operators holds no pieces of the task before."""
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"key": [1, 2], "text": ["some words of a text", None]})
    ids = [r for out in bpe.encoded_batches(PATH, iter([batch])) for r in out.column(1).to_pylist()]
    assert ids == bpe.encoder(PATH).encode(["some words of a text", ""])
    list(bpe.encoded_batches(PATH, iter([batch])))
    assert not bpe.encoder(PATH).known


def test_library_gets_each_distinct_part_once():
    """Line ends and signs behind a word make no new part of it, and a part met before is not given to the library again."""
    class Counted:
        def __init__(self, inner):
            self.inner, self.given = inner, 0

        def encode(self, text, **more):
            self.given += len(text)
            return self.inner.encode(text, **more)

        def encode_batch_fast(self, texts, **more):
            self.given += sum(map(len, texts))
            return self.inner.encode_batch_fast(texts, **more)

    own = mixcoder.LibraryEncoder(PATH)
    own.tokenizer = counted = Counted(own.tokenizer)
    words, rng = [f"{a}{b}ing" for a in "abcdefghij" for b in ("lor", "tis", "men", "qua")], random.Random(5)
    texts = ["".join(rng.choice([" ", " ", "\n"]) + rng.choice(words) + rng.choice(["", ".", ",", "!!", "&&&"]) for _ in range(500)) for _ in range(20)]
    got = [ids for text in texts for ids in own.encode([text])]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [e.ids for e in counted.inner.encode_batch(texts, add_special_tokens=False)]
    assert counted.given < 1500


def test_library_encoder_keeps_texts_apart(library, monkeypatch):
    """Long parts, special tokens (also such that parts would join to), other white space, a table that grows and is let go of."""
    monkeypatch.setattr(mixcoder, "FIRST_SLOTS", 16)
    monkeypatch.setattr(mixcoder, "JOINED", 7)
    rng = random.Random(6)
    pieces = ["<", "|", "endoftext", "|>", "<|endoftext|>", " ", "  ", "\n", "\t", "\x1c", " ", "　", "'s", "it's", "x" * 1200, "é", "1", "word", "…", ""]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(400)] + ["<|endoftext", "|>", "", *ODD]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    own = mixcoder.LibraryEncoder(PATH)
    for remembered in (10**6, 0):
        monkeypatch.setattr(mixcoder, "REMEMBERED", remembered)
        for _ in range(2):
            assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == want
        assert [np.frombuffer(own.encode([t])[0], "<u4").tolist() for t in texts[:100]] == want[:100]
    assert own.encode([]) == []


def test_blocks_of_fewer_lanes_are_read(monkeypatch):
    """The number of lanes is read from the block."""
    ids = np.random.default_rng(2).integers(0, 900, 20000).astype(np.uint32)
    monkeypatch.setattr(mixcoder, "LANES", 20)
    data = mixcoder.pack([(4, ids)])
    monkeypatch.undo()
    (key, back), = mixcoder.unpack(data)
    assert key == 4 and (back == ids).all()
