"""Toxicity, source divergence and hard negatives against plain versions."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from kohorte.llm import negatives, queries, stripes, toxicity
from kohorte.llm.scratch import Scratch


def sources(n, seed=0):
    rng = random.Random(seed)
    words = [f"w{c}" for c in "abcdefghij"] + ["Étude", "ÉTUDE", "naïve", "Ab", "aB", "don't", "x9y"]
    docs = [(None, None, "wa wb"), ("", "", "WA;wb-wc"), ("xx", "s", None), ("xx", "t", ""), ("yy", "only", "wa " * 40), ("zz", "s", "1 2 3")]
    for _ in range(n):
        lang, source = rng.choice([("en", "a"), ("en", "a"), ("en", "b"), ("en", None), ("de", "a"), ("de", "é"), (None, "a")])
        docs.append((lang, source, rng.choice([" ", "_", "9", "\n"]).join(rng.choices(words, range(1, 18), k=rng.randint(0, 30)))))
    return docs + [docs[-1]] * 5


@pytest.mark.parametrize(("held", "bucket", "rows"), [(1 << 18, 4096, 256), (8, 3, 2)])
def test_divergences_against_plain_counts(spark, monkeypatch, held, bucket, rows):
    """At once, and with spilled stripes, several buckets and several rows of sources."""
    for name, value in (("HELD", held), ("BUCKET", bucket), ("ROWS", rows)):
        monkeypatch.setattr(stripes, name, value)
    docs = sources(300)
    table = spark.createDataFrame([(*d, 1, "x") for d in docs], "lang string, source string, text string, term long, counts string").repartition(6)
    for least, top in ((30, 50), (3, 4), (10**6, 5)):
        got = stripes.divergences(table, least_documents=least, top=top)
        assert sorted(map(tuple, got.collect())) == brute.divergences(docs, least, top)
    assert [f"{f.name} {f.dataType.simpleString()}" for f in got.schema.fields] == [
        "lang string", "source string", "part string", "item string", "value bigint", "rank int"]


def test_divergences_of_empty_tables(spark, documents):
    assert stripes.divergences(documents([])).collect() == []
    assert stripes.divergences(documents([(1, None)]), least_documents=1).collect() == []


def test_terms_are_bytes_between_separators():
    row, term, names = stripes.terms(pa.array(["aB", "c", "", "Ünïx-ÜNÏX 9ab", "b"]))
    assert [(r, names[t].as_py()) for r, t in zip(row, term)] == [(0, "ab"), (1, "c"), (3, "Ünïx"), (3, "ÜnÏx"), (3, "ab"), (4, "b")]
    assert len(names) == 5
    long = "é" * 3_000_000 + " " + "word " * 200_000
    row, term, names = stripes.terms(pa.array([long]))
    assert len(row) == 200_001 and [len(n.as_py()) for n in names] == [3_000_000, 4]


def test_shares_are_exact_at_any_size():
    rng = random.Random(3)
    for _ in range(300):
        total, kept = rng.randrange(1, 10 ** rng.randint(1, 15)), rng.randint(1, 10**6)
        count = rng.randint(0, total)
        assert stripes.share(np.array([count]), np.array([total]), kept)[0] == 1 + 10**9 * (count + 5) // (total + 5 * kept)


VECTORS = "vec_id long, embedding array<float>, label int, key string, leaf double"


def vectors(n, dimension, seed, hot=0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dimension)] for _ in range(6)]
    out = []
    for i in range(n):
        centre = rng.choice(centres)
        x = [float(np.float32(c + rng.gauss(0, rng.choice([0.1, 0.6])))) for c in centre]
        if i % 11 == 0 and out:
            x = out[-1][1]
        if i < hot:
            x = [0.5] * dimension
        out.append((i, x, rng.randrange(4)))
    return out


def scaled(x):
    return [math.floor(256 * v) for v in x]


def mined(spark, rows, anchor, **options):
    table = spark.createDataFrame([(*r, "own", 0.5) for r in rows], VECTORS)
    found = negatives.mine(table, label=F.col("label"), anchor=anchor, **options)
    return sorted(map(tuple, found.collect()), key=repr)


@pytest.mark.parametrize(("dimension", "leaf", "rows", "anchors", "hot"), [(3, 64, 16384, 1024, 0), (3, 4, 5, 2, 90), (17, 8, 50, 7, 0), (1, 2, 9, 3, 0)])
def test_negatives_against_all_pairs(spark, monkeypatch, dimension, leaf, rows, anchors, hot):
    """With trees of several depths, blocks smaller than leaves, and one vector with a third of all rows."""
    for name, value in (("LEAF", leaf), ("ROWS", rows), ("ANCHORS", anchors), ("SAMPLE", 200)):
        monkeypatch.setattr(negatives, name, value)
    table = vectors(270, dimension, dimension, hot)
    want = brute.hard_negatives([(k, label, scaled(x)) for k, x, label in table], set(range(0, 270, 9)))
    assert mined(spark, table, F.col("vec_id") % 9 == 0) == sorted(want, key=repr) and want


def test_negatives_of_odd_rows(spark):
    """Nulls, non-finite components, null and repeated ids, ragged vectors, negative scores, empty tables."""
    whole = [(0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [0.8, 0.0], 2), (2, [0.8, 0.0], 2), (None, [0.85], 2), (3, [0.75, 9.0, 2.0], 3), (4, [], 1),
             (5, [-1.0, 0.0], 2), (100, [-1.0, 0.0], 7), (101, [1.0, 0.5], 7), (102, [0.9, 0.5], 8)]
    odd = [(6, None, 1), (7, [1.0, None], 1), (8, [1.0, float("nan")], 1), (9, [float("inf"), 0.0], 1), (10, [1.0, 0.0], None), (11, [1e30, 0.0], 2)]
    order = sorted(range(len(whole)), key=lambda i: (whole[i][0] is None, whole[i][0] or 0))
    rows = [(k, whole[i][2], scaled(whole[i][1])) for k, i in enumerate(order)]     # keys that ascend with the id, nulls last
    names = [whole[i][0] for i in order]
    want = brute.hard_negatives(rows, {k for k, name in enumerate(names) if name is not None and name % 100 == 0})
    want = [(names[a], names[p], r, names[n], s, t) for a, p, r, n, s, t in want]
    assert mined(spark, odd + whole, F.col("vec_id") % 100 == 0) == sorted(want, key=repr) and want
    assert mined(spark, odd, F.lit(True)) == [] and mined(spark, [], F.lit(True)) == [] and mined(spark, whole, F.lit(False)) == []


def test_trees_leave_leaves_out(spark, tmp_path):
    """Narrow windows in clustered data meet few leaves; no leaf with a row in the window is left out."""
    monkey = vectors(600, 4, 5)
    scratch = Scratch(spark, "test-tree")
    table = spark.createDataFrame([(*r, "own", 0.5) for r in monkey], VECTORS)
    rows = negatives.prepared(table, scratch, label=F.col("label"), anchor=F.lit(True), id_column="vec_id", vector_column="embedding", scale=256.0)
    index = negatives.Index(rows, scratch)
    stored = index.rows.select("key", "vector", "leaf").collect()
    x = np.array([np.frombuffer(r["vector"]) for r in stored])
    scores, leaf = x @ x.T, np.array([r["leaf"] for r in stored])
    high = np.sort(scores, axis=1)[:, -4]
    low = np.ceil(high * 0.98)
    row, met = negatives.survivors(index.nodes, x, low, high)
    pairs = set(zip(row.tolist(), met.tolist()))
    for i in range(len(x)):
        assert {(i, n) for n in leaf[(scores[i] >= low[i]) & (scores[i] <= high[i])].tolist()} <= pairs
    assert len(pairs) < 0.6 * len(x) * len(set(leaf.tolist()))


def insulted(n, seed=1):
    """Toxic where an insult meets the mention of a group; two insults or two groups alone are clean, as is the rest."""
    rng = random.Random(seed)
    words = [f"{a}{b}{c}" for a in "bdfgkl" for b in "aeiou" for c in "mnrst"]
    insults, groups = ["vile", "scum", "filthy"], ["zorgs", "quaffs", "pleebs"]
    docs, labels = [], []
    for i in range(n):
        text, kind = rng.choices(words, k=rng.randint(3, 20)), i % 4
        text += {0: [], 1: rng.sample(insults, 2), 2: rng.sample(groups, 2), 3: [rng.choice(insults), rng.choice(groups)]}[kind]
        rng.shuffle(text)
        docs.append((i, " ".join(text).title() if i % 3 else " ".join(text)))
        labels.append((i, 1, int(kind == 3)))
    return docs, labels


def test_toxicity_of_pairs(spark, documents):
    """An additive model can't tell these apart: three quarters of them is its best; labels of held-out rows aren't read."""
    docs, labels = insulted(1500)
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    turned = [(i, q, 1 - t if out(i) else t) for i, q, t in labels]
    table = spark.createDataFrame(turned, "doc_id long, quality int, toxic int")
    got = toxicity.held_out_scores(documents(docs).withColumns({"score": F.lit("own"), "toxic": F.lit(1)}), table).collect()
    assert {r["doc_id"]: r["held_out"] for r in got} == {i: out(i) for i, _ in docs}
    truth = {i: t for i, _, t in labels}
    right = [r["predicted"] == truth[r["doc_id"]] for r in got if r["held_out"]]
    assert sum(right) > 0.97 * len(right) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_logit_is_the_sum_over_pairs():
    rng = np.random.default_rng(2)
    model = toxicity.Model(np.arange(9, dtype=np.uint64), -0.5, rng.normal(size=9), rng.normal(size=(9, 4)))
    texts = [[0, 3, 4], [], [8], [1, 2, 3, 4, 5, 6, 7, 8]]
    row, term = np.repeat(np.arange(4), [len(t) for t in texts]), np.array(sum(texts, []))
    want = [-0.5 + model.weights[t].sum() + sum(model.factors[a] @ model.factors[b] for i, a in enumerate(t) for b in t[i + 1:]) for t in texts]
    assert np.allclose(model.logits(row, term, 4)[0], want)


def test_toxicity_of_odd_rows(spark, documents):
    docs, labels = insulted(1500)
    odd = [(None, "vile zorgs"), (None, None), (7000, None), (7001, ""), (3, docs[3][1]), (7002, "Vile, zorgs! " * 40_000), (7003, "é" * 50_000)]
    labels = [*labels, (None, 1, 1), (4, 1, None), (7, None, 0), (9999, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.held_out_scores(documents(docs + odd), table).collect()
    assert len(got) == len(docs) + len(odd)
    score = {r["doc_id"]: r["score"] for r in got}
    assert score[7000] == score[7001] < 0.5 < score[7002] and score[7003] < 0.5
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [True, True]
    assert len({r["score"] for r in got if r["doc_id"] == 3}) == 1
    none = table.limit(0)
    assert {(r["score"], r["predicted"]) for r in toxicity.held_out_scores(documents(docs[:5]), none).collect()} == {(0.0, 0)}
    assert toxicity.held_out_scores(documents([]), table).collect() == []
    clean = table.where("toxic = 0")
    assert {r["predicted"] for r in toxicity.held_out_scores(documents(docs), clean).collect()} == {0}


def test_toxicity_on_given_tables(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [(r["score"], labels[r["doc_id"]]) for r in queries.op11_toxicity(spark, folder).collect() if r["held_out"] and r["doc_id"] in labels]
    assert sum((s >= 0.5) == t for s, t in held) >= 0.95 * len(held)
