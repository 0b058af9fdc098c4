import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import brute
from kohorte.llm import components, lines, partenum
from kohorte.llm.scratch import Scratch


def near_copies(seed, n_base=12, copies=6, size=(1, 160)):
    """Base texts, and copies of them with some words changed; nulls, empties, equal rows, one long text."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = []
    for _ in range(n_base):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(*size))]
        docs.append(base)
        for _ in range(rng.randint(0, copies)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 20))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            docs.append(copy)
    texts = [" ".join(d) for d in docs] + [None, "", " \t\n", "a b", "A  b", " ".join(vocabulary * 12), " ".join(vocabulary * 12) + " x"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_join_against_all_pairs(spark, documents, seed):
    docs = near_copies(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in partenum.classes(documents(docs)).collect()}
    assert got == brute.components(docs)


def test_join_keeps_links_of_a_large_group_with_shared_passages(spark, documents):
    """Many copies of one text that are each nearer to it than to each other, and texts that share half of their words."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(220)]
    docs = [(0, " ".join(base))]
    for i in range(1, 60):
        copy = list(base)
        for _ in range(3):
            copy[rng.randrange(len(copy))] = f"x{rng.random()}"
        docs.append((i, " ".join(copy)))
    passage = [f"p{i}" for i in range(60)]
    docs += [(100 + i, " ".join([f"o{i}x{k}" for k in range(50)] + passage)) for i in range(40)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in partenum.classes(documents(docs)).collect()}
    assert got == brute.components(docs)


def test_first_of_class_keeps_columns_and_textless_documents(spark, documents):
    docs = documents([(1, "a b c d e f"), (2, "A b c d e f"), (3, ""), (4, None), (5, "")])
    extra = docs.selectExpr("*", "1 as component_id", "2 as n_shingles", "'x' as fp")
    kept = partenum.first_of_class(extra)
    assert kept.columns == extra.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 5]
    assert partenum.classes(docs.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 500), st.integers(0, 10**6))
def test_similar_sets_share_enough_signatures(size, seed):
    rng = np.random.default_rng(seed)
    one = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
    other = set(one.tolist())
    while True:      # change as much as the threshold lets
        trial = set(other)
        if rng.random() < 0.5 and len(trial) > 1:
            trial.remove(next(iter(trial)))
        else:
            trial.add(int(rng.integers(0, 2**63)))
        if 100 * len(trial & set(one.tolist())) < 75 * len(trial | set(one.tolist())):
            break
        other = trial
    two = np.unique(np.array(sorted(other), np.uint64))
    shared = 0
    for k in range(len(partenum.bands(75, 2000))):
        mine = [partenum.signatures(s, k)[0] for s in (one, two)
                if k - 1 <= np.searchsorted(partenum.bands(75, len(s)), len(s), side="right") - 1 <= k]
        if len(mine) == 2 and len(np.intersect1d(*mine)) > partenum.signatures(one, k)[1]:
            shared += 1
    assert shared


def test_components_of_chains_and_stars(spark, tmp_path):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(300, 200), (200, 250), (7, 7)]
    found = components.connected(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "roots")
    got = {r["a"]: r["b"] for r in found.collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)}, 250: 200, 300: 200}


def repeated_lines(seed):
    rng = random.Random(seed)
    pool = [" ".join(f"v{rng.randrange(30)}" for _ in range(rng.randint(0, 9))) for _ in range(12)]
    docs = []
    for i in range(40):
        text = "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))
        docs.append((i * 3, text if i % 13 else None))
    docs += [(200 + i, "\n".join(pool)) for i in range(3)]     # equal rows
    return docs


@pytest.mark.parametrize("seed,min_words", [(1, 10), (2, 10), (3, 25), (4, 1)])
def test_line_dedup_against_all_pairs(spark, documents, seed, min_words):
    docs = repeated_lines(seed)
    got = lines.dedup_lines(documents(docs), length_column="n_chars", min_words=min_words).collect()
    want = brute.deduped(docs, min_words)
    for r in got:
        if r["text"] is None:
            assert (r["n_lines"], r["n_removed"]) == (0, 0) and r["doc_id"] not in want
        else:
            assert (r["text"], r["n_lines"], r["n_removed"]) == want[r["doc_id"]]
            assert r["n_chars"] == len(r["text"])
    assert len(got) == len(docs)


def test_line_dedup_ranks_long_copies_in_few_rounds(spark, documents, monkeypatch):
    """Copies of 300 lines are told apart in at most 7 rounds, also where they share 1, 2, 7, 8, 9, 31, 32 ... lines."""
    kept, keep = [], Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name: kept.append(name) or keep(self, df, name))
    whole = [f"line {i} of the text" for i in range(300)]
    docs = [(1, "\n".join(whole)), (2, "\n".join(whole))]
    for i, n in enumerate((1, 2, 3, 7, 8, 9, 31, 32, 33, 127, 128, 129)):
        docs.append((10 + i, "\n".join([f"before {i}", *whole[i:i + n], f"behind {i}", *whole[-n:]])))
    got = lines.dedup_lines(documents(docs), min_words=10).collect()
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in got} == brute.deduped(docs, 10)
    assert sum(name.startswith("pairs-") for name in kept) <= 7


def test_line_dedup_extra_columns_and_empty_table(spark, documents):
    line = " ".join(["word"] * 60)
    docs = documents([(1, line), (2, f"own\n{line}"), (3, "")]).selectExpr("*", "1 as n_lines", "2 as pos", "3 as doc", "4 as rank")
    got = lines.dedup_lines(docs)
    assert set(docs.columns) <= set(got.columns)
    assert [(r["doc_id"], r["text"], r["pos"], r["doc"]) for r in got.orderBy("doc_id").collect()] == [
        (1, line, 2, 3), (2, "own", 2, 3), (3, "", 2, 3)]
    assert lines.dedup_lines(docs.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 6)), min_size=1, max_size=30, unique_by=lambda x: x[0]), st.integers(1, 6))
def test_sweep_in_parts_equals_sweep_at_once(entries, parts):
    places, lcps = [(0, p) for p, _ in entries], [0] + [n for _, n in entries[1:]]
    want = []
    for i, place in enumerate(places):
        best, least = 0, lines.ENDLESS
        for j in range(i - 1, -1, -1):
            least = min(least, lcps[j + 1])
            if places[j] < place:
                best = max(best, least)
        want.append(best)
    assert lines.sweep(places, lcps, lines.Stack()) == want
    size, got, carried = -(-len(places) // parts), [], lines.Stack()
    for a in range(0, len(places), size):
        own, some = places[a:a + size], lcps[a:a + size]
        got += lines.sweep(own, some, lines.Stack(carried.entries()))
        local = lines.Stack()
        lines.sweep(own, some, local)
        carried.close(min(some))
        for length, (doc, pos) in local.entries():
            lines._merge(carried, {"length": length, "doc": doc, "pos": pos})
    assert got == want


def test_line_dedup_of_repeated_rows_and_null_ids(spark, documents):
    rng = random.Random(9)
    run = [f"line {i} " + " ".join(f"v{rng.randrange(30)}" for _ in range(6)) for i in range(24)]
    long, other = "\n".join(run), "\n".join(["own", *run[4:], "end"])
    docs = [(5, long), (5, long), (5, long), (1, other), (None, other), (None, "alone\n" + long), (None, None), (7, None), (7, "x\nx")]
    got = lines.dedup_lines(documents(docs), length_column="n_chars", min_words=25).collect()
    assert len(got) == len(docs) and all(r["n_chars"] == len(r["text"]) for r in got if r["text"] is not None)
    found = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "", r["n_removed"]) for r in got)
    # Ids ascend, nulls last: the first copy of each run stays, in document 1 and then in one of the documents 5.
    assert found == sorted([(False, 1, other, 0), (False, 5, "\n".join(run[:4]), 20), (False, 5, "", 24), (False, 5, "", 24),
                            (False, 7, "", 0), (False, 7, "x\nx", 0), (True, 0, "", 0), (True, 0, "", 22), (True, 0, "alone", 24)])


def test_first_of_class_of_repeated_rows_and_null_ids(spark, documents):
    words = [f"w{i}" for i in range(60)]
    a, near, b, c = " ".join(words), " ".join([*words, "more"]), " ".join(words[::-1]), " ".join(words[::3] * 2)
    docs = [(None, a), (None, near), (4, b), (4, b), (None, b), (6, c), (6, a + " 6 6"), (None, None), (None, ""), (9, None), (9, None)]
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in partenum.first_of_class(documents(docs)).collect())
    assert kept == sorted([(4, b), (6, c), (6, a + " 6 6"), (0, ""), (0, ""), (9, ""), (9, "")])
    only_null = partenum.first_of_class(documents([(None, a), (None, near), (None, c), (None, c)])).collect()
    assert len(only_null) == 2 and {r["text"] == c for r in only_null} == {True, False}


def test_join_of_repeated_and_null_ids(spark, documents):
    words = [f"w{i}" for i in range(60)]
    a, near, b = " ".join(words), " ".join([*words, "more"]), " ".join(words[::-1])
    docs = [(None, a), (None, near), (3, b), (3, near + " x"), (2, b + " y"), (None, None)]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in partenum.classes(documents(docs)).collect()), key=str)
    assert got == sorted([(None, 56, 3), (None, 57, 3), (3, 56, 2), (3, 58, 3), (2, 57, 2), (None, 0, None)], key=str)


def test_columns_with_the_names_of_working_columns(spark, documents):
    names = ["__row", "__runs", "__doc", "__row_id", "n_lines"]
    line = " ".join(f"w{i}" for i in range(60))
    docs = documents([(1, f"{line}\nx"), (1, f"y\n{line}"), (None, "z"), (2, line)]).withColumns({n: F.lit(n) for n in names})
    cut = lines.dedup_lines(docs)
    assert {c for c in cut.columns} == {*docs.columns, "n_removed", "removed_words"}
    rows = cut.collect()
    assert all(r[n] == n for r in rows for n in names[:4]) and sum(r["n_removed"] for r in rows) == 2
    kept = partenum.first_of_class(docs).collect()
    assert all(r[n] == n for r in kept for n in names) and len(kept) == 2


def test_similarities_below_the_bound_are_an_error(spark, documents):
    with pytest.raises(ValueError):
        partenum.classes(documents([(1, "a")]), percent=50)
