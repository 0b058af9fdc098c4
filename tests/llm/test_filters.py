import math
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle
from pyspark.sql import functions as F

import brute
from kohorte.llm import decisions, decontaminate, ebayes, maxent, queries, urlrules

ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "Alpha beta gamma"), (3, None), (4, ""),
         (5, "x"), (6, "one two three four five six seven eight nine ten eleven twelve"), (7, "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10"),
         (10, "a a a a a a a a a a a")]


def hay():
    rng = random.Random(4)
    texts = [None, "", "...", "alpha, BETA-gamma!", "alpha beta", "x", "y x y", "a " * 30, "one " * 12,
             "zero ONE two three four five six seven eight nine ten eleven one two three four five six seven eight nine ten eleven twelve end",
             "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 " * 2, "q1 q2 q3 q4 q5 q6 q7 q8 q9 Q11"]
    pool = " ".join(t or "" for _, t in ITEMS).split() + ["other", "é"]
    for _ in range(60):
        words = []
        while len(words) < 60:
            item = rng.choice([t for _, t in ITEMS if t]).split()
            a = rng.randrange(len(item))
            words += item[a:a + rng.randint(1, 14)] + [rng.choice(pool)] * rng.randint(0, 2)
        texts.append(rng.choice([" ", ", ", "\n"]).join(words))
    return list(enumerate(texts)) + [(3, texts[9])]


@pytest.mark.parametrize("share", [400_000, 14])
def test_contamination_against_all_windows(spark, documents, monkeypatch, share):
    """With one automaton, and with the items cut into several shares."""
    monkeypatch.setattr(decontaminate, "SHARE_WORDS", share)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = hay()[:-1]
    found = decontaminate.find_contamination(documents(docs).withColumn("items", F.lit(1)), items)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["items"])) for r in found.collect()}
    assert got == brute.contaminated(docs, ITEMS)
    assert all(r["n_hit"] == sum(s["last"] - s["first"] + 1 for s in r["spans"]) for r in found.collect())
    clean = {k for k, (_, n, _) in got.items() if not n}
    # Repeated and null ids are rows of their own, and a null item id is an empty one.
    odd = docs[:12] + [(9, docs[9][1]), (9, "nothing"), (None, docs[9][1]), (None, None), (None, "x")]
    unnamed = spark.createDataFrame([*ITEMS, (None, "other"), (None, "q1")], "item_id long, text string")
    rows = decontaminate.find_contamination(documents(odd), unnamed).collect()
    want = brute.contaminated(list(enumerate(t for _, t in odd)), [("" if k is None else k, t) for k, t in ITEMS + [(None, "other"), (None, "q1")]])
    assert sorted(repr((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"]))) for r in rows) == sorted(
        repr((odd[i][0], *v)) for i, v in want.items())
    kept = decontaminate.decontaminate(documents(docs), items)
    assert {r["doc_id"] for r in kept.collect()} == clean and kept.columns == documents(docs).columns


@pytest.mark.parametrize("share", [400_000, 3])
def test_coverage_is_judged_over_all_shares(spark, documents, monkeypatch, share):
    """Two items hit a quarter of a document each: with 40 % allowed it goes, with 60 % it is cut, whatever the shares."""
    monkeypatch.setattr(decontaminate, "SHARE_WORDS", share)
    items = spark.createDataFrame([(1, "a1\ta2\ta3"), (None, "b1,b2,b3")], "item_id long, text string")
    text = "a1 a2 a3 c1 c2 c3 c4 c5 c6 b1 b2 b3"
    docs = documents([(1, text), (1, text), (None, text), (None, "plain"), (2, None), (3, "a1 a2 a3 d d d d d d")]).withColumn("of_row", F.lit("own"))
    strict = decontaminate.decontaminate(docs, items, max_coverage=0.4)
    assert strict.columns == docs.columns
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in strict.collect()))) == sorted(map(repr, [
        (None, "plain"), (2, None), (3, "   d d d d d d")]))
    loose = [(r["doc_id"], r["text"], r["of_row"]) for r in decontaminate.decontaminate(docs, items, max_coverage=0.6).collect()]
    cut = "   c1 c2 c3 c4 c5 c6   "
    assert sorted(map(repr, loose)) == sorted(map(repr, [(k, t, "own") for k, t in [
        (1, cut), (1, cut), (None, cut), (None, "plain"), (2, None), (3, "   d d d d d d")]]))


def test_cutting_spans(spark, documents):
    items = spark.createDataFrame([(7, ITEMS[6][1])], "item_id long, text string")
    text = "Héllo, q1 q2 q3 q4 q5 q6 q7 q8 q9 q10; then " + "more " * 20
    kept = decontaminate.decontaminate(documents([(1, text), (2, ITEMS[6][1]), (3, None)]), items, max_coverage=0.5).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in kept] == [1, 3]
    assert kept[0]["text"] == "Héllo,          ; then " + "more " * 20 and kept[0]["n_chars"] == len(kept[0]["text"])


def test_contamination_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    found = decontaminate.find_contamination(documents([(1, "a b"), (2, None)]), none)
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"]) for r in found.collect()) == [(1, 2, 0), (2, 0, 0)]
    assert decontaminate.find_contamination(documents([]), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


URLS = ["http://a.net/x", "https://EXAMPLE.net/en/1", "http://m.example.net/en", "http://m.example.net/en/", "http://example.com/de/?a#b",
        "http://example.com/den", "http://x.org/fr/1", "http://xorg/fr/", "http://org/fr/x", "ftp://net", "http://net/", "http://net?x/", None, "",
        "no scheme", "a://b://c.net/", "http://evil.net.com/", "http://net.example.net/de/", "http://.net/", "http://a\x01.net/x", "http:///net/",
        "http://a.net:80/x", "\nhttp://b.net/\n"]


def judged(url, rules):
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    cut = min([len(rest), *[rest.find(c) for c in "/?#" if c in rest]])
    host, tail = brute.lower(rest[:cut]), rest[cut:]
    path = tail[:min([len(tail), *[tail.find(c) for c in "?#" if c in tail]])]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[3:] if fits else (None, "allow")))


def test_urls_against_all_rules(spark):
    rng = random.Random(2)
    urls = URLS + [f"http://{rng.choice(['a', 'b', 'm.a'])}.{rng.choice(['net', 'org', 'example.net', 'example.com'])}"
                   f"/{rng.choice(['en', 'de', 'fr', ''])}/{rng.randrange(9)}" for _ in range(200)] + ["http://hot.net/en/"] * 200
    rules = [*queries.URL_RULES, ("a.net", "/en/", "allow"), ("b.net", "/", "allow"), ("b.net", "/", "block"), ("m.a.example.net", "/", "allow")]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(0, urls[0])], "page_id long, url string").withColumn("host", F.lit("own"))
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in
                 urlrules.judge(pages, table).fillna("~").collect())
    want = sorted((i, *[x if x is not None else "~" for x in judged(u, rules)]) for i, u in [*enumerate(urls), (0, urls[0])])
    assert got == want
    assert urlrules.judge(pages.limit(0), table).count() == 0
    assert {r["verdict"] for r in urlrules.judge(pages, table.limit(0)).collect()} == {"allow"}


def test_hosts_with_control_characters_leave_other_verdicts(spark):
    urls = ["http://net\x00/x", "http://a.net/x", "http://net\x01/x", "http://b.net/y", "http://a\x00.net/x", "http://net\x02.net/", "http://z.net/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").coalesce(1)
    table = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"] or "~", r["verdict"]) for r in urlrules.judge(pages, table).collect())
    assert got == [(i, *[x if x is not None else "~" for x in judged(u, queries.URL_RULES)]) for i, u in enumerate(urls)]


TEXTS = [None, "", " \n\t", "one", "a b c a b c", "a a a a a a", "line one\nline one\n\n\nline one", "x # $ % & | < > *", "é ü ß\x0bö\x0cä",
         "w " * 40 + "x y z " * 30, "p q r s\n" * 3 + "t"]


def test_statistics(spark, documents):
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choice("abcdef") * rng.randint(1, 2) for _ in range(rng.randint(0, 80))).replace(" a", "\na") for _ in range(60)]
    docs = list(enumerate(texts)) + [(0, "dup")]
    rows = decisions.statistics(documents(docs).withColumn("n_words", F.lit("own")).drop("n_words"))
    got = sorted((r["doc_id"], *[r[c] for c in brute.statistics("")]) for r in rows.collect())
    assert got == sorted((k, *brute.statistics(t).values()) for k, t in docs)
    assert rows.where("n_repeat_words > 3").count() == sum(brute.statistics(t)["n_repeat_words"] > 3 for _, t in docs)


def corpus(n, seed=0):
    """Clean texts, shouting ones, and toxic ones with one marked word; labels of all."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(600)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(60, 160))]
        kind = i % 5
        if kind == 0:
            words = [w.upper() + "!!" for w in words]
        if kind == 1:
            words.insert(rng.randrange(len(words)), "vile")
        docs.append((i, " ".join(words), "en", f"src{i % 3}", 0))
        labels.append((i, 0 if kind == 0 else 1, 1 if kind == 1 else 0))
    return docs, labels


def test_decision_list_on_held_out_labels(spark, documents):
    docs, labels = corpus(600)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    judged = decisions.judge(documents([*docs, (1000, None, "en", "s", 0), (1001, "", "en", "s", 0)]), table.where("doc_id % 2 = 0"))
    kept = {r["doc_id"]: r["kept"] for r in judged.collect()}
    odd = [r for r in labels if r[0] % 2]
    assert sum(kept[i] == (q == 1) for i, q, _ in odd) >= 0.98 * len(odd)
    assert not kept[1000] and not kept[1001]
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    unlabelled = decisions.judge(documents(docs), table.limit(0)).collect()
    assert all(r["kept"] != r["base_failed"] and r["rule"] is None for r in unlabelled)


def test_classifier_on_held_out_labels(spark, documents, monkeypatch):
    docs, labels = corpus(900, seed=1)
    table = spark.createDataFrame([*labels, (4, 1, 0), (None, 1, 0), (8, None, 0)], "doc_id long, quality int, toxic int")
    strange = [(2000, None, None, None, None), (2001, "", "en", None, 0), (2002, "", None, "src1", 0)]
    monkeypatch.setattr(ebayes, "SHRINK", 1.0)
    monkeypatch.setattr(ebayes, "LEAST_SEEN", 4)
    names = ["logit_low", "n_site", "global_low", "path_low", "host", "path", "own_text", "keep0"]
    given = documents([*docs, *strange]).withColumn("kept", F.lit("own")).withColumns({n: F.lit(n) for n in names})
    result = ebayes.judged(given, table.where("doc_id % 2 = 0 or doc_id is null"), keep=["doc_id", "source", *names])
    assert all(r[n] == n for r in result.limit(5).collect() for n in names)
    kept = {r["doc_id"]: r["kept"] for r in result.collect()}
    assert len(kept) == len(docs) + 3
    odd = [r for r in labels if r[0] % 2]
    good = [kept[i] for i, q, t in odd if q == 1 and not t]
    bad = [kept[i] for i, q, t in odd if q == 0 or t]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.05 * len(bad)
    assert all(r["kept"] for r in ebayes.judged(documents(docs), table.limit(0)).collect())
    assert ebayes.judged(documents([]), table).count() == 0


def test_sites_shrink_toward_their_parents(spark):
    rows = [("a", "x", 3.0, -3.0)] * 200 + [("a", "y", -3.0, -3.0)] * 200 + [("b", "x", -3.0, -3.0)] * 400 + [("c", "x", 3.0, -3.0), (None, None, 0.0, 0.0)]
    logits = spark.createDataFrame(rows, "host string, path string, logit_low double, logit_toxic double")
    found = {(r["host"], r["path"]): r for r in ebayes.site_rates(logits, "host", "path").collect()}
    assert len(found) == 5
    assert found["a", "x"]["path_low"] > 0.9 and found["a", "y"]["path_low"] < 0.1 and found["b", "x"]["path_low"] < 0.1
    sparse = found["c", "x"]
    assert sparse["global_low"] < sparse["path_low"] < 0.95      # one document moves a site part of the way


def plain_posteriors(rows):
    """(doc, host, path, logits by head) -> p by head, by the formulas of the hierarchy written out."""
    prob = lambda x: 1 / (1 + math.exp(-x))
    logit = lambda p: math.log(p / (1 - p))
    clamp = lambda p: min(max(p, 1e-6), 1 - 1e-6)

    def strength(groups, parent):
        n = {g: len(v) for g, v in groups.items()}
        mean = {g: sum(v) / len(v) for g, v in groups.items()}
        total = sum(n.values())
        inner = sum(sum(x * x for x in v) - n[g] * mean[g] ** 2 for g, v in groups.items() if n[g] > 1) / max(sum(k - 1 for k in n.values()), 1)
        outer = max(sum(n[g] * (mean[g] - parent[g]) ** 2 for g in groups) / total - inner * len(groups) / total, 1e-9)
        k = min(max(inner / outer, 1.0), 1e9)
        return {g: (sum(v) + k * parent[g]) / (n[g] + k) for g, v in groups.items()}

    out = {}
    for head in ebayes.HEADS:
        hosts, paths = {}, {}
        for _, host, path, own in rows:
            hosts.setdefault(host, []).append(prob(own[head]))
            paths.setdefault((host, path), []).append(prob(own[head]))
        world = sum(prob(own[head]) for *_, own in rows) / len(rows)
        host_rate = strength(hosts, {h: world for h in hosts})
        path_rate = strength(paths, {g: host_rate[g[0]] for g in paths})
        for key, host, path, own in rows:
            out.setdefault(key, {})[head] = (prob(own[head] + logit(clamp(path_rate[host, path])) - logit(clamp(world))), path_rate[host, path])
    return out


def test_posteriors_against_the_formulas(spark, documents, monkeypatch):
    """Sparse and full sites, null hosts and paths; evidence of a text is the sum of its known features' weights."""
    monkeypatch.setattr(ebayes, "SHRINK", 1.0)
    monkeypatch.setattr(ebayes, "LEAST_SEEN", 4)
    docs, labels = corpus(300, seed=6)
    rng = random.Random(6)
    docs = [(k, t, rng.choice(["en", "de", None]), rng.choice(["big", "big", "big", "low" if i % 5 == 0 else "mid", None, f"s{i}"]), 0)
            for i, (k, t, *_) in enumerate(docs)] + [(900, None, None, None, 0), (901, "", "en", "big", 0)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    given = documents(docs)
    model = ebayes.train(given, table)
    logits = {r["doc_id"]: {h: r[f"logit_{h}"] for h in ebayes.HEADS} for r in ebayes.with_logits(given, model, keep=["doc_id"]).collect()}
    want = plain_posteriors([(k, source, lang, logits[k]) for k, _, lang, source, _ in docs])
    for r in ebayes.judged(given, table).collect():
        for head in ebayes.HEADS:
            p, site = want[r["doc_id"]][head]
            assert r[f"p_{head}"] == pytest.approx(p, abs=1e-9) and r[f"site_{head}"] == pytest.approx(site, abs=1e-9)
        assert r["kept"] == all(want[r["doc_id"]][h][0] <= 0.5 for h in ebayes.HEADS)
    import pyarrow as pa
    texts = [t or "" for _, t, *_ in docs]
    h, at = ebayes.features(pa.array(texts))
    weight = {k: {head: model.weights[head][i] for head in ebayes.HEADS} for i, k in enumerate(model.keys.tolist())}
    found = model.evidence(pa.array(texts))
    for i in range(len(texts)):
        known = {k for k in h[at[i]:at[i + 1]].tolist() if k in weight}
        for head in ebayes.HEADS:
            assert found[head][i] == pytest.approx(min(ebayes.MOST, sum(weight[k][head] for k in known)))


def test_scores_learn_from_the_words_before(spark, documents):
    """Texts keep to one of six vocabularies: held-out texts are likelier than by their words' counts, mixtures of texts are not."""
    rng = random.Random(9)
    kinds = [[f"{c}{i}" for i in range(40)] for c in "abcdef"]
    texts = [[rng.choice(kind[:10] * 4 + kind) for _ in range(80)] for kind in kinds * 120]
    docs = list(enumerate(" ".join(t) for t in texts))
    held = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 1]
    mixed = {}
    for i in held:
        other = next(k for k in range(10_000 + 50 * i, 10_050 + 50 * i) if zlib.crc32(str(k).encode()) % 5 == 1)
        mixed[i] = other
        docs.append((other, " ".join(rng.choice(texts[j])[:9] if (j := rng.choice(held)) >= 0 else "" for _ in range(80))))
    got = {r["doc_id"]: r for r in maxent.score(documents(docs)).collect()}
    gain = [(got[i]["score"] - got[i]["base_score"]) / got[i]["n_tokens"] for i in held]
    loss = [(got[k]["score"] - got[k]["base_score"]) / got[k]["n_tokens"] for k in mixed.values()]
    assert len(held) > 100 and sum(gain) / len(gain) > 0.04 and sum(loss) / len(loss) < -0.2


def test_scores(spark, documents):
    docs, _ = corpus(250, seed=3)
    docs += [(400, None, "en", "s", 0), (401, "", "en", "s", 0), (402, "never seen words here", "en", "s", 0), (403, "Ä " * 300, "en", "s", 0)]
    got = {r["doc_id"]: r for r in maxent.score(documents(docs).withColumn("word", F.lit(1)).withColumn("key", F.lit(1))).collect()}
    tokens = {d[0]: [*brute.words(d[1]), None] for d in docs}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in tokens}
    counts = brute.Counter(w for k, t in tokens.items() if not held[k] for w in t)
    n, v = sum(counts.values()), len(counts)
    assert got.keys() == tokens.keys()
    for k, t in tokens.items():
        r = got[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[k], len(t), sum(counts[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
        assert r["score"] < 0
    assert maxent.score(documents([])).count() == 0
    assert maxent.score(documents([(6, "a b")])).count() == 1


def test_scores_of_repeated_and_null_ids(spark, documents, monkeypatch):
    """Every row by itself, rare words among them; a null id is learned from."""
    monkeypatch.setattr(maxent, "FREQUENT", 20)
    docs, _ = corpus(60, seed=4)
    rows = [(d[0], d[1]) for d in docs] + [(3, docs[3][1]), (3, "a word"), (None, "some words of no id"), (None, None), (None, "some words of no id")]
    got = maxent.score(documents(rows)).collect()
    held = [k is not None and zlib.crc32(str(k).encode()) % 5 == 1 for k, _ in rows]
    tokens = [[*brute.words(t), None] for _, t in rows]
    counts = brute.Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(counts.values()), len(counts)
    base = [sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t) for t in tokens]
    want = [(k, h, len(t), sum(counts[w] > 0 for w in t), round(b, 6)) for (k, _), h, t, b in zip(rows, held, tokens, base)]
    assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 6))) for r in got)


def test_class_factors_add_up_to_one():
    import numpy as np
    rng = np.random.default_rng(0)
    weights = rng.normal(size=(maxent.ROWS, maxent.CLASSES)).astype(np.float32)
    rows = rng.integers(0, maxent.ROWS, (4, 50))
    p = maxent.probabilities(weights, np.zeros(maxent.CLASSES, np.float32), rows)
    assert p.shape == (50, maxent.CLASSES) and np.allclose(p.sum(axis=1), 1, atol=1e-4)
    own = rng.integers(0, maxent.CLASSES, 50)
    assert np.allclose(maxent.log_factor(weights, np.zeros(maxent.CLASSES, np.float32), rows, own), np.log(p[np.arange(50), own]), atol=1e-4)


def test_language_model_is_whole():
    import numpy as np
    h, at = np.arange(10, 16, dtype=np.uint64), np.array([0, 6])
    rows = maxent.histories(h, at)
    for k in (1, 2, 3):      # each of the three words before the last one counts
        other = h.copy()
        other[5 - k] += np.uint64(100)
        assert (maxent.histories(other, at)[:, 5] != rows[:, 5]).any()
    assert len(rows) == 4 and maxent.CLASSES == 64 and maxent.MARKS == 30
    sizes = [maxent.table_rows(n) for n in (0, 1_000_000, 2_000_000, 4_000_000)]
    assert sizes == [1 << 16, 1 << 16, 1 << 17, 1 << 18]
    assert maxent.histories(np.arange(5000, dtype=np.uint64), np.array([0, 5000]), 1 << 18).max() >= 1 << 17


def test_gradients_of_a_minibatch_are_summed_by_row():
    import numpy as np
    rng = np.random.default_rng(1)
    r, error = rng.integers(0, 50, 400), rng.normal(size=(400, maxent.CLASSES)).astype(np.float32)
    one, step, n = maxent.summed(r, error)
    assert one.tolist() == np.unique(r).tolist() and n.sum() == 400
    assert all(np.allclose(s, error[r == k].sum(axis=0), atol=1e-4) for k, s in zip(one, step))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té#", max_size=12), max_size=8))
def test_word_hashes_follow_words(texts):
    import pyarrow as pa

    from kohorte.llm import textops
    h, at = textops.hashed(*textops.flat(pa.array(texts, pa.string())))
    parts = [brute.words(t) for t in texts]
    assert [b - a for a, b in zip(at, at[1:])] == [len(p) for p in parts]
    seen = {}
    for word, value in zip([w for p in parts for w in p], h.tolist()):
        assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)


def test_maxent_holds_little_in_a_task(documents, monkeypatch):
    """Scoring tasks get the weights as a broadcast, not inside their function; texts are cut up part by part, with the same result."""
    import numpy as np
    import pyarrow as pa
    sent, cut, real, whole = [], [], maxent._scores, maxent.tokens

    def scores(*given):
        sent.append(len(cloudpickle.dumps(run := real(*given))))
        return run

    monkeypatch.setattr(maxent, "_scores", scores)
    docs = documents([(i, f"w{i % 7} w{i % 3} c") for i in range(30)])
    assert maxent.score(docs).count() == 30
    assert sent[0] < maxent.ROWS * maxent.CLASSES
    monkeypatch.setattr(maxent, "tokens", lambda texts: cut.append(sum(map(len, texts.to_pylist()))) or whole(texts))
    texts = pa.array([" ".join(f"w{(i * k) % 97}" for k in range(40_000)) for i in range(20)] + ["", "one"])
    nothing = maxent.Lexicon(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.arange(1 << 16) % maxent.RARE)
    target, rows = maxent._targets(nothing, texts, maxent.ROWS)
    assert max(cut) <= maxent.PART and len(cut) > 2
    h, ending, at = whole(texts)
    assert (target == nothing.classify(h, ending, nothing.find(h))).all() and (rows == maxent.histories(h, at, maxent.ROWS)).all()


def test_features_take_little_memory():
    """A slice of texts is turned into features in some 10 bytes a byte; running sums over all bytes took twice as many."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc DE!#\n") for _ in range(2000)) for _ in range(20)]
    h, at = ebayes.features(pa.array(texts + ["", "!A#"]))
    own = [h[a:b][-6:].tolist() for a, b in zip(at, at[1:])]
    for text, shapes in zip(texts + ["", "!A#"], own):
        words, n_bytes = max(len(brute.words(text)), 1), max(len(text), 1)
        capitals, symbols, marks = (sum(c in some for c in text) for some in ("DE" + "A", "#", "!"))
        assert shapes[1:4] == [100 + int(20 * (capitals / n_bytes)), 200 + int(min(20, 10 * (symbols / words))), 300 + int(min(20, 10 * (marks / words)))]
    many = pa.array([" ".join(f"word{k % 1000}" for k in range(500)) for _ in range(1000)])
    size = sum(map(len, many.to_pylist()))
    ebayes.features(many)
    tracemalloc.start()
    ebayes.features(many)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 13 * size and isinstance(h, np.ndarray)


def test_frequent_words_are_found_fast():
    """Looked up by the first bits of their hashes, with the places that a binary search gives, in much less time."""
    import time

    import numpy as np
    rng = np.random.default_rng(2)

    def plain(keys, h):
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, at, -1)

    def best(run):
        times = []
        for _ in range(5):
            start = time.process_time()
            run()
            times.append(time.process_time() - start)
        return min(times)

    for keys in (rng.integers(0, 1 << 64, 1 << 17, dtype=np.uint64), rng.integers(0, 5000, 900, dtype=np.uint64), np.array([7], np.uint64),
                 np.array([(1 << 64) - 1, (1 << 64) - 9], np.uint64)):
        keys = np.unique(keys)
        lexicon = maxent.Lexicon(keys, keys, keys, keys)
        h = np.concatenate([rng.choice(keys, 50_000), rng.integers(0, 1 << 64, 500_000, dtype=np.uint64), np.arange(6000, dtype=np.uint64),
                            np.array([(1 << 64) - 1], np.uint64)])
        assert (lexicon.find(h) == plain(keys, h)).all() and len(lexicon.find(h[:0])) == 0
        if len(keys) > 1 << 16:
            assert best(lambda: lexicon.find(h)) < 0.7 * best(lambda: plain(keys, h))
