import random

import brute
import corpus_pipeline
from kohorte.llm import ebayes, queries


def test_stages(spark, documents, tmp_path, monkeypatch):
    """Planted cases go at their stage and clean documents stay to the end."""
    monkeypatch.setattr(ebayes, "SHRINK", 1.0)     # some hundred labels here
    monkeypatch.setattr(ebayes, "LEAST_SEEN", 4)
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(900)]

    def text(n=120):
        words = [rng.choice(vocabulary) for _ in range(n)]
        return "\n".join(" ".join(words[i:i + 12]) for i in range(0, n, 12))

    item = " ".join(f"t{i}" for i in range(30))
    clean = [(i, text()) for i in range(300)]
    toxic = [(i, text() + " vile") for i in range(1000, 1060)]
    low = [(i, text().upper().replace(" ", "!! ")) for i in range(2000, 2060)]
    passage = "\n".join(" ".join(rng.choice(vocabulary) for _ in range(20)) for _ in range(4))
    shared = [(3000 + i, f"{text(60)}\n{passage}\n{text(60)}") for i in range(5)]
    base = text(200).replace("\n", " ").split()
    near = []
    for i in range(4):
        copy = list(base)
        copy[i * 40] = f"changed{i}"
        near.append((4000 + i, " ".join(copy)))
    exact = [(5000 + i, clean[0][1]) for i in range(2)]
    leaked = [(6000, text(40) + " " + item), (6001, item)]
    odd = [(7000, None), (7001, ""), (7002, "one")]
    rows = clean + toxic + low + shared + near + exact + leaked + odd
    docs = documents(rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    labels = [(k, 1, 0) for k, _ in clean[::2]] + [(k, 1, 1) for k, _ in toxic[::2]] + [(k, 0, 0) for k, _ in low[::2]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    now, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(str(tmp_path / f"stage-{k}"))
        now = spark.read.parquet(str(tmp_path / f"stage-{k}"))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert now.columns == docs.columns
            assert all(r["text"] is None or r["n_chars"] == len(r["text"]) for r in now.collect())
            kept.append({r["doc_id"]: r["text"] for r in now.collect()})
    graded, cut, single, free = kept
    assert not {k for k, _ in toxic + low} & graded.keys()
    assert {k for k, _ in rows} - {k for k, _ in toxic + low} == graded.keys()
    want = brute.deduped([(k, t) for k, t in graded.items()], 50)
    emptied = {k for k, (t, _, n) in want.items() if n and not t.strip()}
    assert emptied >= {5000, 5001}
    assert cut == {k: want[k][0] if k in want else None for k in graded if k not in emptied}
    assert passage in cut[3000] and all(passage not in cut[3000 + i] for i in range(1, 5))
    classes = brute.components(list(cut.items()))
    assert single == {k: t for k, t in cut.items() if classes[k][1] == k}
    assert 4000 in single and 4001 not in single
    assert single.keys() - free.keys() == {6000, 6001}
    assert {k for k, _ in clean[1:]} <= free.keys()
    assert sorted(tuple(r) for r in now.collect()) == sorted(
        tuple(r) for r in queries.coded(documents(list(free.items()))).collect())
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(tuple(r) for r in now.collect())


def test_stages_lower_arrow_batches(spark, documents, tmp_path):
    """Whole texts go to the workers in batches of at most ``BATCH_ROWS``; a lower limit of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    docs = documents([(1, "a text")])
    try:
        for given, want in (("10000", corpus_pipeline.BATCH_ROWS), ("0", corpus_pipeline.BATCH_ROWS), ("100", 100)):
            spark.conf.set(name, given)
            corpus_pipeline.token_ids(spark, docs, str(tmp_path))
            assert int(spark.conf.get(name)) == want
    finally:
        spark.conf.set(name, before)
