import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablelens.llm import passages as P

FOLDER = "/root/testdata/sf0.01"


def test_passages_and_features():
    texts = pa.array(["", None, "one two", "w " * 200, "A!! " * 64 + "b " * 3])
    n, x = P.encode(texts)
    assert n.tolist() == [1, 1, 1, 4, 2] and x.shape == (9, P.FEATURES) and np.isfinite(x).all()
    assert (x[0] == 0).all() and (x[1] == 0).all()
    alone = P.encode(pa.array(["A!! " * 64 + "b " * 3]))[1]
    assert np.allclose(alone, x[-2:])


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    x, bag, label = rng.normal(size=(9, P.FEATURES)), np.array([0, 0, 1, 1, 1, 2, 3, 3, 3]), np.array([1.0, 0, 1, 0])
    model = P.fit(np.zeros((0, P.FEATURES)), np.zeros(0, int), np.zeros(0), 0.5)

    def loss():
        p = P._s(model.forward(x, bag, 4)["logit"])
        return -np.mean(label * np.log(p) + (1 - label) * np.log(1 - p))

    grads = P._gradients(model, x, bag, label)
    for name, slope in grads.items():
        value = getattr(model, name)
        for at in list(np.ndindex(value.shape))[:: max(1, value.size // 5)]:
            kept = value[at]
            value[at] = kept + 1e-5
            high = loss()
            value[at] = kept - 1e-5
            low = loss()
            value[at] = kept
            assert slope[at] == pytest.approx((high - low) / 2e-5, abs=1e-6), name


def test_attention_finds_the_passage_that_decides():
    rng = np.random.default_rng(1)
    bags, size = 400, 6
    x = rng.normal(size=(bags * size, P.FEATURES))
    label = (rng.random(bags) < 0.5).astype(float)
    x[np.arange(bags) * size + rng.integers(0, size, bags), 0] += 8 * label
    bag = np.repeat(np.arange(bags), size)
    model = P.fit(x, bag, label, 0.5)
    p = P._s(model.forward(model.standard(x), bag, bags)["logit"])
    assert ((p > 0.5) == label).mean() > 0.95


def test_held_out_quality_and_inputs(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = {r.doc_id: r for r in P.quality_scores(docs, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    held = [(rows[i].score, q) for i, q in truth.items() if rows[i].held_out]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    # held-out labels teach nothing
    turned = labels.withColumn("quality", F.when(P.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in P.quality_scores(docs, turned).collect()}
    assert again == {i: r.score for i, r in rows.items()}


def test_odd_rows(frame, spark):
    docs = frame([(1, None, "a"), (1, "", "b"), (None, "word " * 5000, "c"), (2, "x", None), (2, "x", None)], "doc_id long, text string, score string")
    labels = frame([(1, 1), (1, 0), (2, None), (None, 1), (99, 0)], "doc_id long, quality int")
    rows = P.quality_scores(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert P.quality_scores(docs.limit(0), labels.limit(0)).count() == 0


def test_one_long_document_does_not_shut_out_the_others(frame, monkeypatch):
    monkeypatch.setattr(P, "SAMPLE_PASSAGES", 100)
    seen = {}
    monkeypatch.setattr(P, "fit", lambda x, bag, label, share: seen.update(x=x, n=np.bincount(bag), label=label))
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2]
    first = min(ids, key=lambda i: int(P.mixed(np.array([i], np.uint64))[0]))
    docs = [(i, "word " * (64 * 200) if i == first else "some words here") for i in ids]
    P.train(frame(docs, "doc_id long, text string"), frame([(i, i % 2) for i in ids], "doc_id long, quality int"))
    assert len(seen["n"]) == len(ids) and seen["n"].sum() == 100 == len(seen["x"]) and seen["n"].max() == 100 - len(ids) + 1
    assert P.passage_bound(np.array([5, 200, 3]), 18) == 10 and P.passage_bound(np.array([5, 2]), 100) == 5
