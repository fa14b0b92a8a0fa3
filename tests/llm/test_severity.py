import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablelens.llm import severity as S
from tablelens.llm.features import held_out, terms

FOLDER = "/root/testdata/sf0.1"


def test_terms_are_words_and_beginnings():
    owner, found = terms(pa.array(["Ab abcdef! abcdeg", None, "", "AB"]))
    assert owner.tolist().count(3) == 1 and owner.tolist().count(1) == owner.tolist().count(2) == 0
    per_word = {w: set(terms(pa.array([w]))[1].tolist()) for w in ("ab", "abcdef", "abcdeg")}
    assert len(per_word["abcdef"]) == 3 and len(per_word["abcdef"] & per_word["abcdeg"]) == 2
    assert set(found[owner == 0].tolist()) == set().union(*per_word.values())


def test_thresholds_are_ordered_and_weights_shared():
    rng = np.random.default_rng(4)
    n = 600
    amount = rng.integers(0, 9, n)
    grades = np.where(amount > 5, 2, np.where(amount > 2, 1, 0))
    rows = np.flatnonzero(amount > 0)
    weights, theta = S.fit(rows, np.zeros(len(rows), int), np.log1p(amount[rows]), grades, 1)
    assert weights.shape == (1,) and weights[0] > 0 and theta[0] < theta[1]
    chance = S._s(np.log1p(amount)[:, None] * weights[0] - theta[None, :])
    assert (chance[:, 0] >= chance[:, 1]).all()
    assert np.corrcoef(chance.sum(1), grades)[0, 1] > 0.9


def test_fit_finds_the_optimum():
    rows, columns, values = np.array([0, 1, 2, 3, 4]), np.zeros(5, int), np.ones(5)
    grades = np.array([1, 1, 1, 0, 2, 0, 0, 0, 1, 0])
    weights, theta = S.fit(rows, columns, values, grades, 1, rate=0.0, steps=4000)
    above = (grades[:, None] > np.arange(2)).astype(float)
    p = S._s((np.arange(10) < 5)[:, None] * weights[0] - theta)
    assert np.allclose((p - above).mean(0), 0, atol=1e-4) and abs((p - above)[:5].sum()) < 1e-3


def test_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    scored = S.score_severity(docs, S.train(docs, labels)).join(labels, "doc_id").where(held_out(F.col("doc_id")))
    rate = {r.toxic: r.rate for r in scored.groupBy("toxic").agg(F.avg((F.col("severity") >= S.REJECT).cast("int")).alias("rate")).collect()}
    assert rate[1] > 0.85 and rate[0] < 0.01
    assert scored.where("severity < 0 OR severity > 2 OR p_severe > p_mild").count() == 0


def test_odd_rows(frame):
    docs = frame([(1, None, "a"), (1, "", "b"), (None, "word " * 5000, "c"), (2, "x", None), (2, "x", None)], "doc_id long, text string, severity string")
    labels = frame([(1, 1), (2, None), (None, 1)], "doc_id long, toxic int")
    rows = S.score_severity(docs, S.train(docs, labels)).collect()
    assert len(rows) == 5 and all(0 <= r.severity <= 2 for r in rows) and len(rows[0]) == 5
    assert S.score_severity(docs.limit(0), S.train(docs.limit(0), labels.limit(0))).count() == 0


def test_a_column_called_like_the_helper_stays(frame):
    docs = frame([(1, "some words", "mine", 7)], "doc_id long, text string, above string, __above int")
    labels = frame([(1, 0)], "doc_id long, toxic int")
    row = S.score_severity(docs, S.train(docs, labels)).first()
    assert row["above"] == "mine" and row["__above"] == 7
