import math

import pytest
from pyspark.sql import functions as F

from tablelens.llm.mixing import mix_sources


@pytest.fixture(scope="module")
def corpus(spark):
    source = F.when(F.col("id") < 6000, "hot").when(F.col("id") < 8000, "b").when(F.col("id") < 8900, "c")
    return spark.range(9000).select(F.col("id").alias("doc_id"), F.lit("x" * 10).alias("text"), source.alias("source"))


def counts(mixed, corpus):
    joined = corpus.join(mixed.groupBy("doc_id").count(), "doc_id", "left").fillna(0, ["count"])
    return {r.source: (r.n, r.mean, r.var) for r in joined.groupBy("source").agg(
        F.count("*").alias("n"), F.avg("count").alias("mean"), F.var_samp("count").alias("var")).collect()}


def test_weights_are_met_with_poisson_counts(corpus):
    mixed = mix_sources(corpus, {"hot": 1.0, "b": 2.0, "c": 1.0})
    for source, (n, mean, variance) in counts(mixed, corpus).items():
        rate = {"hot": 0.25, "b": 0.5, "c": 0.25, None: 0.0}[source] * 9000 / n
        assert mean == pytest.approx(rate, abs=5 * math.sqrt(max(rate, 1e-9) / n))
        assert variance == pytest.approx(rate, rel=0.25, abs=1e-9)


def test_high_rates_are_sums_of_draws(corpus):
    small = corpus.where("source = 'b' OR doc_id < 100")
    mixed = mix_sources(small, {"hot": 1.0}, epochs=1.0)
    (n, mean, variance) = counts(mixed, small)["hot"]
    rate = 2100 / 100
    assert mean == pytest.approx(rate, abs=5 * math.sqrt(rate / n)) and n == 100
    mixed = mix_sources(small, {"hot": 1.0}, epochs=4.0)
    assert counts(mixed, small)["hot"][1] == pytest.approx(84, abs=5)
    assert mixed.where("source = 'b'").count() == 0


def test_the_order_is_a_shuffle_and_repeats(corpus):
    once = [tuple(r) for r in mix_sources(corpus).select("doc_id", "replica", "shuffle_key").collect()]
    again = [tuple(r) for r in mix_sources(corpus.repartition(7)).select("doc_id", "replica", "shuffle_key").collect()]
    assert once == again and [r[2] for r in once] == sorted(r[2] for r in once)
    ranks = [r[0] for r in once]
    mean = sum(ranks[: len(ranks) // 2]) / (len(ranks) // 2)
    assert mean == pytest.approx(sum(ranks) / len(ranks), rel=0.05)


def test_salted_join_gives_the_same_rows(corpus, monkeypatch):
    expected = sorted(map(tuple, mix_sources(corpus).collect()), key=repr)
    monkeypatch.setattr("tablelens.llm.mixing.BROADCAST_SOURCES", 1)
    assert sorted(map(tuple, mix_sources(corpus).collect()), key=repr) == expected


def test_nulls_repeated_rows_and_clashing_names(frame):
    rows = [(1, "abc", None, 5), (1, "abc", None, 5), (None, None, "s", 5), (None, "t", "s", 5)]
    table = frame(rows, "doc_id long, text string, source string, COPIES int")
    mixed = mix_sources(table, epochs=50.0)
    assert mixed.columns == ["doc_id", "text", "source", "replica", "copies", "shuffle_key"]
    same = mixed.where("doc_id = 1").groupBy("replica").count().collect()
    assert same and {r["count"] for r in same} == {2}
    assert mix_sources(table.limit(0)).count() == 0
    assert mix_sources(table.where("text IS NULL")).count() == 0  # nothing to weigh


def test_helper_names_are_free_for_users(frame):
    names = ["known_source", "rate", "parts", "sums", "salt", "own_salt", "source_", "__source", "__sums", "mass"]
    rows = [(i, "some text", "ab"[i % 2], *range(10)) for i in range(40)]
    table = frame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    plain = {(r.doc_id, r.replica) for r in mix_sources(table.select("doc_id", "text", "source"), epochs=3.0).collect()}
    mixed = mix_sources(table, epochs=3.0).collect()
    assert {(r.doc_id, r.replica) for r in mixed} == plain and plain
    assert all([r[n] for n in names] == list(range(10)) for r in mixed)
