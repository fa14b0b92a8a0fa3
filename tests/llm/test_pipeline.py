import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from compare import duck, normalised
from tablelens.llm.common import written
from tablelens.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, connection, name):
    frame = QUERIES[name](spark, FOLDER)
    result = connection.execute(ORACLES[name])
    expected = normalised([d[0] for d in result.description], result.fetchall())
    assert normalised(frame.columns, [tuple(r) for r in frame.collect()]) == expected


def test_one_query_per_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


def test_stages_keep_the_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality classifier", "n-gram Jaccard join", "mixing sources", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, FOLDER), "stage")
        assert docs.columns == columns and docs.dtypes == before.dtypes and docs.count() > 0
        if name in ("toxicity", "quality classifier"):
            clean = labels.where("quality = 1 AND toxic = 0").join(before, "doc_id").count()
            assert labels.where("quality = 1 AND toxic = 0").join(docs, "doc_id").count() >= 0.97 * clean
        if name != "mixing sources":
            assert docs.exceptAll(before).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert packed.agg(F.countDistinct("doc_id")).first()[0] == docs.select("doc_id").distinct().count()


def test_columns_of_users_come_through_every_stage(spark):
    names = ["severity", "p_mild", "p_severe", "quality_score", "text_key", "turn", "copies", "replica", "shuffle_key", "above", "__source", "kept_id", "class_id"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id < 60")
    docs = docs.select("*", *[F.concat(F.lit(f"{n}-"), F.col("doc_id")).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, FOLDER)
        assert kept.columns == docs.columns
        rows = kept.collect()
        assert rows and all(r[n] == f"{n}-{r.doc_id}" for r in rows for n in names), name


def test_one_row_of_each_class_stays(frame, spark):
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(5, long, "b"), (3, long, "a"), (3, long, "a"), (9, long.replace("w40", "x"), "c"), (8, "alone", None), (1, None, "d"), (2, None, "d"), (None, "no id", "e")]
    table = frame(rows, "doc_id long, text string, source string")
    kept = corpus_pipeline.one_of_each(spark, table, FOLDER)
    assert sorted((r.doc_id or 0 for r in kept.collect())) == [0, 1, 2, 3, 8]


def test_near_copies_without_an_id_or_with_the_same_one_leave_one_row(frame, spark):
    words = [f"w{i}" for i in range(80)]
    long = [" ".join([*words, f"end{k}"]) for k in range(4)]
    rows = [(None, text, "a") for text in long] + [(7, text.replace("w", "v"), "b") for text in long] + [(None, long[0], "c")]
    rows += [(None, long[0].replace("w", "u"), "d"), (4, long[1].replace("w", "u"), "d")]
    kept = corpus_pipeline.one_of_each(spark, frame(rows, "doc_id long, text string, source string"), FOLDER).collect()
    assert sorted((r.doc_id or 0, r.text[0]) for r in kept) == [(0, "w"), (4, "u"), (7, "v")]


def test_run_returns_the_packed_rows(spark):
    result = corpus_pipeline.run(spark, FOLDER)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(result.columns) and result.count() > 0
