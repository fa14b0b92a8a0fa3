import pytest
from pyspark.sql import functions as F

from tablelens.operators import describe as De, distributions as Di
from tablelens.operators.ordering import sample_systematic
from tablelens.operators.summary import summarise
from tablelens.plans.exploration import advanced_eda

TEXT = ([("a",), ("b",), ("",), (None,)] * 5, "t string")
NUMBER = ([(float(i), ) for i in range(20)], "n double")
TIME = ([(f"2024-01-{d:02d}",) for d in range(1, 20)], "d string")


@pytest.fixture
def tables(frame):
    moments = frame(*TIME).select(F.to_timestamp("d").alias("d"))
    empty = frame([], "n double, t string, d timestamp")
    nulls = frame([(None, None)] * 9, "n double, t string")
    flags = frame([(True,), (None,)], "b boolean")
    return {"text": frame(*TEXT), "number": frame(*NUMBER), "time": moments, "empty": empty, "nulls": nulls, "flags": flags}


@pytest.mark.parametrize("kind", ["text", "number", "time", "empty", "nulls", "flags"])
def test_tables_of_a_single_role(tables, kind):
    table = tables[kind]
    names = [c for c, t in table.dtypes if t == "double"]
    filled = bool(names) and kind == "number"
    assert De.describe_numeric(table).count() == (1 if filled else 0)
    assert De.describe_categorical(table).count() == sum(t in ("string", "boolean") for _, t in table.dtypes)
    assert De.outliers_robust(table).count() == len(names)
    assert De.outliers_iqr(table).count() == (1 if filled else 0)
    assert De.skewness_flags(table).count() == (1 if filled else 0)
    assert De.correlations(table).count() == 0 and De.collinear_pairs(table).count() == 0
    assert [tuple(r) for r in De.insights(table).collect()] == [(1, "none", None, None, None)]
    assert De.identifier_like(table).count() == sum(t in ("string", "double", "boolean") for _, t in table.dtypes)
    assert De.top_interactions(table).count() == 0
    parts = Di.distributions(table)
    assert {name: part.count() for name, part in parts.items()} == (
        {"histogram": 12, "kde": 160, "box": 1} if filled else {"histogram": 0, "kde": 0, "box": 0}
    )
    assert Di.missingness_matrix(table, table.columns).columns == ["bucket", "label", "column", "missing_percent"]
    if kind == "empty":
        with pytest.raises(ValueError):
            advanced_eda(table, ["n"])
    else:
        for section in advanced_eda(table, table.columns).values():
            section.collect()


def test_the_summary_is_one_aggregation(frame, spark):
    table = frame([(1.0, "a", None), (float("nan"), "", 2), (4.0, None, 3), (float("inf"), "b", 3)], "x double, t string, i int")
    context = spark.sparkContext
    context.setJobGroup("summary", "")
    found = summarise(table)
    assert len(context.statusTracker().getJobIdsForGroup("summary")) <= 2
    assert found.rows == 4 and found.missing["t"] == 1 and found.missing["i"] == 1
    assert (found.numbers["x"].count, found.numbers["x"].low, found.numbers["x"].high) == (2, 1.0, 4.0)
    assert found.numbers["i"].mean == pytest.approx(8 / 3) and found.varying() == ["x", "i"]
    assert found.quartiles()["i"].median == 3.0 and found.quartiles()["x"].lower_q3 == 1.0


def test_few_jobs(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").withColumn("gap", F.when(F.col("o_orderkey") % 3 == 0, 1.0))
    context, jobs = spark.sparkContext, {}
    for name, run in (
        ("robust", lambda: De.outliers_robust(orders).collect()),
        ("eda", lambda: advanced_eda(orders, ["o_orderkey"])),
    ):
        context.setJobGroup(name, "")
        run()
        jobs[name] = len(context.statusTracker().getJobIdsForGroup(name))
    context.setJobGroup("none", "")
    assert jobs["robust"] <= 11 and jobs["eda"] < 20, jobs  # an aggregation is two jobs


def test_a_shared_summary_gives_the_same_sections(spark):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").limit(3000)
    summary, pairs = summarise(lines), De.pair_correlations(lines)
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(De.outliers_iqr(lines)) == rows(De.outliers_iqr(lines, summary=summary))
    assert rows(De.insights(lines)) == rows(De.insights(lines, summary=summary, pairs=pairs))
    assert rows(De.describe_numeric(lines)) == rows(De.describe_numeric(lines, summary=summary))
    for name, part in Di.distributions(lines).items():
        assert rows(part) == rows(Di.distributions(lines, summary=summary)[name])
    assert sample_systematic(lines, 10, ["l_orderkey"]).count() == 10
