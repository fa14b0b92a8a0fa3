"""Feature preparation fitted on the training rows and saved with the model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tablelens.functions import blank_to_null, quote_name, safe_numeric
from tablelens.operators.columns import TEMPORAL, field_types, is_numeric, long_form, ref
from tablelens.operators.quantiles import medians

MIN_FREQUENCY = 10
MAX_CATEGORIES = 100
RARE = "__infrequent__"
MIN_ROWS = 10
MAX_CLASSES = 10_000


def prepare_training(df: DataFrame, features: Sequence[str], target: str, problem_type: str) -> DataFrame:
    """Rows usable for training: target present (and numeric for regression), features normalised.

    At least 10 rows must remain, and two classes for classification.
    """
    if problem_type not in ("regression", "classification"):
        raise ValueError("problem_type must be 'regression' or 'classification'")
    if not features:
        raise ValueError("no usable features found for training")
    rows = df.dropna(subset=[target])
    if problem_type == "regression":
        rows = rows.withColumn(target, safe_numeric(ref(target), field_types(rows)[target])).dropna(subset=[target])
        found = rows.agg(F.count(F.lit(1)).alias("n")).first()["n"]
        if found < MIN_ROWS:
            raise ValueError(f"regression requires at least {MIN_ROWS} numeric target rows, found {found}")
    else:
        rows = rows.withColumn(target, ref(target).cast("string"))
        facts = rows.agg(
            F.count(F.lit(1)).alias("n"), (F.min(ref(target)) != F.max(ref(target))).alias("mixed")
        ).first()
        if facts["n"] < MIN_ROWS:
            raise ValueError(f"at least {MIN_ROWS} valid rows are required for training, found {facts['n']}")
        if not facts["mixed"]:
            raise ValueError("classification requires at least two target classes")
    return normal_form(rows, features)


def normal_form(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """The table with its feature columns in model input form; other columns untouched."""
    types = field_types(df)
    normal = {}
    for name in features:
        if isinstance(types[name], T.StringType):
            normal[name] = blank_to_null(ref(name))
        elif isinstance(types[name], TEMPORAL):
            normal[name] = F.date_format(ref(name), "yyyy-MM-dd HH:mm:ss")
    return df.withColumns(normal) if normal else df


def encode_labels(df: DataFrame, target: str) -> tuple[DataFrame, list[str]]:
    """Add ``label``: the place of the target text in sorted order; the list decodes it."""
    text = ref(target).cast("string")
    labels = [row[0] for row in df.select(text).distinct().orderBy(text).limit(MAX_CLASSES + 1).collect()]
    if len(labels) > MAX_CLASSES:
        raise ValueError(f"the target has more than {MAX_CLASSES} classes")
    indexer = StringIndexerModel.from_labels(labels, inputCol="__target", outputCol="label", handleInvalid="error")
    return indexer.transform(df.withColumn("__target", ref(target).cast("string"))).drop("__target"), labels


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def fit_preparation(df: DataFrame, features: Sequence[str], output: str = "features") -> PipelineModel:
    """Fit imputation, scaling and one-hot encoding.

    Numeric and boolean features get the median and are standardised by the population
    deviation. Other features get the mode; categories seen fewer than 10 times or beyond
    the 99 most frequent share one "infrequent" category, which also takes values unseen
    at fit. All literals live in the stages, so the result saves and loads as a pipeline.
    """
    types = field_types(df)
    numeric = [n for n in features if is_numeric(types[n]) or isinstance(types[n], T.BooleanType)]
    other = [n for n in features if n not in numeric]
    columns, assembled = [], []
    if numeric:
        numbers = df.select(*[safe_numeric(ref(n), types[n]).alias(n) for n in numeric])
        middle = medians(numbers, numeric)
        filled = [F.coalesce(ref(n), F.lit(middle[n] if middle[n] is not None else 0.0)) for n in numeric]
        row = numbers.agg(
            *[F.avg(f).alias(f"m{i}") for i, f in enumerate(filled)], *[F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(filled)]
        ).first()
        for i, name in enumerate(numeric):
            number = f"try_cast({quote_name(name)} AS DOUBLE)"
            value = f"CASE WHEN NOT isnan({number}) AND abs({number}) < double('Infinity') THEN {number} END"
            fill, mean, spread = middle[name] or 0.0, row[f"m{i}"], row[f"s{i}"] or 1.0
            columns.append(f"(coalesce({value}, {fill!r}D) - {mean!r}D) / {spread!r}D AS __n{i}")
            assembled.append(f"__n{i}")
    vocabularies = []
    if other:
        counts = long_form(df, other).groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
        # the leading values of each column and its missing cells; tasks forward only their own leaders
        place = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("n"), "value"))
        leading = counts.filter("value IS NOT NULL").withColumn("place", place).filter(F.col("place") <= MAX_CATEGORIES + 1)
        gaps = counts.filter("value IS NULL").withColumn("place", F.lit(0))
        found = leading.unionByName(gaps).orderBy("name", "place").collect()
        modes: dict[str, str | None] = {}
        for i, name in enumerate(other):
            present = [r for r in found if r["name"] == name and r["value"] is not None]
            missing = sum(r["n"] for r in found if r["name"] == name and r["value"] is None)
            modes[name] = present[0]["value"] if present else None
            ranked = [
                {"value": r["value"], "n": r["n"] + (missing if at == 0 else 0)} for at, r in enumerate(present)
            ] or [{"value": RARE, "n": missing}]
            kept = [r["value"] for r in ranked if r["n"] >= MIN_FREQUENCY]
            kept = kept[:MAX_CATEGORIES - 1] if len(ranked) > MAX_CATEGORIES else kept
            rare = len(kept) < len(ranked)
            value = f"coalesce(CAST({quote_name(name)} AS STRING), {_text(modes[name] or RARE)})"
            known = ", ".join(_text(v) for v in kept) or _text(RARE)
            columns.append(f"CASE WHEN {value} IN ({known}) THEN {value} ELSE {_text(RARE)} END AS __c{i}")
            vocabularies.append(sorted(kept) + ([RARE] if rare or not kept else []))
    stages = [SQLTransformer(statement=f"SELECT *, {', '.join(columns)} FROM __THIS__")]
    if other:
        inputs = [f"__c{i}" for i in range(len(other))]
        indexed = [f"__i{i}" for i in range(len(other))]
        hot = [f"__h{i}" for i in range(len(other))]
        indexer = StringIndexerModel.from_arrays_of_labels(vocabularies, inputs, outputCols=indexed, handleInvalid="keep")
        encoder = OneHotEncoder(inputCols=indexed, outputCols=hot, dropLast=False)
        # category sizes come from the indexer's column metadata, not from a pass over the data
        stages += [indexer, encoder.fit(indexer.transform(stages[0].transform(df.limit(1))))]
        assembled += hot
    stages.append(VectorAssembler(inputCols=assembled, outputCol=output))
    return PipelineModel(stages)


def split_preparation(pipeline: PipelineModel, features: Sequence[str]) -> tuple[PipelineModel, list[str], PipelineModel]:
    """The stages that turn every feature into one number, the columns of these numbers in feature order, and all later stages."""
    stages = pipeline.stages
    place = 2 if len(stages) > 1 and isinstance(stages[1], StringIndexerModel) else 1
    given = next(stage for stage in stages if isinstance(stage, VectorAssembler)).getInputCols()
    numbers = [c for c in given if c.startswith("__n")]
    # numeric features lead the statement, before any category
    statement = stages[0].getStatement()
    leading = statement[: statement.index(f" AS {numbers[-1]}")] if numbers else ""
    numeric = [name for name in features if f"try_cast({quote_name(name)} AS DOUBLE)" in leading]
    other = [name for name in features if name not in numeric]
    column = {name: f"__n{i}" for i, name in enumerate(numeric)} | {name: f"__i{i}" for i, name in enumerate(other)}
    return PipelineModel(stages[:place]), [column[name] for name in features], PipelineModel(stages[place:])


def feature_names(prepared: DataFrame, output: str = "features") -> list[str]:
    """Names of the assembled vector's slots, from the column metadata."""
    groups = prepared.schema[output].metadata["ml_attr"]["attrs"]
    slots = sorted((slot for group in groups.values() for slot in group), key=lambda slot: slot["idx"])
    return [slot.get("name", str(slot["idx"])) for slot in slots]
