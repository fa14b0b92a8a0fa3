"""Suggestions read off a column profile: targets, features, date and value columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: name lists of the suggestion rules
ID_ENDINGS = ["id", "uuid", "index", "_id", "number", "no.", "seq", "key", "code", "identifier"]
EXACT_TARGETS = ["deposit", "y", "subscribed", "subscribe", "subscription", "term_deposit"]
TARGET_WORDS = [
    "deposit", "subscribed", "subscribe", "subscription", "term_deposit", "target", "label", "class", "output",
    "result", "prediction", "dependent", "y",
]
VALUE_WORDS = ["price", "sales", "revenue", "profit", "cost", "amount", "score", "rating", "value", "quantity"]
CALENDAR_WORDS = ["day", "month", "year", "week", "weekday", "quarter"]
SALES_NAME = "sales|revenue|amount|profit|price|total|qty"
DATE_NAME = "doc_date|invoice_date|order_date|date"
TIME_NAME = "date|month|time|period"


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _named_like(name: Column, words: list[str]) -> Column:
    return _any([name.endswith(w) | name.contains(f"_{w}") for w in words])


def is_id_like() -> Column:
    """Predicate over profile rows: identifier by name, by all-distinct values or by role."""
    name = F.lower("name")
    by_name = _any([name.endswith(ending) for ending in ID_ENDINGS])
    by_values = (F.col("uniqueCount") == F.col("nonNull")) & (F.col("uniqueCount") > 10) & (F.col("nonNull") > 20)
    return F.coalesce(by_name | by_values | (F.col("role") == "identifier"), F.lit(False))


def mark_id_like(profile: DataFrame) -> DataFrame:
    return profile.withColumn("id_like", is_id_like())


def detect_problem_type(profile: DataFrame) -> DataFrame:
    """``(position, name, problem_type, confidence)`` if the column were the target."""
    unique_share = F.col("uniqueCount") / F.greatest("nonNull", F.lit(1))
    filled = F.col("nonNull") / F.greatest(F.col("nonNull") + F.col("nullCount"), F.lit(1))
    numeric = F.col("role") == "numeric"
    confidence = (
        F.when(numeric & (unique_share > 0.9) & (F.col("uniqueCount") > 10), 70)
        .when(numeric & (filled > 0.8), 90)
        .when(numeric, 60)
        .when(F.col("role").isin("categorical", "boolean"), 85)
        .when((unique_share < 0.3) & (F.col("uniqueCount") <= 20), 75)
        .otherwise(60)
    )
    kind = F.when(numeric, "regression").otherwise("classification")
    return profile.select("position", "name", kind.alias("problem_type"), confidence.alias("confidence"))


def suggest_target(profile: DataFrame) -> DataFrame:
    """The best target as one row ``(name, rule)``; rules in order, table order inside a rule."""
    name = F.lower("name")
    calendar = name.isin(*CALENDAR_WORDS)
    exact = F.array_position(F.array(*[F.lit(w) for w in EXACT_TARGETS]), name)
    free = ~is_id_like() & ~calendar
    few = F.col("role").isin("categorical", "boolean") & (F.col("uniqueCount") <= 5)
    in_order = F.col("position")
    rules = [
        ("exact name", exact > 0, exact),
        ("target-like name", _named_like(name, TARGET_WORDS), in_order),
        ("few categories", free & few, in_order),
        ("value-like name", ~calendar & _named_like(name, VALUE_WORDS), in_order),
        ("last numeric", free & (F.col("role") == "numeric"), -in_order),
    ]
    candidates = profile.select("name", F.inline(F.array(*[
        F.struct(
            F.coalesce(fits, F.lit(False)).alias("fits"), F.lit(rule).alias("rule"), F.lit(rank).alias("rank"),
            place.cast("long").alias("place"),
        )
        for rank, (rule, fits, place) in enumerate(rules)
    ])))
    return candidates.filter("fits").orderBy("rank", "place").limit(1).select("name", "rule")


def suggest_features(profile: DataFrame, target: str) -> DataFrame:
    """``(position, name)`` of usable features: not the target, not id-like, not temporal."""
    usable = (F.col("name") != target) & ~is_id_like() & (F.col("role") != "datetime")
    return profile.filter(usable).select("position", "name")


def pick_series_columns(profile: DataFrame) -> DataFrame:
    """One row ``(target, date)``: the value and date columns a forecast should start from."""
    numeric = F.col("role") == "numeric"
    target_rank = F.when(numeric & F.lower("name").rlike(SALES_NAME), 1).when(numeric, 2)
    temporal = F.col("role") == "datetime"
    date_rank = (
        F.when(temporal & F.lower("name").rlike(DATE_NAME), 1)
        .when(temporal, 2)
        .when(F.lower("name").rlike(TIME_NAME), 3)
    )

    def best(rank: Column) -> Column:
        return F.min_by(F.when(rank.isNotNull(), F.col("name")), F.when(rank.isNotNull(), F.struct(rank, F.col("position"))))

    return profile.agg(best(target_rank).alias("target"), best(date_rank).alias("date"))
