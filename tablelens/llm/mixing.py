"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from tablelens.llm.infilling import unused
from tablelens.session import small_table

TEMPERATURE = 0.7
SEED = 4
PART_RATE = 32.0  # a higher rate is the sum of several draws
TERMS = 160  # terms of a distribution function; beyond them less than 1e-40 of a rate of 32 is left
BROADCAST_SOURCES = 10_000  # so many sources and their distributions go to every task: at most 15 MB
SALTS = 64  # parts of a source where more sources than that are joined


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts: 52 bits, the same on every engine."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 52)


def source_rates(
    df: DataFrame, source_column: str, text_column: str, weights: Mapping[str, float] | None, temperature: float, epochs: float
) -> DataFrame:
    """``source``, ``mass`` (code points) and ``rate``: the mean copies of a document that give the target weights.

    Without explicit weights a source weighs its mass to the power ``temperature``. Sources without
    mass or weight have rate 0.
    """
    mass = df.groupBy(F.col(f"`{source_column}`").cast("string").alias("source")).agg(
        F.sum(F.length(F.coalesce(F.col(f"`{text_column}`"), F.lit("")))).cast("double").alias("mass")
    )
    if weights is None:
        weighted = mass.withColumn("weight", F.pow("mass", F.lit(temperature)))
    else:
        given = small_table(df.sparkSession, [(k, float(v)) for k, v in weights.items()], "name string, weight double")
        weighted = mass.join(F.broadcast(given), mass["source"].eqNullSafe(given["name"]), "left").drop("name")
        weighted = weighted.withColumn("weight", F.when(F.col("mass") > 0, F.coalesce("weight", F.lit(0.0))).otherwise(0.0))
    totals = weighted.agg(F.sum("weight").alias("weights"), F.sum("mass").alias("masses"))
    share = F.col("weight") / F.col("weights")
    rate = F.when((F.col("mass") > 0) & (F.col("weights") > 0), share * F.lit(epochs) * F.col("masses") / F.col("mass"))
    return weighted.join(F.broadcast(totals)).select("source", "mass", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def _distribution(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... of a Poisson variable."""
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("sums"))

    def more(state: Column, k: Column) -> Column:
        p = state["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(state["sums"], F.array(F.element_at(state["sums"], -1) + p)).alias("sums"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), start, more, lambda state: state["sums"])


def mix_sources(
    df: DataFrame,
    weights: Mapping[str, float] | None = None,
    id_column: str = "doc_id",
    source_column: str = "source",
    text_column: str = "text",
    temperature: float = TEMPERATURE,
    epochs: float = 1.0,
    seed: int = SEED,
) -> DataFrame:
    """Replicate documents so that sources get their target share of the text, then shuffle all copies.

    A source's rate is its target share of ``epochs`` times the corpus over what it has (in code points). Each
    document's count inverts the Poisson distribution of that rate at a uniform number hashed from
    seed and id; documents are exploded by their counts and sorted by a hash of seed, id and
    replica. Only built-in functions are used. The rates, a row per source, are sent to the tasks up to 10,000
    sources; beyond that they are joined on source and one of 64 salts, so a hot source spreads.

    Returns all columns of ``df`` and ``replica`` (from 0), ``copies`` and ``shuffle_key``; earlier columns with those names
    are replaced. A null source is a source of its own; null texts have no length; a row without an id draws by its
    text; repeated rows draw the same count. An empty table gives no rows.
    """
    names = [c for c in df.columns if c.lower() not in ("replica", "copies", "shuffle_key")]
    rates = source_rates(df, source_column, text_column, weights, temperature, epochs)
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / PART_RATE)).cast("int")
    # names that no column of the table has
    own = {name: unused(name, df.columns) for name in ("known_source", "rate", "parts", "sums", "salt", "own_salt")}
    made = {name: F.col(own[name]) for name in own}
    rates = rates.withColumn("parts_", parts).select(
        F.col("source").alias(own["known_source"]), F.col("rate").alias(own["rate"]), F.col("parts_").alias(own["parts"]),
        _distribution(F.col("rate") / F.col("parts_")).alias(own["sums"]),
    )
    rows = df.select(*[F.col(f"`{c}`") for c in names])
    source = F.col(f"`{source_column}`").cast("string")
    if df.select(source.alias("source")).distinct().limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        rows = rows.join(F.broadcast(rates), source.eqNullSafe(made["known_source"]))
    else:
        rates = rates.withColumn(own["salt"], F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn(own["own_salt"], F.pmod(F.xxhash64(F.col(f"`{id_column}`")), F.lit(SALTS)))
        rows = rows.join(rates, source.eqNullSafe(made["known_source"]) & (made["own_salt"] == made["salt"]))
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    name = F.coalesce(F.col(f"`{id_column}`").cast("string"), F.md5(text))

    def draw(part: Column) -> Column:
        # the number is bound as the element of an array: inside the inner lambda it would be hashed anew for every term
        drawn = F.array(uniform(F.lit(str(seed)), name, part.cast("string")))
        return F.element_at(F.transform(drawn, lambda u: F.size(F.filter(made["sums"], lambda least: least <= u))), 1)

    copies = F.aggregate(F.sequence(F.lit(1), made["parts"]), F.lit(0), lambda total, part: total + draw(part))
    rows = rows.withColumn("copies", F.when(made["rate"] > 0, copies).otherwise(0)).where("copies > 0")
    rows = rows.withColumn("replica", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    key = F.md5(F.concat_ws(":", F.lit(f"{seed}-order"), name, F.col("replica").cast("string")))
    rows = rows.withColumn("shuffle_key", F.conv(F.substring(key, 1, 15), 16, 10).cast("long"))
    return rows.select(*[F.col(f"`{c}`") for c in names], "replica", "copies", "shuffle_key").orderBy("shuffle_key", name, "replica")


MIX_SQL = """
WITH mass AS (SELECT source, CAST(sum(length(coalesce(text, ''))) AS DOUBLE) AS mass FROM documents GROUP BY source),
rates AS (
  SELECT source, CASE WHEN mass > 0
    THEN pow(mass, 0.7) / sum(pow(mass, 0.7)) OVER () * sum(mass) OVER () / mass ELSE 0 END AS rate FROM mass),
parts AS (SELECT source, rate, greatest(1, ceil(rate / 32))::INT AS parts FROM rates),
terms AS (
  SELECT source, k, sum(exp(-rate / parts + CASE WHEN k = 0 THEN 0 ELSE k * ln(rate / parts) - lgamma(k + 1) END))
    OVER (PARTITION BY source ORDER BY k) AS least
  FROM parts, range(0, 160) AS t(k) WHERE rate > 0),
sums AS (SELECT source, list(least ORDER BY k) AS sums FROM terms GROUP BY source),
drawn AS (
  SELECT d.*, coalesce(list_sum(list_transform(range(1, parts + 1), lambda p: len(list_filter(sums, lambda x:
    x <= ('0x' || substr(md5('4:' || doc_id || ':' || p), 1, 13))::BIGINT / 4503599627370496.0)))), 0)::INT AS copies
  FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source
    LEFT JOIN sums s ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, text, lang, source, n_chars, copies, replica::INT AS replica,
  ('0x' || substr(md5('4-order:' || doc_id || ':' || replica), 1, 15))::BIGINT AS shuffle_key
FROM (SELECT *, unnest(range(0, copies)) AS replica FROM drawn WHERE copies > 0)
"""
