"""The exploratory analysis of one table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tablelens.operators.columns import columns_by_role
from tablelens.operators.describe import identifier_like, insights, pair_correlations, top_interactions
from tablelens.operators.distributions import distributions, high_cardinality, missingness_matrix, top_categories
from tablelens.operators.ordering import sample_systematic
from tablelens.operators.summary import summarise
from tablelens.session import small_table


def advanced_eda(df: DataFrame, order_by: Sequence[str], sample: int | None = None) -> dict[str, DataFrame]:
    """Missingness, distributions, categories, interactions and findings, over all rows by default.

    ``sample`` analyses that many evenly spaced rows instead. All sections share one summary of the columns, one
    search for quartiles, one count of distinct values and one fold of pair moments.
    """
    if not df.columns:
        raise ValueError("the dataset must have at least one column")
    table = df if sample is None else sample_systematic(df, sample, order_by)
    spark, summary = df.sparkSession, summarise(table)
    rows = summary.rows if sample is None else df.count()
    if rows == 0:
        raise ValueError("the dataset must hold at least one row")
    # a row per column and per pair of columns: kept small and used by several sections
    known = [tuple(row) for row in identifier_like(table).select("column", "n", "unique", "identifier").collect()]
    pairs = [tuple(row) for row in pair_correlations(table, summary=summary).select("x", "y", "n", "r").collect()]
    pairs = small_table(spark, pairs, "x string, y string, n long, r double")
    flagged = {name for name, _, _, identifier in known if identifier}
    text = columns_by_role(table, "categorical")
    of_text = small_table(
        spark, [(text.index(row[0]), *row) for row in known if row[0] in text],
        "position int, column string, n long, unique long, identifier boolean",
    )
    result = {
        "counts": small_table(spark, [(rows, summary.rows, len(df.columns))], "row_count long, sampled_row_count long, column_count int"),
        "total_missing": small_table(spark, [(sum(summary.missing.values()),)], "total_missing long"),
        "missingness": missingness_matrix(table, order_by, summary=summary),
        "high_cardinality": high_cardinality(table, found=of_text),
        "interactions": top_interactions(table, summary=summary, identifiers=flagged, pairs=pairs),
        "insights": insights(table, summary=summary, pairs=pairs),
    }
    result |= {f"distribution_{name}": frame for name, frame in distributions(table, summary=summary).items()}
    charted = [c for c in text if c not in flagged]
    if charted:
        result["categories"] = top_categories(table, charted)
    return result
