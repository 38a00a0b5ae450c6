"""Checks of a text column that should hold dates: profile, coverage by year, verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lavra.functions.dates import WINDOW, is_plausible, parse_iso_strict

MIN_WINDOW_SHARE = 0.10
MIN_PARSEABLE_SHARE = 0.50


def _share(part: Column, whole: Column) -> Column:
    """part / whole to six places; 0 for an empty table."""
    return F.when(whole > 0, F.round(part / whole, 6)).otherwise(F.lit(0.0))


def date_profile(df: DataFrame, column: str, window: tuple[int, int] = WINDOW) -> DataFrame:
    """One row: counts, shares over all rows, and the extremes of the parseable dates.

    Null and blank values count as absent. An empty table gives zeros and null extremes. Extremes
    are ISO strings.
    """
    raw = F.trim(F.coalesce(F.col(column), F.lit("")))
    d = df.select(raw.alias("raw"), parse_iso_strict(raw).alias("d"))
    inside = F.year("d").between(*window)
    counted = d.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("raw") != "").alias("n_nonblank"),
        F.count("d").alias("n_parseable"),
        F.count_if(inside).alias("n_in_window"),
        F.count_if(F.col("d").isNotNull() & ~is_plausible(F.col("d"))).alias("n_implausible"),
        F.min("d").cast("string").alias("min_date"),
        F.max("d").cast("string").alias("max_date"),
        F.min(F.when(inside, F.col("d"))).cast("string").alias("min_in_window"),
        F.max(F.when(inside, F.col("d"))).cast("string").alias("max_in_window"),
    )
    n = F.col("n_rows")
    return counted.select(
        "*",
        _share(F.col("n_nonblank"), n).alias("availability"),
        _share(F.col("n_parseable"), n).alias("parseable_share"),
        _share(F.col("n_in_window"), n).alias("window_share"),
    )


def coverage_by_year(df: DataFrame, column: str, window: tuple[int, int] = WINDOW) -> DataFrame:
    """Rows (year, n) over all parseable dates; years of the window without a date have 0."""
    years = df.select(F.year(parse_iso_strict(F.col(column))).alias("year")).where("year is not null")
    zeros = df.sparkSession.range(window[0], window[1] + 1).select(F.col("id").cast("int").alias("year"))
    return (
        years.groupBy("year").agg(F.count(F.lit(1)).alias("n"))
        .unionByName(zeros.withColumn("n", F.lit(0).cast("long")))
        .groupBy("year").agg(F.sum("n").alias("n"))
    )


def quality_verdict(profile: DataFrame, coverage: DataFrame, window: tuple[int, int] = WINDOW, schema_ok: bool = True) -> DataFrame:
    """One row (usable, verdict): every window year has dates and both shares are high enough."""
    years = coverage.where(F.col("year").between(*window)).agg(
        F.coalesce(F.bool_and(F.col("n") > 0), F.lit(False)).alias("all_years")
    )
    usable = F.col("all_years") & (F.col("window_share") >= MIN_WINDOW_SHARE) & (F.col("parseable_share") >= MIN_PARSEABLE_SHARE)
    return profile.crossJoin(years).select(usable.alias("usable"), (usable & F.lit(schema_ok)).alias("verdict"))
