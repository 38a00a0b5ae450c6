"""Date profile of the order dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lavra.operators import quality
from lavra.sources.tables import table

WINDOW = (1996, 1998)


def _dated(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").cast("string").alias("d"))


def date_profile(spark: SparkSession, sf: str) -> DataFrame:
    return quality.date_profile(_dated(spark, sf), "d", WINDOW)


def coverage(spark: SparkSession, sf: str) -> DataFrame:
    return quality.coverage_by_year(_dated(spark, sf), "d", WINDOW)


def verdict(spark: SparkSession, sf: str) -> DataFrame:
    d = _dated(spark, sf)
    return quality.quality_verdict(quality.date_profile(d, "d", WINDOW), quality.coverage_by_year(d, "d", WINDOW), WINDOW)


_PROFILE = """
select count(*) n_rows, count(*) n_nonblank, count(d) n_parseable,
  count(*) filter (where year(d) between 1996 and 1998) n_in_window,
  count(*) filter (where year(d) not between 1800 and 2100) n_implausible,
  cast(min(d) as varchar) min_date, cast(max(d) as varchar) max_date,
  cast(min(d) filter (where year(d) between 1996 and 1998) as varchar) min_in_window,
  cast(max(d) filter (where year(d) between 1996 and 1998) as varchar) max_in_window,
  1.0::double availability, round(count(d)::double / count(*), 6) parseable_share,
  round(count(*) filter (where year(d) between 1996 and 1998)::double / count(*), 6) window_share
from (select cast(o_orderdate as date) d from orders)
"""
_COVERAGE = """
select cast(y as integer) "year", cast(sum(k) as bigint) n from (
  select year(cast(o_orderdate as date)) y, 1 k from orders
  union all select unnest(range(1996, 1999)), 0) group by 1
"""

QUERIES = {"q3_date_profile": date_profile, "q4_coverage_by_year": coverage, "q5_quality_verdict": verdict}
ORACLE_SQL = {
    "q3_date_profile": _PROFILE,
    "q4_coverage_by_year": _COVERAGE,
    "q5_quality_verdict": f"""
with p as ({_PROFILE}), c as ({_COVERAGE})
select u usable, u verdict from (
  select bool_and(c.n > 0) and any_value(p.window_share) >= 0.10 and any_value(p.parseable_share) >= 0.50 u
  from p, c where c."year" between 1996 and 1998)
""",
}
