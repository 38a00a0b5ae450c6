"""Projections, flags and first-wins rules shared by the jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lavra.functions.dates import WINDOW, year_in_window
from lavra.functions.text import clean_html


def project_tolerant(df: DataFrame, columns: list[str]) -> DataFrame:
    """These columns in this order; those that df lacks are empty texts."""
    return df.select(*(F.col(c) if c in df.columns else F.lit("").alias(c) for c in columns))


def schema_drift(columns: list[str], expected: list[str], df: DataFrame) -> DataFrame:
    """One row (present, absent, extra, schema_ok) on df's session; it is ok when nothing expected is absent."""
    real, want = F.array(*map(F.lit, columns)).cast("array<string>"), F.array(*map(F.lit, expected)).cast("array<string>")
    return df.sparkSession.range(1).select(
        F.array_intersect(want, real).alias("present"), F.array_except(want, real).alias("absent"), F.array_except(real, want).alias("extra"),
    ).withColumn("schema_ok", F.size("absent") == 0)


def flag_window(df: DataFrame, iso_col: str, window: tuple[int, int] = WINDOW) -> DataFrame:
    """df with ano (null without a date) and na_janela."""
    return df.withColumns({"ano": F.year(F.try_to_date(F.col(iso_col), "yyyy-MM-dd")), "na_janela": year_in_window(F.col(iso_col), window)})


def flag_missing(df: DataFrame, date_col: str, text_col: str, title_col: str) -> DataFrame:
    """df with data_ausente, and the text replaced by the title where it is empty, flagged texto_fallback_titulo. No row goes."""
    absent = F.coalesce(F.col(date_col), F.lit("")) == ""
    text = clean_html(F.col(text_col))
    return df.withColumns({
        "data_ausente": absent, "texto_fallback_titulo": text == "", text_col: F.when(text == "", clean_html(F.col(title_col))).otherwise(text),
    })


def exclusion_reason(in_window: Column, text: Column) -> Column:
    """Why a row is no candidate, the first that holds; null for candidates."""
    return F.when(~F.coalesce(in_window, F.lit(False)), "fora_janela").when(F.trim(F.coalesce(text, F.lit(""))) == "", "texto_vazio")


def select_candidates(df: DataFrame, window_col: str = "na_janela", text_col: str = "texto") -> DataFrame:
    """Rows in the window with text."""
    return df.where(exclusion_reason(F.col(window_col), F.col(text_col)).isNull())


def exclusion_counts(df: DataFrame, window_col: str = "na_janela", text_col: str = "texto") -> DataFrame:
    """One row (candidatos, fora_janela, texto_vazio): every row counts once."""
    r = exclusion_reason(F.col(window_col), F.col(text_col))
    return df.agg(F.count_if(r.isNull()).alias("candidatos"), F.count_if(r == "fora_janela").alias("fora_janela"), F.count_if(r == "texto_vazio").alias("texto_vazio"))


def filter_by_name(df: DataFrame, column: str, part: str) -> DataFrame:
    """Rows whose name holds the part, in any case."""
    return df.where(F.contains(F.lower(F.col(column)), F.lit(part.lower())))


def _order(df: DataFrame, order: list[str]) -> Column:
    """The order and then the whole row (maps have none), so that ties have one outcome."""
    return F.struct(*order, F.struct(*(F.col(c) for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind)))


def dedup_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by `order`; rows whose key has an empty or null part are all kept.

    Those rows never meet in a window, however many there are. A key that many rows share is cut to one
    row for each task before the shuffle, by a grouped minimum over the order; of equal places the smallest
    row is first.
    """
    blank = F.lit(False)
    for c in key:
        blank = blank | (F.coalesce(F.col(c).cast("string"), F.lit("")) == "")
    keyed, rest = df.where(~blank), df.where(blank)
    first = keyed.groupBy(*key).agg(F.min_by(F.struct(*df.columns), _order(df, order)).alias("_row"))
    return first.select("_row.*").unionByName(rest)


def last_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by `order`, of equal places the largest row. Null keys are one key."""
    return df.groupBy(*key).agg(F.max_by(F.struct(*df.columns), _order(df, order)).alias("_row")).select("_row.*")


def first_nonblank(df: DataFrame, key: str, column: str, order: list[str], trimmed: bool = False) -> DataFrame:
    """Rows (key, column): each key's first value by `order` that is not blank, of equal places the smallest.

    Empty and `nan` are blank; trimmed values are also blank as `None`, and are returned trimmed.
    """
    return first_nonblanks(df, key, [column], order, trimmed)


def first_nonblanks(df: DataFrame, key: str, columns: list[str], order: list[str], trimmed: bool = False) -> DataFrame:
    """first_nonblank of several columns, each by itself, in one pass; a column that has none for a key is null."""
    firsts, some = [], F.lit(False)
    for column in columns:
        v = F.coalesce(F.col(column), F.lit(""))
        v = F.trim(v) if trimmed else v
        filled = ~(F.lower(v).isin("", "nan", "none") if trimmed else v.isin("", "nan"))
        some = some | filled
        firsts.append(F.min(F.when(filled, F.struct(F.struct(*order).alias("place"), v.alias("value"))))["value"].alias(column))
    return df.where(some).groupBy(key).agg(*firsts)


def merge_items(existing: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key with `estado` (existente or novo): stored rows win, the last of them; of new ones the first.

    Both sides have the same columns. Keys of stored rows drop new rows before anything else is compared.
    Null keys are one key; of equal places the largest stored row and the smallest new one count.
    """
    old = last_wins(existing, [key], [order])
    stored = existing.select(F.col(key).alias("_stored")).distinct()
    new = incoming.join(stored, F.col(key).eqNullSafe(F.col("_stored")), "left_anti")
    new = new.groupBy(key).agg(F.min_by(F.struct(*incoming.columns), _order(incoming, [order])).alias("_row")).select("_row.*")
    return old.withColumn("estado", F.lit("existente")).unionByName(new.withColumn("estado", F.lit("novo")))


def rank_top_k(df: DataFrame, query: str, score: str, key: str, k: int) -> DataFrame:
    """df with `posicao`: the best k of each query by score, ties by key. k of 0 or less gives none."""
    w = Window.partitionBy(query).orderBy(F.col(score).desc(), F.col(key))
    return df.withColumn("posicao", F.row_number().over(w)).where(F.col("posicao") <= max(k, 0))
