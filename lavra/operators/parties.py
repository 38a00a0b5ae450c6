"""Depositors: which belong to the network, under what label, and what they filed."""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lavra.functions.binding import unused
from lavra.functions.text import digits_only, fold_upper
from lavra.operators.rows import first_nonblank, first_nonblanks, project_tolerant
from lavra.sources.scratch import written

CROSSWALK = "crosswalk_cnpj"
#: Up to so many roots are looked for by native functions.
FEW_ROOTS = 16


@functools.lru_cache(8)
def _automaton(roots: tuple[str, ...]):
    """An Aho-Corasick automaton of the roots, each with its first place in the list; built once by a worker."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for place, root in reversed(list(enumerate(roots))):
        if root:
            found.add_word(root, place)
    found.make_automaton()
    return found


def root_of(folded: Column, roots: list[str]) -> Column:
    """The first root, in list order, that the folded name holds; else null. An empty root is in every name.

    A few roots are a native expression. The plan of many would grow with the list: they become an
    automaton that finds all roots in one pass over each distinct name of a batch.
    """
    if len(roots) <= FEW_ROOTS:
        return F.coalesce(*(F.when(F.contains(folded, F.lit(r)), r) for r in roots), F.lit(None).cast("string"))
    listed = tuple(roots)
    empty = listed.index("") if "" in listed else None

    def first(names: pa.Array) -> pa.Array:
        seek = _automaton(listed)
        coded = names.dictionary_encode()
        places = [None if n is None else min((place for _, place in seek.iter(n)), default=empty) for n in coded.dictionary.to_pylist()]
        if empty is not None:
            places = [None if p is None else min(p, empty) for p in places]
        return pa.array([None if p is None else listed[p] for p in places], pa.string()).take(coded.indices)

    return F.arrow_udf(first, T.StringType())(folded)


def filing_number(number: Column) -> Column:
    """The number as text without white space around it: padded numbers are the same filing."""
    return F.regexp_replace(number.cast("string"), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def _numbered(df: DataFrame, number_col: str) -> DataFrame:
    return df.withColumn(number_col, filing_number(F.col(number_col)))


def _or_blank(df: DataFrame, column: str) -> Column:
    return F.col(column) if column in df.columns else F.lit("")


def classify_party(df: DataFrame, name_col: str, tax_col: str, crosswalk: DataFrame, roots: list[str]) -> DataFrame:
    """df with raiz (null outside the network) and rotulo.

    A 14-digit tax id in the crosswalk (tax_id) comes first and labels by its digits; else the first
    root in the folded name, which is then the label. An absent column counts as blank; columns of df stay,
    but for those of the result's names. The planner broadcasts the crosswalk where it is small enough.
    """
    listed, held, digits, folded = unused(df, "listed", "held", "digits", "folded")
    known = crosswalk.select(F.col("tax_id").alias(listed)).distinct().withColumn(held, F.lit(True))
    names = [c for c in df.columns if c.lower() not in ("raiz", "rotulo")]
    # Folded in place: to meet distinct names again, rows would have to be dealt by name, which very many share.
    d = df.withColumns({folded: fold_upper(_or_blank(df, name_col)), digits: digits_only(_or_blank(df, tax_col))})
    d = d.join(known, (F.col(digits) == F.col(listed)) & (F.char_length(digits) == 14), "left")
    root = F.when(F.col(held), CROSSWALK).otherwise(root_of(F.col(folded), roots))
    labelled = F.when(F.col("raiz") == CROSSWALK, F.col(digits)).when(F.col("raiz").isNotNull(), F.col(folded))
    return d.withColumn("raiz", root).withColumn("rotulo", labelled).select(*names, "raiz", "rotulo")


def coverage_by_root(classified: DataFrame, roots: list[str]) -> DataFrame:
    """Rows (raiz, n): matched rows by root, with 0 for roots that none has."""
    all_roots = F.explode(F.array(*map(F.lit, [*roots, CROSSWALK]))).alias("raiz")
    zeros = classified.sparkSession.range(1).select(all_roots, F.lit(0).cast("long").alias("n"))
    counted = classified.where("raiz is not null").groupBy("raiz").agg(F.count(F.lit(1)).alias("n"))
    return counted.unionByName(zeros).groupBy("raiz").agg(F.sum("n").alias("n"))


def match_counts(classified: DataFrame, number_col: str) -> DataFrame:
    """One row (casados, descartados, depositos): matched and other rows, and distinct filings of the matched."""
    hit = F.col("raiz").isNotNull()
    return classified.agg(F.count_if(hit).alias("casados"), F.count_if(~hit).alias("descartados"), F.count_distinct(F.when(hit, filing_number(F.col(number_col)))).alias("depositos"))


def collect_labels(classified: DataFrame, number_col: str, order_col: str) -> DataFrame:
    """Rows (number, instituicoes, ordem): each filing's distinct network labels by first appearance, and the first place.

    A label that comes again is dropped before the shuffle: only the first place of each label travels.
    """
    firsts = _numbered(classified.where("raiz is not null"), number_col).groupBy(number_col, "rotulo").agg(F.min(order_col).alias("_o"))
    by_place = F.array_sort(F.collect_list(F.struct("_o", "rotulo")))
    return firsts.groupBy(number_col).agg(F.transform(by_place, lambda x: x["rotulo"]).alias("instituicoes"), F.min("_o").alias("ordem"))


def restrict_to_network(df: DataFrame, filings: DataFrame, number_col: str) -> DataFrame:
    """Rows of df, their numbers trimmed, whose filing is among filings; broadcast where the planner finds these small enough."""
    return _numbered(df, number_col).join(_numbered(filings, number_col).select(number_col).distinct(), number_col, "left_semi")


def enrich(filings: DataFrame, content: DataFrame, biblio: DataFrame, number_col: str, order_col: str, title: str = "titulo", abstract: str = "resumo", date: str = "data_deposito") -> DataFrame:
    """filings with the first non-blank title, abstract and date of each, each found by itself; empty where there is none."""
    near_content, near_biblio = restrict_to_network(content, filings, number_col), restrict_to_network(biblio, filings, number_col)
    texts = first_nonblanks(near_content, number_col, [title, abstract], [order_col])
    dates = first_nonblank(near_biblio, number_col, date, [order_col], trimmed=True)
    return _numbered(filings, number_col).join(texts, number_col, "left").join(dates, number_col, "left").na.fill("", [title, abstract, date])


def _tolerant(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns, blank where df lacks them; without a filing number no row can be used."""
    kept = df if "numero_inpi" in df.columns else df.limit(0)
    return project_tolerant(kept, ["numero_inpi", "ordem", *columns])


def _read_tables(depositors: DataFrame, content: DataFrame, biblio: DataFrame, crosswalk: DataFrame, roots: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    classified = classify_party(_tolerant(depositors, ["depositante", "cgccpfdepositante"]), "depositante", "cgccpfdepositante", crosswalk, roots)
    return classified, _tolerant(content, ["titulo", "resumo"]), _tolerant(biblio, ["data_deposito"])


def extract_registry(depositors: DataFrame, content: DataFrame, biblio: DataFrame, crosswalk: DataFrame, roots: list[str]) -> DataFrame:
    """The registry job: one row per filing of the network, in order of first appearance.

    Columns: numero_inpi, instituicoes, ordem, titulo, resumo, data_deposito. Inputs have numero_inpi and
    ordem (place in the file); other columns may be absent, and are blank then: without names, tax ids still
    tell the network. Numbers are trimmed. As many rows share a blank number, they are one filing, as in any
    other number.
    """
    classified, texts, dates = _read_tables(depositors, content, biblio, crosswalk, roots)
    filings = written(collect_labels(classified, "numero_inpi", "ordem"), "filings")  # three joins read them
    return enrich(filings, texts, dates, "numero_inpi", "ordem").orderBy("ordem", "numero_inpi")


def registry_report(depositors: DataFrame, filings: DataFrame, rejected: DataFrame, crosswalk: DataFrame, roots: list[str], gate: DataFrame, missing: tuple[str, ...] = (), errors: tuple[str, ...] = ()) -> DataFrame:
    """One row: what the registry job did, and whether its result can be used.

    veredito is `ok` only if the gate (one row with a boolean `usable`; no row counts as refused) was accepted and
    nothing failed, else `pendente`. The other columns: n_registros_csv, n_casados_rede, n_descartados,
    linhas_rejeitadas, cobertura_por_raiz (by root, 0 included), membros_ausentes, fr1_aceito,
    crosswalk_presente, n_cnpj_validos and erro (null without errors).
    """
    classified = classify_party(_tolerant(depositors, ["depositante", "cgccpfdepositante"]), "depositante", "cgccpfdepositante", crosswalk, roots)
    by_root = classified.groupBy("raiz").agg(F.count(F.lit(1)).alias("n"))
    none = depositors.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, [*roots, CROSSWALK]))).alias("raiz"), F.lit(0).cast("long").alias("n"))
    summed = by_root.unionByName(none).groupBy("raiz").agg(F.sum("n").alias("n"))  # a row for each root
    casados = F.coalesce(F.sum(F.when(F.col("raiz").isNotNull(), F.col("n"))), F.lit(0)).alias("n_casados_rede")
    descartados = F.coalesce(F.sum(F.when(F.col("raiz").isNull(), F.col("n"))), F.lit(0)).alias("n_descartados")
    coverage = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("raiz").isNotNull(), F.struct("raiz", "n"))))).alias("cobertura_por_raiz")
    matched = summed.agg(casados, descartados, coverage)
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    ids = crosswalk.select("tax_id").distinct().agg(F.count(F.lit(1)).alias("n_cnpj_validos"))
    accepted = gate.agg(F.coalesce(F.bool_or("usable"), F.lit(False)).alias("fr1_aceito"))
    # One row each.
    whole = n(filings, "n_registros_csv").join(matched).join(n(rejected, "linhas_rejeitadas")).join(ids).join(accepted)
    error = F.lit("; ".join(errors) if errors else None).cast("string")
    return whole.select(
        F.when(F.col("fr1_aceito") & error.isNull(), "ok").otherwise("pendente").alias("veredito"), "n_registros_csv", "n_casados_rede", "n_descartados", "linhas_rejeitadas", "cobertura_por_raiz",
        F.array(*map(F.lit, missing)).cast("array<string>").alias("membros_ausentes"), "fr1_aceito", (F.col("n_cnpj_validos") > 0).alias("crosswalk_presente"), "n_cnpj_validos", error.alias("erro"),
    )
