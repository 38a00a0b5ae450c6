"""Column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lavra.functions import chunking, dates, text, urls, vectors
from lavra.sources.tables import table


def _over(name: str, key: str, /, **columns):
    """A query of the key and some computed columns."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return table(spark, sf, name).select(key, *(c().alias(n) for n, c in columns.items()))

    return run


def _iso():
    return F.date_format("o_orderdate", "yyyy-MM-dd")


def _mixed_dates():
    """Dates as sources write them: by turns ISO with a tail, local, padded and impossible."""
    k = F.col("o_orderkey") % 5
    return (
        F.when(k == 0, F.concat(_iso(), F.lit("T10:00:00Z"))).when(k == 1, F.date_format("o_orderdate", "d/M/yyyy")).when(k == 2, F.concat(F.lit("  "), _iso(), F.lit(" ")))
        .when(k == 3, F.concat(_iso(), F.lit("junk"))).otherwise(F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("-13-40")))
    )


def _feed_dates():
    k = F.col("o_orderkey") % 5
    return (
        F.when(k == 0, F.concat(F.date_format("o_orderdate", "EEE, dd MMM yyyy"), F.lit(" 23:30:00 -0300"))).when(k == 1, F.concat(_iso(), F.lit("T01:00:00.5+05:00")))
        .when(k == 2, F.date_format("o_orderdate", "dd/MM/yyyy HH:mm")).when(k == 3, F.concat(F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" 16h14"))).otherwise("lixo")
    )


def _href():
    """Links as pages write them: by turns relative, rooted, a query, a host without scheme, a fragment and a name alone."""
    k, page = F.col("page_id") % 6, F.col("page_id").cast("string")
    return (
        F.when(k == 0, F.concat(F.lit("../x/"), page, F.lit("/"))).when(k == 1, F.concat(F.lit("/r/./"), page, F.lit("/../s"))).when(k == 2, F.concat(F.lit("?q="), page))
        .when(k == 3, F.concat(F.lit("//Host.Example/p/"), page)).when(k == 4, "#f").otherwise(" item.html ")
    )


_LABELS = lambda: F.concat_ws("|", F.col("source"), F.concat(F.lit("  "), F.col("lang")), F.lit(" "), F.col("source"))
_PARAGRAPHS = lambda: F.replace(F.col("text"), F.lit("\n"), F.lit("\n \n"))


def repair_encoding(spark: SparkSession, sf: str) -> DataFrame:
    data = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    return table(spark, sf, "documents").select("doc_id", text.repair_encoding(data).alias("repaired"))


def l2_normalize(spark: SparkSession, sf: str) -> DataFrame:
    unit = vectors.l2_normalize(F.transform("embedding", lambda x: x.cast("double") * 3))
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(unit).alias("pos", "x")).withColumn("x", F.round("x", 6))


def l2_score(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    other = e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("before"))
    return e.join(other, "vec_id").select("vec_id", F.round(vectors.l2_score(F.col("embedding"), F.col("before")), 6).alias("score"))


QUERIES = {
    "f1_clean_html": _over("pages", "page_id", clean=lambda: text.clean_html(F.col("html"))),
    "f1_clean_html_parser": _over("pages", "page_id", clean=lambda: text.clean_html(F.col("html"), "parser")),
    "f2_collapse_ws": _over("documents", "doc_id", clean=lambda: text.collapse_ws(F.col("text"))),
    "f3_fold_upper": _over("documents", "doc_id", folded=lambda: text.fold_upper(F.col("text"))),
    "f4_digits_only": _over("customer", "c_custkey", digits=lambda: text.digits_only(F.col("c_name")), valid=lambda: text.valid_tax_id(F.concat(F.lit("00.000-"), F.col("c_name")))),
    "f5_normalize_iso": _over("orders", "o_orderkey", iso=lambda: dates.normalize_iso(_mixed_dates())),
    "f6_parse_iso_strict": _over("orders", "o_orderkey", d=lambda: dates.parse_iso_strict(_mixed_dates()).cast("string"), plausible=lambda: dates.is_plausible(dates.parse_iso_strict(_mixed_dates()))),
    "f7_parse_pubdate": _over("orders", "o_orderkey", iso=lambda: dates.parse_pubdate(_feed_dates())),
    "f8_normalize_url": _over("pages", "page_id", normal=lambda: urls.normalize_url(F.col("url"))),
    "f9_resolve_url": _over("pages", "page_id", absolute=lambda: urls.resolve_url(F.col("url"), _href())),
    "f10_item_key": _over("pages", "page_id", key=lambda: urls.item_key(F.when(F.col("page_id") % 2 == 0, F.col("url")), F.concat(F.lit(" T "), F.col("url")), F.lit("Inst"), F.lit(None).cast("string"))),
    "f11_split_institutions": _over("documents", "doc_id", main=lambda: text.main_label(_LABELS()), others=lambda: text.other_labels(_LABELS())),
    "f12_join_title_abstract": _over("part", "p_partkey", joined=lambda: text.join_title_abstract(F.concat(F.lit("<b>"), F.col("p_name"), F.lit("</b>  ")), F.col("p_type"))),
    "f14_split_paragraphs": _over("documents", "doc_id", n=lambda: F.size(chunking.split_paragraphs(_PARAGRAPHS())), joined=lambda: F.array_join(chunking.split_paragraphs(_PARAGRAPHS()), "|")),
    "f16_chunk_key": _over("documents", "doc_id", key=lambda: chunking.chunk_key(F.when(F.col("doc_id") % 3 > 0, F.col("source")), F.col("doc_id"))),
    "f17_repair_encoding": repair_encoding,
    "f18_l2_normalize": l2_normalize,
    "f19_l2_score": l2_score,
}

_URL = r"'^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$'"
_NORMAL = f"""case when coalesce({{0}}, '') = '' then '' else
  case when lower(regexp_extract({{0}}, {_URL}, 1)) in ('', 'http') then 'https' else lower(regexp_extract({{0}}, {_URL}, 1)) end || '://' || lower(regexp_extract({{0}}, {_URL}, 2))
  || rtrim(regexp_replace(regexp_extract({{0}}, {_URL}, 3), ';[^/]*$', ''), '/')
  || case when regexp_extract({{0}}, {_URL}, 4) <> '' then '?' || regexp_extract({{0}}, {_URL}, 4) else '' end
  || case when regexp_extract({{0}}, {_URL}, 5) <> '' then '#' || regexp_extract({{0}}, {_URL}, 5) else '' end end"""
_DAY = "strftime(o_orderdate, '%Y-%m-%d')"
_WS = r"trim(regexp_replace({}, '[\s\p{{Z}}]+', ' ', 'g'))"

ORACLE_SQL = {
    "f1_clean_html": f"""select page_id, {_WS.format("replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&')")} clean from pages""",
    "f2_collapse_ws": f"select doc_id, {_WS.format('text')} clean from documents",
    "f3_fold_upper": "select doc_id, upper(strip_accents(replace(text, 'ß', 'ss'))) folded from documents",
    "f4_digits_only": r"select c_custkey, regexp_replace(c_name, '\D', '', 'g') digits, length(regexp_replace('00.000-' || c_name, '\D', '', 'g')) = 14 valid from customer",
    "f5_normalize_iso": f"select o_orderkey, case when o_orderkey % 5 = 4 then '' else {_DAY} end iso from orders",
    "f6_parse_iso_strict": f"select o_orderkey, case when o_orderkey % 5 in (0, 2) then {_DAY} end d, o_orderkey % 5 in (0, 2) plausible from orders",
    "f7_parse_pubdate": f"select o_orderkey, case when o_orderkey % 5 < 4 then {_DAY} end iso from orders",
    "f8_normalize_url": f"select page_id, {_NORMAL.format('url')} normal from pages",
    "f9_resolve_url": rf"""
with u as (select page_id, lower(regexp_extract(url, {_URL}, 2)) host, regexp_extract(url, {_URL}, 3) path, regexp_extract(url, {_URL}, 4) query from pages),
d as (select *, regexp_replace(path, '[^/]*$', '') dir from u),
r as (select page_id, host, query, case page_id % 6 when 0 then regexp_replace(dir, '[^/]+/$', '') || 'x/' || page_id when 1 then '/r/s' when 5 then dir || 'item.html' else rtrim(regexp_replace(path, ';[^/]*$', ''), '/') end path from d)
select page_id, case when page_id % 6 = 3 then 'https://host.example/p/' || page_id else 'https://' || host || case when path = '' or path[1] = '/' then '' else '/' end || path
  || case when page_id % 6 = 2 then '?q=' || page_id when page_id % 6 = 4 then case when query <> '' then '?' || query else '' end || '#f' else '' end end absolute from r""",
    "f10_item_key": f"select page_id, case when page_id % 2 = 0 then 'url:' || {_NORMAL.format('url')} else 'semurl:' || lower('T ' || url) || '|inst|' end as key from pages",
    "f11_split_institutions": "select doc_id, source main, lang || '|' || source others from documents",
    "f12_join_title_abstract": "select p_partkey, trim(p_name || ' ' || p_type) joined from part",
    "f14_split_paragraphs": r"""
with p as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[\s\p{Z}]+', ' ', 'g'))), lambda x: x <> '') l from documents)
select doc_id, len(l)::int n, coalesce(array_to_string(l, '|'), '') joined from p""",
    "f16_chunk_key": "select doc_id, case when doc_id % 3 > 0 then source else '(sem fonte)' end || '::' || doc_id as key from documents",
    "f17_repair_encoding": "select doc_id, text repaired from documents",
    "f18_l2_normalize": """
with v as (select vec_id, list_transform(embedding, lambda x: x::double * 3) e from embeddings)
select vec_id, (i - 1)::int pos, round(e[i]::double / sqrt(list_sum(list_transform(e, lambda y: y::double * y::double))), 6) x from v, range(1, 65) r(i)""",
    "f19_l2_score": """
select a.vec_id, round(1 - list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: pow(p[1]::double - p[2]::double, 2))), 6) score
from embeddings a join embeddings b on a.vec_id = b.vec_id + 1""",
}
