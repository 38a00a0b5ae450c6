"""File formats: tables written by Spark in a format and read back by the readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lavra.operators import corpus
from lavra.plans import corpus as corpus_plan
from lavra.plans.corpus import WINDOW, news, registry
from lavra.sources import files
from lavra.sources.scratch import shared_folder
from lavra.sources.tables import table

#: Ids that a list takes its elements from.
LIST_IDS = 5000


def _supplier_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers with quotes, separators and line feeds in a field, as Spark writes them with a header in every file."""
    path = shared_folder(spark, "suppliers")
    named = table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("codigo"), F.concat(F.lit('He said "'), F.col("s_name"), F.lit('",\nthen left; ')).alias("nome"), F.col("s_nationkey").cast("string").alias("pais")
    )
    named.write.option("header", True).option("quoteAll", True).option("quote", '"').option("escape", '"').option("ignoreTrailingWhiteSpace", False).csv(path)
    return files.read_table_csv(spark, path, ["codigo", "nome", "pais"])


def table_csv(spark: SparkSession, sf: str) -> DataFrame:
    good, _ = files.split_rejected(_supplier_csv(spark, sf))
    return good


def _uneven(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Lines of which every fifth has a field too many and every seventh one too few."""
    path = shared_folder(spark, "uneven")
    k = F.col("s_suppkey")
    fields = F.concat_ws(",", k.cast("string"), F.concat(F.lit('"'), F.col("s_name"), F.lit(', x"')), F.when(k % 7 > 0, F.col("s_nationkey").cast("string")), F.when(k % 5 == 0, "extra").otherwise(None))
    table(spark, sf, "supplier").select(fields.alias("codigo,nome,pais")).write.option("header", True).option("quote", "").option("escapeQuotes", False).option("sep", "\x01").csv(path)
    return files.split_rejected(files.read_table_csv(spark, path, ["codigo", "nome", "pais"]))


def accepted(spark: SparkSession, sf: str) -> DataFrame:
    return _uneven(spark, sf)[0].select("codigo", "nome", "pais")


def rejected(spark: SparkSession, sf: str) -> DataFrame:
    return _uneven(spark, sf)[1]


def _lists(spark: SparkSession, sf: str) -> str:
    """JSON lists of LIST_IDS events each, user by user: the events, the numbers of some, and a text behind each user's."""
    path = shared_folder(spark, "lists")
    e = table(spark, sf, "events")
    obj = F.to_json(F.struct(F.col("event_id").cast("string").alias("titulo"), F.col("event_type").alias("portal"), F.get_json_object("props", "$.k").alias("texto")))
    element = F.when(F.col("event_id") % 10 == 0, F.col("event_id").cast("string")).otherwise(obj)
    of_user = e.groupBy("user_id", F.floor(F.col("event_id") / LIST_IDS).alias("part")).agg(F.concat(F.array_join(F.collect_list(element), ","), F.lit(',"text"')).alias("value"))
    # Files grow with the events and not with the pairs of a user and a part, of which most have few events.
    lists = of_user.groupBy("part").agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ","), F.lit("]")).alias("value"))
    lists.repartition(16, "part").select("value").write.option("maxRecordsPerFile", 1).text(path)
    return path


def items_read(spark: SparkSession, sf: str) -> DataFrame:
    items, _ = files.read_items_json(spark, _lists(spark, sf))
    return files.item_fields(items).select("titulo", "portal", "texto", F.col("url").isNull().alias("sem_url"))


def item_errors(spark: SparkSession, sf: str) -> DataFrame:
    _, errors = files.read_items_json(spark, _lists(spark, sf))
    return errors.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def crosswalk(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_folder(spark, "crosswalk")
    ids = F.concat(F.lit('"12.345.'), F.lpad(F.col("s_suppkey").cast("string"), 9, "0"), F.when(F.col("s_suppkey") % 4 == 0, "0").otherwise(""), F.lit('"'))
    table(spark, sf, "supplier").groupBy(F.floor(F.col("s_suppkey") / LIST_IDS).alias("g")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(ids), ","), F.lit("]")).alias("value")).repartition(8, "g").select("value").write.option("maxRecordsPerFile", 1).text(path)
    return files.read_crosswalk(spark, path)


def targets(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "supplier")
    inner = F.concat(F.lit('{"'), F.col("s_name"), F.lit('":"https://'), F.lower("s_name"), F.lit('.br//"}'))
    config = n.select(F.concat(F.lit('{"top":"x","meta":{"a":"http://no"},"R":{"deep":'), inner, F.lit(',"INPI":{"b":"http://no"},"n":3}}')).alias("value"))
    return files.flatten_targets(spark, config)


def corpus_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_folder(spark, "corpus")
    files.write_corpus(corpus.build_corpus(registry(spark, sf), news(spark, sf), WINDOW), path)
    return files.read_corpus(spark, path)


def report_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_folder(spark, "report")
    files.write_report(corpus.corpus_report(corpus.build_corpus(registry(spark, sf), news(spark, sf), WINDOW)), path)
    return spark.read.json(path)


def vectors_appended(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_folder(spark, "vectors")
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.size("embedding").alias("size"))
    files.append_vectors(e.where("vec_id % 2 = 0"), path)
    files.append_vectors(e.join(spark.read.parquet(path), "vec_id", "left_anti"), path)
    return spark.read.parquet(path)


def headers(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_folder(spark, "headers")
    table(spark, sf, "orders").select("o_orderkey", "o_orderstatus").repartition(12, "o_orderkey").write.option("header", True).option("sep", ";").csv(path)
    return files.sniff_header(spark, path).select("encoding", "delimiter", F.array_join("columns", ",").alias("columns"), "truncated").distinct()


QUERIES = {
    "s1_read_table_csv": table_csv, "s2_accepted": accepted, "s2_rejected": rejected, "s3_read_items_json": items_read, "s3_item_errors": item_errors, "s4_s7_corpus_file": corpus_round_trip,
    "s5_read_crosswalk": crosswalk, "s6_flatten_targets": targets, "s8_write_report": report_round_trip, "s9_append_vectors": vectors_appended, "q1_sniff_header": headers,
}
ORACLE_SQL = {
    "s4_s7_corpus_file": f"with {corpus_plan._ROWS} select * exclude (ordem) from c",
    "s8_write_report": corpus_plan.ORACLE_SQL["a4_corpus_report"],
    "s1_read_table_csv": """select s_suppkey::varchar codigo, 'He said "' || s_name || '",' || chr(10) || 'then left; ' nome, s_nationkey::varchar pais from supplier""",
    "s2_accepted": """select s_suppkey::varchar codigo, s_name || ', x' nome, case when s_suppkey % 7 > 0 then s_nationkey::varchar when s_suppkey % 5 = 0 then 'extra' end pais from supplier where not (s_suppkey % 5 = 0 and s_suppkey % 7 > 0)""",
    "s2_rejected": """select s_suppkey::varchar codigo, s_suppkey || ',"' || s_name || ', x",' || s_nationkey || ',extra' line from supplier where s_suppkey % 5 = 0 and s_suppkey % 7 > 0""",
    "s3_read_items_json": "select event_id::varchar titulo, event_type portal, regexp_extract(props, '\"k\": ?(\\d+)', 1) texto, true sem_url from events where event_id % 10 > 0",
    "s3_item_errors": f"select 'BIGINT' kind, count(*) n from events where event_id % 10 = 0 union all select 'STRING', count(distinct (user_id, event_id // {LIST_IDS})) from events",
    "s5_read_crosswalk": "select '12345' || lpad(s_suppkey::varchar, 9, '0') tax_id from supplier where s_suppkey % 4 > 0",
    "s6_flatten_targets": "select s_name instituicao, 'https://' || lower(s_name) || '.br' url_base from supplier",
    "s9_append_vectors": "select vec_id, label, len(embedding)::int size from embeddings",
    "q1_sniff_header": "select 'utf-8' encoding, ';' delimiter, 'o_orderkey,o_orderstatus' as columns, false truncated",
}
