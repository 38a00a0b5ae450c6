"""Readers and writers of the file formats that the jobs exchange."""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lavra.functions.binding import unused
from lavra.sources.ranges import records, scan_csv, scan_json
from lavra.sources.scratch import written

REJECT = "_rejected"
CORPUS = ("fonte", "tipo", "data", "instituicao", "texto_limpido", "na_janela", "data_ausente", "texto_fallback_titulo", "instituicoes_aux")


def read_table_csv(spark: SparkSession, path: str, columns: list[str], sep: str = ",", encoding: str = "UTF-8", order: str | None = None) -> DataFrame:
    """A CSV file with a header, all columns text, quotes doubled inside quotes, line feeds allowed there.

    Files are read by ranges, several tasks a file, as sources.ranges finds where records begin; only files in
    UTF-16 or UTF-32 are read by a task each. Rows of a wrong number of fields carry their text in the
    column REJECT; see split_rejected. Empty lines are no rows. `order` names a column for each row's place in
    the files, one after another by name, which files in UTF-16 and UTF-32 don't give.
    """
    fields = T.StructType([*(T.StructField(c, T.StringType()) for c in columns), T.StructField(REJECT, T.StringType())])
    options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": REJECT}
    if encoding.upper().replace("_", "-").startswith(("UTF-16", "UTF-32", "UTF16", "UTF32")):
        return spark.read.schema(fields).options(header="true", encoding=encoding, enforceSchema="true", **options).csv(path)
    lines = records(spark, path, "\n", scan_csv(sep), encoding=encoding).where("pos > 0").select("place", F.regexp_replace("text", "\r$", "").alias("line"))
    parsed = lines.where("line <> ''").select("place", F.from_csv("line", fields.toDDL(), options).alias("r"))
    return parsed.select("r.*", *([F.col("place").alias(order)] if order else []))


def split_rejected(df: DataFrame, sep: str = ",") -> tuple[DataFrame, DataFrame]:
    """(good, rejected) of what read_table_csv gave: rows with too many fields are rejected, short ones padded with nulls.

    Spark flags both; only flagged rows are counted anew, by their quoted fields. A rejected row has its
    first column and its whole line; Spark reads no line without some column.
    """
    columns = [c for c in df.columns if c != REJECT]
    most = len(columns)

    def fields_in(lines: pd.Series) -> pd.Series:
        return lines.map(lambda x: len(next(csv.reader([x], delimiter=sep), [])), na_action="ignore").astype("Int64")

    count = F.coalesce(F.pandas_udf(fields_in, T.LongType())(F.col(REJECT)), F.lit(0))
    [fields] = unused(df, "_fields")
    counted = df.withColumn(fields, count)
    return counted.where(F.col(fields) <= most).select(*columns), counted.where(F.col(fields) > most).select(columns[0], F.col(REJECT).alias("line"))


def _json_elements(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(elements, files) of JSON files, read by ranges: no file, only its elements, is ever one value.

    elements: (file, pos, place, opener, v), the elements of lists and the members of objects, each as an object of
    one member, of files that are whole and well-formed. files: (file, kind), kind null for those; else the
    type of what a file holds instead, of an object without its members, or `no JSON`. Spark never reads files
    of no bytes: they are in neither.
    """
    found = records(spark, path, ",", scan_json, 1)
    head = F.regexp_extract("text", r"^[\s\ufeff]*(\S?)", 1)
    # Only the first record of a file has its opening bracket, only the last its closing one.
    inner = F.when(F.col("pos") == 0, F.regexp_replace("text", r"^[\s\ufeff]*[\[{]?", "")).otherwise(F.col("text"))
    inner = F.when(F.coalesce("last", F.lit(False)), F.regexp_replace(inner, r"[\]}]\s*$", "")).otherwise(inner)
    opener = F.when(F.col("pos") == 0, head)
    close = F.when(F.col("last") & F.col("ended"), F.regexp_extract("text", r"([\]}])\s*$", 1))
    shaped = written(found.select("file", "pos", "place", opener.alias("opener"), close.alias("close"), inner.alias("inner"), F.when(F.col("pos") == 0, F.try_parse_json("text")).alias("alone")), "elements")
    member = F.try_parse_json(F.concat(F.lit("{"), "inner", F.lit("}")))
    blank = F.trim(F.regexp_replace("inner", r"\s+", " ")) == ""
    judged = shaped.groupBy("file").agg(
        F.max("opener").alias("opener"), F.max("close").alias("close"), F.count(F.lit(1)).alias("n"), F.bool_or(F.try_parse_json("inner").isNull()).alias("no_list"), F.bool_or(member.isNull()).alias("no_object"),
        F.bool_or(blank).alias("blank"), F.max(F.schema_of_variant("alone")).alias("scalar"),
    )
    hollow = (F.col("n") == 1) & F.col("blank")
    is_list = (F.col("opener") == "[") & (F.col("close") == "]") & (~F.col("no_list") | hollow)
    is_object = (F.col("opener") == "{") & (F.col("close") == "}") & (hollow | ~F.col("blank")) & ~F.col("no_object")
    kind = F.when(is_list, "ARRAY").when(is_object, "OBJECT").when(~F.col("opener").isin("[", "{"), F.col("scalar"))
    files = written(judged.select("file", F.coalesce(kind, F.lit("no JSON")).alias("kind")), "judged")
    good = shaped.where(~blank).join(files.where("kind in ('ARRAY', 'OBJECT')"), "file")
    return good.select("file", "pos", "place", "kind", F.when(F.col("kind") == "ARRAY", F.try_parse_json("inner")).otherwise(member).alias("v")), files


def read_items_json(spark: SparkSession, path: str, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(items, errors) of files that each hold one JSON list.

    items: (file, pos, item variant), the objects. errors: (file, pos, kind): other elements with the
    name of their type, and with pos null files that are no list. JSON lines are for spark.read.json.
    Files are read by ranges, so a list may be larger than any value can be. `order` names a column of items
    for their place in the files, one after another by name.
    """
    elements, files = _json_elements(spark, path)
    listed = elements.where("kind = 'ARRAY'").select("file", F.col("pos").cast("int").alias("pos"), "place", F.col("v").alias("item"), F.schema_of_variant("v").alias("kind"))
    is_object = F.col("kind").startswith("OBJECT")
    broken = files.where("kind <> 'ARRAY'").select("file", F.lit(None).cast("int").alias("pos"), "kind")
    return listed.where(is_object).select("file", "pos", *([F.col("place").alias(order)] if order else []), "item"), listed.where(~is_object).select("file", "pos", "kind").unionByName(broken)


def item_fields(items: DataFrame, names: tuple[str, ...] = ("titulo", "data", "url", "texto", "portal", "instituicao")) -> DataFrame:
    """One text column for each name; what an item lacks is null."""
    return items.select(*(c for c in items.columns if c != "item"), *(F.try_variant_get("item", f"$.{n}", "string").alias(n) for n in names))


def read_corpus(spark: SparkSession, path: str, text_col: str = "texto_limpido") -> DataFrame:
    """The corpus file; flags are true where they read `true` in any case. A file without the text column is refused."""
    found = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    if text_col not in found.columns:
        raise ValueError(f"{path} has no column {text_col}")
    columns = [F.coalesce(F.col(c), F.lit("")).alias(c) if c in found.columns else F.lit("").alias(c) for c in CORPUS]
    return found.select(*columns).withColumns({c: F.lower(F.trim(c)) == "true" for c in ("na_janela", "data_ausente", "texto_fallback_titulo")})


def read_crosswalk(spark: SparkSession, path: str) -> DataFrame:
    """Rows (tax_id): the distinct 14-digit ids of a JSON list or object of texts; none where it is malformed. Read by ranges."""
    elements, _ = _json_elements(spark, path)
    members = elements.where("kind = 'OBJECT'").lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("value")
    values = elements.where("kind = 'ARRAY'").select(F.col("v").alias("value")).unionByName(members).select(F.try_variant_get("value", "$", "string").alias("raw"))
    return values.select(F.regexp_replace("raw", r"\D", "").alias("tax_id")).where("char_length(tax_id) = 14").distinct()


def flatten_targets(spark: SparkSession, config_json: DataFrame) -> DataFrame:
    """Rows (instituicao, url_base): the text leaves of nested objects, by their own key.

    config_json has one text column. The subtrees `meta` and `INPI` and top-level texts are left out;
    trailing slashes go. Objects are followed as deep as they go; each level is written before the next.
    """
    level = config_json.select(F.try_parse_json(F.col(config_json.columns[0])).alias("v"))
    leaves = level.select(F.lit("").alias("instituicao"), F.lit("").alias("url_base")).limit(0)
    top = True
    while not (nested := level.where(F.schema_of_variant("v").startswith("OBJECT"))).isEmpty():
        inside = nested.select(F.col("v").alias("node")).lateralJoin(spark.tvf.variant_explode(F.col("node").outer()))
        level = written(inside.select("key", F.col("value").alias("v")).where("key not in ('meta', 'INPI')"), "targets")
        texts = level.where(F.schema_of_variant("v") == "STRING").select(F.col("key").alias("instituicao"), F.regexp_replace(F.try_variant_get("v", "$", "string"), "/+$", "").alias("url_base"))
        leaves, top = leaves if top else leaves.unionByName(texts), False
    return leaves


def write_corpus(df: DataFrame, path: str) -> None:
    """The corpus columns in their order, sorted by type and source, quoted, nulls as empty texts.

    Spark writes no byte order mark. The files in the order of their names are the sorted whole.
    """
    df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in CORPUS)).orderBy("tipo", "fonte").write.option("header", True).option(
        "quote", '"'
    ).option("escape", '"').option("quoteAll", True).option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_report(report: DataFrame, path: str) -> None:
    """One JSON object: the report has one row."""
    report.coalesce(1).write.json(path)


def append_vectors(new: DataFrame, path: str) -> None:
    """Adds rows to a vector table; see operators.vectors.new_chunks for which."""
    new.write.mode("append").parquet(path)


def sniff_header(spark: SparkSession, paths: str, most: int = 262_144) -> DataFrame:
    """Rows (path, encoding, delimiter, columns, truncated) from the first line of each file, at most `most` bytes of it.

    A byte order mark means utf-8-sig, valid UTF-8 utf-8, anything else cp1252. The delimiter is the most
    frequent of `, ; | tab`, in that order on ties, and `;` where there is none. Spark lists the files; a task
    opens those of its part of the list by the file system of their address, and reads one range of each.
    """
    files = spark.read.format("binaryFile").load(paths).select("path")  # without the contents none are read
    kind = "path string, encoding string, delimiter string, columns array<string>, truncated boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                system, name = fs.FileSystem.from_uri(path)
                with system.open_input_file(name) as f:
                    line, end, _ = f.read(most + 1).partition(b"\n")
                truncated = not end and len(line) > most
                line = line[:most]
                encoding = "utf-8-sig" if line.startswith(b"\xef\xbb\xbf") else "utf-8"
                try:
                    text = line.decode(encoding, "ignore" if truncated else "strict")
                except UnicodeDecodeError:
                    encoding, text = "cp1252", line.decode("cp1252", "replace")
                text = text.rstrip("\r")
                delimiter = max(",;|\t", key=text.count) if any(d in text for d in ",;|\t") else ";"
                rows.append({"path": path, "encoding": encoding, "delimiter": delimiter, "columns": [c.strip().strip('"').strip() for c in text.split(delimiter)], "truncated": truncated})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("encoding", pa.string()), ("delimiter", pa.string()), ("columns", pa.list_(pa.string())), ("truncated", pa.bool_())]))

    return files.mapInArrow(run, kind)
