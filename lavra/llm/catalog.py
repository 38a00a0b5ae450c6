"""Registered queries of this subpackage, each over its whole table, with their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lavra.llm import alignment, audio, bpe, decontaminate, fingerprints, jaccard, linededup, packing, pii, quality, runs, urlfilter, warc
from lavra.llm.text import let
from lavra.sources.scratch import shared_folder, written
from lavra.sources.tables import table

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


def op1_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.compare_edits(table(spark, sf, "documents"))


def op2_packing(spark: SparkSession, sf: str) -> DataFrame:
    with open(WORD_TOKENIZER, encoding="utf-8") as f:
        return packing.pack_documents(table(spark, sf, "documents"), f.read())


def op3_warc(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_folder(spark, "warc")
    warc.write_archive(warc.decide(table(spark, sf, "pages")), path)
    return warc.page_digests(warc.read_archive(spark, path))


def op4_bpe(spark: SparkSession, sf: str) -> DataFrame:
    tokens = bpe.read_ranks(BYTE_RANKS)
    encoded = bpe.encode(table(spark, sf, "documents"), tokens, public_tokenizers.PATTERN)
    return bpe.digests(encoded, tokens)


def op5_pii(spark: SparkSession, sf: str) -> DataFrame:
    new = pii.pseudonymise(table(spark, sf, "documents"))
    return new.select("doc_id", "text", "n_entities", "entity_kinds")


def op6_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.link_documents(table(spark, sf, "documents")).select("doc_id", "class_id", "copy_id", "n_links")


def op7_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    kept = linededup.drop_repeated_passages(table(spark, sf, "documents"))
    return kept.select("doc_id", "text", "removed_chunks", "removed_lines")


def op8_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf, "labels")), keep_text=False)
    return scored.select("doc_id", "source", "lang", "evidence", "site_prior", "probability", "keep")


def op9_audio(spark: SparkSession, sf: str) -> DataFrame:
    return audio.digest(written(audio.store(table(spark, sf, "documents")), "audio"))


def op10_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf, "pages"), urlfilter.rule_table(spark, URL_RULES))


def _some_made_periodic(docs: DataFrame) -> DataFrame:
    """docs, where about one document in ten repeats a stretch of its words from some place to its end, as agreed for op11."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def periodic(ws):
        n, g = F.size(ws), F.col("__g")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        return F.array_join(F.transform(ws, lambda w, i: F.when(i < a, w).otherwise(F.get(ws, (a + F.pmod(i - a, p)).cast("int")))), " ")

    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    made = docs.select("doc_id", "text", h.alias("__h"), F.floor(h / 10).alias("__g"))
    return made.select("doc_id", F.when(F.col("__h") % 10 == 0, let(words, lambda ws: F.when(F.size(ws) > 0, periodic(ws)))).otherwise(F.col("text")).alias("text"))


def op11_runs(spark: SparkSession, sf: str) -> DataFrame:
    found = runs.word_runs(_some_made_periodic(table(spark, sf, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.withColumn("__best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("__best.start")).alias("start"), F.col("__best.length").alias("length"), (-F.col("__best.period")).alias("period"),
        F.floor(1000 * F.col("__best.length") / -F.col("__best.period")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_alignment(spark: SparkSession, sf: str) -> DataFrame:
    with open(BYTE_TOKENIZER, encoding="utf-8") as left, open(PIECE_MODEL, "rb") as right:
        return alignment.align_documents(table(spark, sf, "documents"), left.read(), right.read())


def op13_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    index = decontaminate.build_index(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    found = decontaminate.contamination(index)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


QUERIES: dict = {
    "op1_fingerprints": op1_fingerprints, "op2_packing": op2_packing, "op3_warc": op3_warc, "op4_bpe": op4_bpe,
    "op5_pii": op5_pii, "op6_ngram_jaccard": op6_ngram_jaccard, "op7_line_dedup": op7_line_dedup, "op8_quality": op8_quality, "op9_audio": op9_audio, "op10_url_filter": op10_url_filter,
    "op11_runs": op11_runs, "op12_alignment": op12_alignment, "op13_decontaminate": op13_decontaminate,
}


def _url_filter_sql(rounds: int = 80, damping: float = urlfilter.DAMPING) -> str:
    """So many rounds, written out one after another, are settled well below the operator's tolerance."""
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    lower = "translate(coalesce(regexp_extract({}, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    after = "case when contains({0}, '://') then substring({0}, strpos({0}, '://') + 3) end"
    # Per kind: what its seeds weigh less what links pass on is what hosts without links give back to the seeds.
    steps = [f"r{k} as materialized (select kind, host, sum(x) x from (select kind, host, x * (1 - {damping!r} + {damping!r} * (total - coalesce(passed, 0)) / total) x "
             f"from seeds join totals using (kind) left join (select e.kind, sum(r.x * e.share) passed from r{k - 1} r join edges e on e.kind = r.kind and e.source = r.host group by 1) using (kind) union all "
             f"select e.kind, e.target, r.x * e.share * {damping!r} from r{k - 1} r join edges e on e.kind = r.kind and e.source = r.host) group by all)" for k in range(1, rounds + 1)]
    return f"""
with rules(h, p, v) as (values {rules}),
u as (select page_id, html, {lower.format("rest")} host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') path
      from (select page_id, html, {after.format("url")} rest from pages)),
best as (select host, path, v, h || p rule from (select *, row_number() over (partition by host, path order by length(h || p) desc, length(h) desc, v desc) k
  from (select distinct host, path from u) join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)) where k = 1),
decided as (select host, avg((v = 'block')::int) bad from u join best using (host, path) group by host),
links as (select host source, unnest(regexp_extract_all(coalesce(html, ''), '(?i)href\\s*=\\s*["'']?((?:[a-z][a-z0-9+.-]*:)?//[^"''\\s>]+)', 1)) href from u),
raw as (select source, {lower.format(after.format("href"))} target from (select source, case when starts_with(href, '//') then 'http:' || href else href end href from links)),
counted as (select source, target, count(*) w from raw where source <> target and source <> '' and target <> '' group by all),
edges as (select 'trust' kind, source, target, w / sum(w) over (partition by source) share from counted
  union all select 'distrust', target, source, w / sum(w) over (partition by target) from counted),
seeds as (select 'trust' kind, host, 1 - bad x from decided where bad < 1 union all select 'distrust', host, bad from decided where bad > 0),
totals as (select kind, sum(x) total from seeds group by kind),
r0 as (select * from seeds), {", ".join(steps)},
ranks as (select host, coalesce(sum(x) filter (where kind = 'trust'), 0) t, coalesce(sum(x) filter (where kind = 'distrust'), 0) d from r{rounds} group by host)
select page_id, host, path, rule, coalesce(v, if(round(coalesce(d, 0), 3) >= {urlfilter.THRESHOLD} and round(coalesce(d, 0), 3) > round(coalesce(t, 0), 3), 'block', 'allow')) verdict
from u left join best using (host, path) left join ranks using (host)
"""


ORACLE_SQL: dict[str, str] = {
    # All pairs that share an n-gram, compared exactly, and the closure of the links.
    "op6_ngram_jaccard": r"""
with recursive w as materialized (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\s\p{Z}]+'), lambda x: x <> '') w from documents),
g as materialized (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end g from w),
e as materialized (select doc_id, unnest(g) x from g),
s as materialized (select a.doc_id a, b.doc_id b, count(*) k from e a join e b on a.x = b.x and a.doc_id <> b.doc_id group by all),
l as materialized (select a, b, k = len(ga.g) and k = len(gb.g) same from s join g ga on ga.doc_id = a join g gb on gb.doc_id = b where k >= 0.8 * (len(ga.g) + len(gb.g) - k) - 1e-6
  union all select a.doc_id, b.doc_id, true from g a, g b where len(a.g) = 0 and len(b.g) = 0 and a.doc_id <> b.doc_id),
r(a, b) as (select doc_id, doc_id from documents union select r.a, l.b from r join l on r.b = l.a)
select doc_id, (select min(b) from r where r.a = doc_id) class_id, least(doc_id, (select min(b) from l where l.a = doc_id and same)) copy_id,
  (select count(*) from l where l.a = doc_id) n_links
from documents
""",
    "op10_url_filter": _url_filter_sql(),
    # Every stretch of a text that is as long as a window, looked up among the windows.
    "op13_decontaminate": r"""
with d as materialized (select row_number() over () r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
i as materialized (select item_id, w, least(len(w), 10) n from (select item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark) where len(w) > 0),
windows as materialized (select distinct item_id, n, array_to_string(w[s + 1:s + n], ' ') x from (select *, unnest(range(0, len(w) - n + 1)) s from i)),
places as (select r, p, n, array_to_string(w[p + 1:p + n], ' ') x from (select r, w, n, unnest(range(0, len(w) - n + 1)) p from d, (select distinct n from i) where len(w) >= n)),
hits as materialized (select r, p, n, item_id from places join windows using (n, x)),
words as (select r, count(distinct q) n_hit from (select r, unnest(range(p, p + n)) q from hits) group by r),
items as (select r, count(distinct item_id) n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) l from hits group by r)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(l, '')) items_sha256, n_hit is not null contaminated
from d left join words using (r) left join items using (r)
""",
    "op3_warc": """
with p as (select page_id, encode(coalesce(html, '')) b from pages),
f as (select b, min(page_id) first_page from p group by b),
x as (select page_id, octet_length(b) payload_bytes, unhex(sha1(b)) d, first_page from p join f using (b)),
-- base32: 160 bits, five at a time
y as (select *, list_reduce(list_transform(range(0, 40), lambda i: format('{:04b}', ('0x' || hex(d)[i + 1])::int)), lambda a, c: a || c) bits from x)
select page_id, payload_bytes,
  list_reduce(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
    1 + list_sum(list_transform(range(0, 5), lambda k: bits[5 * i + k + 1]::int * (16 >> k)))::int]), lambda a, c: a || c) payload_digest,
  case when first_page = page_id then 'response' else 'revisit' end record_type,
  case when first_page <> page_id then first_page end refers_to
from y
""",
}
