"""Quality classifier: hierarchical empirical Bayes.

A document classifier, trained on a bounded sample of labelled documents, gives evidence for each text.
Hosts, and paths within hosts, get posteriors from the evidence of their documents, shrunk towards the
level above: sparse sites lean on the global prior, large ones on what they show. A document's final
probability is its own evidence with the posterior of its path, less itself, as the prior.

The classifier reads a text as a few surface counts and as shares of hashed word n-grams.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lavra.llm.text import let, unused
from lavra.sources.scratch import written

#: Labelled documents that the classifier is fitted on, at most: those with the smallest hashes of their ids.
SAMPLE = 20_000
REGULARISATION = 1e-3
ITERATIONS = 25
#: Buckets that words and pairs of neighbouring words are hashed into.
BUCKETS = 512
#: Shares of buckets are small numbers; so much larger, the fit's penalty weighs them against the counts.
BUCKET_SCALE = 10.0
#: Documents of at least this probability are kept.
THRESHOLD = 0.5
#: A level's strength, in documents, stays within these bounds.
STRENGTH = (2.0, 1000.0)
_EDGE = 1e-6

FEATURES = ("log_words", "mean_word", "distinct_share", "log_distinct_gap", "upper_share", "symbol_share", "pipe_share", "bang_share", "empty")


def features(text: Column) -> Column:
    """array<double> of FEATURES, of the whole text; null and blank texts have only `empty`.

    Characters are counted by what is left without them, so a text is read a few times at most and never
    word by word.
    """

    def share(rest: Column) -> Column:
        return (n_chars - F.char_length(rest)) / n_chars

    t = F.coalesce(text, F.lit(""))
    n_chars = F.greatest(F.char_length(t), F.lit(1)).cast("double")
    ws = F.filter(F.split(t, r"[\s\p{Z}]+"), lambda w: w != "")

    def of(w: Column) -> Column:
        n = F.greatest(F.size(w), F.lit(1)).cast("double")
        distinct = F.greatest(F.size(F.array_distinct(w)), F.lit(1)).cast("double")
        return F.array(
            F.log(n), F.char_length(t) / n, F.when(F.size(w) > 0, distinct / n).otherwise(0.0), F.log(n) - F.log(distinct),
            share(F.regexp_replace(t, r"\p{Lu}+", "")), share(F.translate(t, "|!%&*$#@~^<>{}=_+\\", "")),
            share(F.replace(t, F.lit("|"))), share(F.replace(t, F.lit("!!"))), (F.size(w) == 0).cast("double"),
        )

    return let(ws, of)


def word_buckets(text: Column, buckets: int = BUCKETS) -> Column:
    """array<int>: the bucket of every lower-cased word, and of every pair of neighbours."""

    def of(h: Column) -> Column:
        pairs = F.zip_with(h, F.slice(h, F.lit(2), F.greatest(F.size(h) - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull(), F.pmod(F.hash(a, b), F.lit(buckets))))
        return F.concat(F.transform(h, lambda x: F.pmod(x, F.lit(buckets))), F.slice(pairs, F.lit(1), F.greatest(F.size(h) - 1, F.lit(0))))

    ws = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s\p{Z}]+"), lambda w: w != "")
    return let(F.transform(ws, lambda w: F.hash(w)), of)


@dataclass(frozen=True)
class Model:
    """log-odds = intercept + weights . features + the mean weight of the text's buckets, where there are such weights."""

    weights: tuple[float, ...]
    intercept: float
    buckets: tuple[float, ...] = ()

    def evidence(self, text: Column) -> Column:
        """Log-odds of good quality, from the text alone."""
        weighted = F.zip_with(features(text), F.array(*map(F.lit, self.weights)), lambda x, w: x * w)
        counted = F.aggregate(weighted, F.lit(self.intercept), lambda total, x: total + x)
        if not self.buckets:
            return counted
        by_bucket = F.array(*map(F.lit, self.buckets))
        mean = let(
            word_buckets(text, len(self.buckets)),
            lambda bs: F.aggregate(bs, F.lit(0.0), lambda total, b: total + F.get(by_bucket, b)) / F.greatest(F.size(bs), F.lit(1)),
        )
        return counted + mean


def _shares(buckets: Column, size: int) -> Column:
    """array<double>: each bucket's share of a list of buckets."""

    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda b: np.bincount(np.asarray(b, np.int64), minlength=size) / max(1, len(b)))

    return F.pandas_udf(run, "array<double>")(buckets)


def fit(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", buckets: int = BUCKETS, scale: float = BUCKET_SCALE
) -> Model:
    """Logistic regression on at most `sample` labelled documents; without both labels, one that keeps all.

    Labels that are null or not 0 or 1, and ids labelled both ways, are left out.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("l_id")).agg(
        F.min(label_col).alias("low"), F.max(label_col).alias("label")
    ).where("low = label")
    chosen = known.orderBy(F.xxhash64("l_id"), "l_id").limit(sample).select("l_id", F.col("label").cast("double").alias("label"))
    # Of bounded size by `sample`; the texts are joined where they lie. The numbers that remain fit one
    # task, which spares the fit's many small steps a shuffle each.
    rows = docs.select(F.col(id_col).alias("d_id"), F.col(text_col).alias("t")).join(F.broadcast(chosen), F.col("d_id") == F.col("l_id"))
    read = rows.select("label", features(F.col("t")).alias("x"), word_buckets(F.col("t"), buckets).alias("b"))
    train = written(read.select("label", "x", _shares(F.col("b"), buckets).alias("shares")), "training").coalesce(1)
    if train.agg(F.count_distinct("label")).first()[0] < 2:
        return Model((0.0,) * len(FEATURES), 10.0)
    # The counts to unit deviation; the shares as they are, so that the penalty keeps rare buckets small.
    n = len(FEATURES)
    spread = train.agg(*(F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(n)), *(F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(n))).first()
    unit, mid = [spread[f"s{i}"] or 1.0 for i in range(n)], [spread[f"m{i}"] for i in range(n)]
    scaled = F.concat(F.array(*((F.col("x")[i] - mid[i]) / unit[i] for i in range(n))), F.transform("shares", lambda s: s * scale))
    fitted = LogisticRegression(regParam=REGULARISATION, maxIter=ITERATIONS, standardization=False).fit(train.select("label", array_to_vector(scaled).alias("features")))
    w = [float(x) for x in fitted.coefficients]
    weights = tuple(w[i] / unit[i] for i in range(n))
    return Model(weights, float(fitted.intercept) - sum(weights[i] * mid[i] for i in range(n)), tuple(x * scale for x in w[n:]))


def _probability(log_odds: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(log_odds, F.lit(-30.0)), F.lit(30.0))))


def _log_odds(p: Column) -> Column:
    inside = F.least(F.greatest(p, F.lit(_EDGE)), F.lit(1 - _EDGE))
    return F.log(inside / (1 - inside))


def site_sums(docs: DataFrame, model: Model, host_col: str, path_col: str, text_col: str = "text") -> DataFrame:
    """Rows (host, path, n, mass): documents and summed evidence of each path. Null hosts and paths are sites too."""
    return _sums(docs.select(host_col, path_col, model.evidence(F.col(text_col)).alias("evidence")), host_col, path_col, "evidence")


def _sums(scored: DataFrame, host_col: str, path_col: str, evidence: str) -> DataFrame:
    p = _probability(F.col(evidence))
    return scored.select(F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"), p.alias("p")).groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("n"), F.sum("p").alias("mass")
    )


def _strength(levels: DataFrame, mean: float) -> float:
    """Strength of the Beta prior that the spread of site means over binomial noise implies, by moments."""
    row = levels.agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"),
        F.sum(F.col("n") * F.pow(F.col("mass") / F.col("n") - mean, 2)).alias("spread"), F.sum(F.col("n") * F.col("n")).alias("squares"),
    ).first()
    noise = mean * (1 - mean)
    if not row.n or row.k < 2 or noise <= 0:
        return STRENGTH[1]
    between = (row.spread - (row.k - 1) * noise) / (row.n - row.squares / row.n)
    return min(max(noise / between - 1, STRENGTH[0]), STRENGTH[1]) if between > 0 else STRENGTH[1]


def _path_strength(both: DataFrame) -> float:
    """Strength of the prior that a host's mean is for its paths: by the spread of path means around their own host's.

    Each host gives its spread, its binomial noise and its paths less one as degrees of freedom, so that
    what hosts differ by is not counted again.
    """
    mean = F.col("host_mass") / F.col("host_n")
    noise = mean * (1 - mean)
    by_host = both.groupBy("host").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(F.col("mass") / F.col("n") - mean, 2)).alias("spread"),
        (F.max(noise) * (F.count(F.lit(1)) - 1)).alias("expected"), F.max(noise).alias("noise"), F.sum(F.col("n") * F.col("n")).alias("squares"),
    )
    row = by_host.agg(
        F.sum("spread").alias("spread"), F.sum("expected").alias("expected"), F.sum(F.col("n") - F.col("squares") / F.col("n")).alias("size"),
        (F.sum(F.col("n") * F.col("noise")) / F.sum("n")).alias("noise"),
    ).first()
    if not row.size or not row.noise or row.noise <= 0:
        return STRENGTH[1]
    between = (row.spread - row.expected) / row.size
    return min(max(row.noise / between - 1, STRENGTH[0]), STRENGTH[1]) if between > 0 else STRENGTH[1]


def posteriors(sums: DataFrame) -> tuple[DataFrame, float, float, float]:
    """Each path's row with its host's sums, and the global mean and the strengths of both levels."""
    total = sums.agg(F.sum("n").alias("n"), F.sum("mass").alias("mass")).first()
    mean = total.mass / total.n if total.n else 0.5
    hosts = sums.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("mass").alias("host_mass"))
    host_strength = _strength(hosts.select(F.col("host_n").alias("n"), F.col("host_mass").alias("mass")), mean)
    both = sums.join(hosts.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).drop("h")
    return both, mean, host_strength, _path_strength(both)


def score(docs: DataFrame, model: Model, host_col: str = "source", path_col: str = "lang", text_col: str = "text", threshold: float = THRESHOLD, keep_text: bool = True) -> DataFrame:
    """docs (without the text, where asked) with evidence (from the text), site_prior (its path's posterior without it), probability and keep.

    No row is dropped. Texts are read once: rows are written with their evidence, and both grouped sums by
    path and the final join start there. Sums are aggregated before the shuffle; the sites are written, so
    the planner broadcasts them where their measured size allows and otherwise joins by host and path,
    where it splits hot hosts. Columns of the result's names are replaced.
    """
    names = [c for c in docs.columns if c not in ("evidence", "site_prior", "probability", "keep") and (keep_text or c != text_col)]
    e, s, prior = unused(docs, "e", "s", "prior")
    own = written(docs.select(*names, model.evidence(F.col(text_col)).alias(e)), "evidence")
    sums = written(_sums(own, host_col, path_col, e), "sites")
    both, mean, host_strength, path_strength = posteriors(sums)
    sites = written(both, "site-sums").select(F.struct("host", "path", "n", "mass", "host_n", "host_mass").alias(s))
    of = lambda field: F.col(s)[field]
    same = F.col(host_col).cast("string").eqNullSafe(of("host")) & F.col(path_col).cast("string").eqNullSafe(of("path"))
    p = _probability(F.col(e))
    host = (of("host_mass") - p + host_strength * mean) / (of("host_n") - 1 + host_strength)
    path = (of("mass") - p + path_strength * host) / (of("n") - 1 + path_strength)
    prior_shift = math.log(max(mean, _EDGE) / max(1 - mean, _EDGE))
    joined = own.join(sites, same, "left").withColumn(prior, F.round(path, 9))
    final = _probability(F.col(e) + _log_odds(F.col(prior)) - prior_shift)
    return joined.select(
        *names, F.round(e, 9).alias("evidence"), F.col(prior).alias("site_prior"), F.round(final, 9).alias("probability"),
    ).withColumn("keep", F.col("probability") >= threshold)
