"""Quality classifier by hierarchical empirical Bayes.

Three levels of evidence give a document's probability of being good:

1. *Document.* Cheap text metrics are cut into bins; each bin has a log-odds weight learnt from
   the labelled documents by one grouped count (naive Bayes, damped).
2. *Host.* Each host's rate of good documents is a beta posterior around the global rate. Its
   data are the labels of its documents and, at a discount, the document classifier's view of
   the unlabelled ones. The prior's strength comes from the spread between hosts (method of
   moments), so hosts with few documents shrink towards the global rate.
3. *Path.* Likewise below each host, shrinking towards that host's posterior.

The final log-odds are the document's plus the site's shift from the global rate. Everything
that grows is a grouped aggregation with map-side partial sums, so a hot host is a few partial
rows; only the bin table (bounded by the metric table) reaches the driver.

Defined results: a document without words (null or empty text) has probability 0 and is
rejected; a null host or path is a site of its own; without labels every weight is 0 and every
document with words is kept at 0.5. Repeated rows are scored alike; other columns pass through,
as internal names are prefixed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilark.llm.common import count_of, let, saved, small, words

#: metric -> rising bin edges; a value's bin is the number of edges below it
BINS: dict[str, tuple[float, ...]] = {
    "log_words": (3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0),
    "mean_word_chars": (2.5, 3.5, 4.25, 5.0, 6.0, 7.0, 8.0, 10.0),
    "symbols_per_word": (0.001, 0.02, 0.1, 0.3, 0.6, 1.0),
    "exclamations_per_word": (0.001, 0.05, 0.3, 1.0),
    "repeated_neighbours": (0.001, 0.02, 0.1, 0.3, 0.6),
    "distinct_words": (0.05, 0.1, 0.2, 0.4, 0.6, 0.8),
    "stops_per_word": (0.001, 0.01, 0.03, 0.06, 0.1, 0.15, 0.3),
}
#: damping of the summed weights, as the metrics are not independent
DAMPING = 0.7
#: weight of one unlabelled document's probability against one label, in a site's rate
SOFT_WEIGHT = 0.1
#: pseudo-count of each bin and class
SMOOTHING = 1.0
#: most sites that are broadcast; more are joined by shuffle
BROADCAST_SITES = 200_000


@dataclass
class QualityModel:
    weights: dict[tuple[str, int], float]
    prior: float
    sites: DataFrame  # host, path, shift
    host_col: str
    path_col: str


def _bin_of(edges: tuple[float, ...]):
    """Value -> the number of edges below it."""
    def of(x: Column) -> Column:
        return sum(((x > e).cast("int") for e in edges[1:]), (x > edges[0]).cast("int"))

    return of


def text_bins(text: Column) -> Column:
    """A struct with each metric's bin, and ``any`` (the text has a word)."""
    body = F.coalesce(text, F.lit(""))

    def of(ws: Column) -> Column:
        n = F.size(ws)
        per_word = lambda c: F.coalesce(F.try_divide(c, n), F.lit(0.0))
        by_name = {
            "log_words": F.log1p(n),
            "mean_word_chars": per_word(F.length(body) - count_of(body, " \n\t\r\x0b\x0c")),
            "symbols_per_word": per_word(count_of(body, "#*$%&|<>")),
            "exclamations_per_word": per_word(count_of(body, "!")),
            "repeated_neighbours": per_word(F.size(F.filter(
                F.zip_with(ws, F.slice(ws, 2, n), lambda a, b: a == b), lambda same: same))),
            "distinct_words": per_word(F.size(F.array_distinct(ws))),
            "stops_per_word": per_word(count_of(body, ".")),
        }
        bins = [let(v, _bin_of(BINS[k])).alias(k) for k, v in by_name.items()]
        return F.struct((n > 0).alias("any"), *bins)

    return let(words(text), of)


def _evidence(bins: Column, weights: dict[tuple[str, int], float], prior: float) -> Column:
    """The document's log-odds: looked up in one literal array a metric."""
    total = F.lit(prior)
    for metric, edges in BINS.items():
        row = F.array(*(F.lit(float(weights.get((metric, b), 0.0))) for b in range(len(edges) + 1)))
        total = total + F.lit(DAMPING) * F.get(row, bins[metric])
    return total


def _odds(p: float) -> float:
    return math.log(p / (1 - p))


def _strength(n: int, mean: float, spread: float, per_group: float) -> float:
    """Prior strength of a beta whose groups' rates have variance ``spread`` (method of moments)."""
    noise = mean * (1 - mean) / max(per_group, 1.0)
    between = max(spread - noise, 1e-6)
    return min(max(mean * (1 - mean) / between - 1.0, 1.0), 1e4) if n > 1 else 1.0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        host_col: str = "source", path_col: str = "lang", label_col: str = "quality") -> QualityModel:
    """Learn the bin weights and every site's posterior shift. One pass over the texts; the
    per-document bins (a few bytes each) are checkpointed and joined to the labels by id."""
    truth = (labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
             .groupBy(F.col(id_col).alias("q_id")).agg(F.max(F.col(label_col).cast("int")).alias("q_good")))
    rows = docs.select(F.col(id_col).alias("q_id"), F.col(host_col).alias("host"), F.col(path_col).alias("path"),
                       text_bins(F.col(text_col)).alias("bins"))
    rows = saved(rows.join(truth, "q_id", "left").select("host", "path", "bins", "q_good"))

    labelled = rows.filter("q_good is not null and bins.any")
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("m"), F.col("bins")[m].alias("b")) for m in BINS)))
    table = labelled.select("q_good", pairs.alias("x")).groupBy("x.m", "x.b").agg(
        F.sum("q_good").alias("good"), F.count("*").alias("n")).collect()  # one row a metric and bin
    by_metric: dict[str, dict[int, tuple[int, int]]] = {m: {} for m in BINS}
    for r in table:
        by_metric[r["m"]][r["b"]] = (r["good"], r["n"] - r["good"])
    good = max((sum(g for g, _ in v.values()) for v in by_metric.values()), default=0)
    bad = max((sum(b for _, b in v.values()) for v in by_metric.values()), default=0)
    prior = math.log((good + SMOOTHING) / (bad + SMOOTHING)) if good + bad else 0.0
    weights = {}
    for m, v in by_metric.items():
        k = SMOOTHING * (len(BINS[m]) + 1)
        for b, (g, x) in v.items():
            weights[m, b] = (math.log((g + SMOOTHING) / (good + k)) - math.log((x + SMOOTHING) / (bad + k)))

    p = 1 / (1 + F.exp(-_evidence(F.col("bins"), weights, prior)))
    p = F.when(F.col("bins.any"), p).otherwise(0.0)
    seen = F.when(F.col("q_good").isNotNull(), 1.0).otherwise(SOFT_WEIGHT)
    paths = saved(rows.select("host", "path", F.coalesce(F.col("q_good").cast("double"), p).alias("p"), seen.alias("w"))
                  .groupBy("host", "path").agg(F.sum(F.col("w") * F.col("p")).alias("good"), F.sum("w").alias("n")))
    hosts = paths.groupBy("host").agg(F.sum("good").alias("good_h"), F.sum("n").alias("n_h"))

    def moments(df: DataFrame, good: str, n: str) -> tuple[int, float, float, float]:
        r = df.agg(F.count("*").alias("k"), F.sum(good).alias("g"), F.sum(n).alias("n"),
                   F.var_pop(F.col(good) / F.col(n)).alias("v"),
                   (F.count("*") / F.sum(1 / F.col(n))).alias("h")).first()
        if not r["k"]:
            return 0, 0.5, 0.0, 1.0
        return r["k"], min(max(r["g"] / r["n"], 1e-3), 1 - 1e-3), r["v"], r["h"]

    k_h, mean, var_h, per_h = moments(hosts, "good_h", "n_h")
    k_p, _, var_p, per_p = moments(paths, "good", "n")
    s_h, s_p = _strength(k_h, mean, var_h, per_h), _strength(k_p, mean, var_p, per_p)
    hosts = hosts.withColumn("rate_h", (F.lit(s_h * mean) + F.col("good_h")) / (F.lit(s_h) + F.col("n_h")))
    sites = paths.alias("p").join(hosts.alias("h"), F.col("p.host").eqNullSafe(F.col("h.host")), "left").select(
        "p.host", "p.path", ((F.lit(s_p) * F.col("rate_h") + F.col("good")) / (F.lit(s_p) + F.col("n"))).alias("rate"))
    rate = F.least(F.greatest(F.col("rate"), F.lit(1e-3)), F.lit(1 - 1e-3))
    shift = F.log(rate / (1 - rate)) - _odds(mean) if good + bad else F.lit(0.0)
    sites = saved(sites.select("host", "path", shift.alias("shift")))
    return QualityModel(weights, prior, sites, host_col, path_col)


def score(docs: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``q_evidence``, ``q_shift``, ``q_score`` (0 to 1) and ``q_kept``. The site
    table is broadcast when it has at most ``BROADCAST_SITES`` rows, else joined by shuffle."""
    d = docs.withColumn("__q_bins", text_bins(F.col(text_col)))
    sites = small(model.sites, BROADCAST_SITES).select(
        F.col("host").alias("__q_host"), F.col("path").alias("__q_path"), F.col("shift").alias("__q_shift"))
    on = (d[model.host_col].eqNullSafe(sites["__q_host"])) & (d[model.path_col].eqNullSafe(sites["__q_path"]))
    evidence = _evidence(F.col("__q_bins"), model.weights, model.prior)
    shift = F.coalesce(F.col("__q_shift"), F.lit(0.0))
    p = F.when(F.col("__q_bins.any"), 1 / (1 + F.exp(-(evidence + shift)))).otherwise(0.0)
    keep = [F.col(f"`{c}`") for c in docs.columns]
    return d.join(sites, on, "left").select(
        *keep, evidence.alias("__q_evidence"), shift.alias("__q_moved"), p.alias("__q_p")).select(
        *keep, F.col("__q_evidence").alias("__q_e"), "__q_moved", "__q_p", (F.col("__q_p") >= threshold).alias("__q_kept"))


def quality_classifier(docs: DataFrame, labels: DataFrame, **names: str) -> DataFrame:
    """doc_id, evidence, site_shift, score and kept for every row of ``docs``."""
    scored = score(docs, fit(docs, labels, **names), names.get("text_col", "text"))
    return scored.select(F.col(names.get("id_col", "doc_id")), F.col("__q_e").alias("evidence"),
                         F.col("__q_moved").alias("site_shift"), F.col("__q_p").alias("score"),
                         F.col("__q_kept").alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, **names: str) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, columns unchanged."""
    scored = score(docs, fit(docs, labels, **names), names.get("text_col", "text"))
    return scored.filter("__q_kept").select(*(F.col(f"`{c}`") for c in docs.columns))
