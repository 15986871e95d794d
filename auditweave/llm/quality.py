"""Document quality by hierarchical empirical Bayes: a text classifier with host and path posteriors."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditweave.llm.base import map_texts
from auditweave.llm.toxicity import logistic
from auditweave.plans.joins import stored

#: Labelled rows that the classifier is fitted on, about, for each label.
SAMPLE_ROWS = 8_000
THRESHOLD = 0.5
#: Bounds of the strength of a prior, in documents.
STRENGTH = (1.0, 10_000.0)
FEATURES = 12
_CLASS = np.full(256, 5)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[[*range(65, 91)]] = 1
_CLASS[[*range(97, 123), *range(128, 256)]] = 2
_CLASS[[*range(48, 58)]] = 3
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 4


def text_features(text: str | None) -> list[float]:
    """Shares of character classes, lengths and repetition of a whole text; zeros for null and empty texts."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return [0.0] * FEATURES
    space, upper, lower, digit, mark, other = np.bincount(_CLASS[np.frombuffer(data, dtype=np.uint8)], minlength=6) / len(data)
    words = data.split()
    count = max(1, len(words))
    lines = [line for line in data.split(b"\n") if line.strip()]
    odd = sum(not w[-1:].isalnum() and w[-1:] not in b".,;:!?'\")" and w[-1] < 128 for w in words)
    return [
        float(np.log1p(len(data))), float(space), float(upper), float(lower), float(digit), float(mark), float(other),
        (len(data) - space * len(data)) / count / 10, len(set(words)) / count, odd / count,
        1 - len(set(lines)) / max(1, len(lines)), float(np.log1p(len(lines))),
    ]


class QualityModel:
    """A logistic classifier of ``text_features``; ``base`` is the share of good documents that it was fitted on."""

    def __init__(self, weights: np.ndarray, mean: np.ndarray, deviation: np.ndarray, base: float):
        self.weights, self.mean, self.deviation, self.base = weights, mean, deviation, base

    def log_odds(self, features: np.ndarray) -> np.ndarray:
        x = np.column_stack([np.ones(len(features)), np.clip((features - self.mean) / self.deviation, -6, 6)])
        return np.clip(x @ self.weights, -12, 12)


def with_features(docs: DataFrame) -> DataFrame:
    """``docs`` with the array ``features`` of its column ``text``."""

    def worker():
        return lambda texts: [pa.array([text_features(t) for t in texts], type=pa.list_(pa.float64()))]

    return map_texts(docs, "text", "features array<double>", worker)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> QualityModel:
    """Fit on ``docs`` (doc_id, text) with ``labels`` (doc_id, quality), about ``rows`` of each label.

    The labels are thinned by a hash of the id, so what is broadcast and gathered has a size that
    ``rows`` fixes. The intercept is moved back to the share of good documents in all labels. Without
    labels of both kinds every document gets even odds.
    """
    known = labels.where("quality IN (0, 1)").select(F.col("doc_id").alias("of_doc"), F.col("quality").cast("int").alias("quality"))
    counts = dict(known.groupBy("quality").count().collect())
    draw = F.pmod(F.xxhash64("of_doc", F.lit(3)), F.lit(1_000_000)) / 1e6
    share = {q: min(1.0, rows / max(1, counts.get(q, 0))) for q in (0, 1)}
    picked = known.where(draw < F.when(F.col("quality") == 1, share[1]).otherwise(share[0])).limit(4 * rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("of_doc")).select("text", "quality")
    found = with_features(texts).select("quality", "features").collect()
    y = np.array([r["quality"] for r in found], dtype=float)
    if len(set(y.tolist())) < 2:
        return QualityModel(np.zeros(FEATURES + 1), np.zeros(FEATURES), np.ones(FEATURES), 0.5)
    x = np.array([r["features"] for r in found])
    mean, deviation = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    weights = logistic(np.clip((x - mean) / deviation, -6, 6), y, np.zeros(FEATURES + 1))
    base = counts[1] / (counts[0] + counts[1])
    weights[0] += np.log(base / (1 - base)) - np.log(y.mean() / (1 - y.mean()))
    return QualityModel(weights, mean, deviation, base)


def classified(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``docs`` with the log odds ``evidence`` of its column ``text``; null for null and empty texts."""

    def worker():
        def compute(texts):
            odds = model.log_odds(np.array([text_features(t) for t in texts]).reshape(-1, FEATURES))
            return [pa.array([float(o) if t else None for o, t in zip(odds, texts, strict=True)], type=pa.float64())]

        return compute

    return map_texts(docs, "text", "evidence double", worker)


def url_host(url: Column) -> Column:
    """The host of an address, in lower case without a leading "www."; null where there is none."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1)), r"^www\.", ""), F.lit(""))


def url_path(url: Column) -> Column:
    """The first part of an address's path; "" for the root."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]*)", 1)


def _strength(groups: DataFrame, mean: Column) -> Column:
    """Strength of a beta prior with ``mean`` by moments: how much the groups differ beyond chance."""
    n, good = F.col("docs"), F.col("good")
    chance = mean * (1 - mean)
    between = (F.sum(n * (good / n - mean) * (good / n - mean)) - F.sum(chance)) / F.sum(n)
    strength = F.sum(chance * n) / F.sum(n) / F.greatest(between, F.lit(1e-9)) - 1
    return F.least(F.lit(STRENGTH[1]), F.greatest(F.lit(STRENGTH[0]), strength))


def _logit(p: Column) -> Column:
    bounded = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), p))
    return F.log(bounded / (1 - bounded))


def judged(docs: DataFrame, model: QualityModel, host: Column, path: Column, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, host, path, host_docs, path_docs, classifier, host_prior,
    path_prior, score, keep.

    The mean classifier probability of a host is drawn towards that of all documents, and that of a path
    towards its host's, each by a strength that comes from how much hosts and paths differ. The score
    joins the evidence of the text with the path's posterior without the document itself. Means are
    grouped sums with partial sums in each task, so no host is met as a whole.

    Nulls: a null host or path is one of its own; a null or empty text has no evidence and takes the
    prior. Repeated rows each count and each give a row. Empty table: no rows. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), host.cast("string").alias("host"),
                       path.cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    rows = classified(rows, model).drop("text")
    rows = stored(rows.withColumn("classifier", 1 / (1 + F.exp(-F.coalesce("evidence", F.lit(float(np.log(model.base / (1 - model.base)))))))), "quality")
    counted = [F.count("evidence").alias("docs"), F.coalesce(F.sum(F.when(F.col("evidence").isNotNull(), F.col("classifier"))), F.lit(0.0)).alias("good")]
    paths = stored(rows.groupBy("host", "path").agg(*counted), "paths")
    hosts = paths.groupBy("host").agg(F.sum("docs").alias("docs"), F.sum("good").alias("good"))
    whole = hosts.agg(F.sum("docs").alias("docs"), F.sum("good").alias("good")).first()
    mean = float(whole["good"] / whole["docs"]) if whole["docs"] else model.base
    of_hosts = hosts.where("docs > 0").agg(_strength(hosts, F.lit(mean))).first()[0] or STRENGTH[1]
    host_prior = (F.lit(mean * of_hosts) + F.col("good")) / (F.lit(of_hosts) + F.col("docs"))
    hosts = hosts.select(F.col("host").alias("of_host"), F.col("docs").alias("host_docs"), host_prior.alias("host_prior"))
    paths = paths.join(hosts, F.col("host").eqNullSafe(F.col("of_host"))).drop("of_host")
    of_paths = paths.where("docs > 0").agg(_strength(paths, F.col("host_prior"))).first()[0] or STRENGTH[1]
    paths = stored(paths.select(F.col("host").alias("of_host"), F.col("path").alias("of_path"), "host_docs", "host_prior",
                                F.col("docs").alias("path_docs"), "good"), "priors")
    seen = rows.join(paths, F.col("host").eqNullSafe(F.col("of_host")) & F.col("path").eqNullSafe(F.col("of_path")))
    own = F.when(F.col("evidence").isNotNull(), F.col("classifier")).otherwise(F.lit(0.0))
    others = F.col("path_docs") - F.when(F.col("evidence").isNotNull(), 1).otherwise(0)
    path_prior = (F.lit(of_paths) * F.col("host_prior") + F.col("good") - own) / (F.lit(of_paths) + others)
    seen = seen.withColumn("path_prior", path_prior)
    evidence = F.coalesce(F.col("evidence") - float(np.log(model.base / (1 - model.base))), F.lit(0.0))
    score = 1 / (1 + F.exp(-(evidence + _logit(F.col("path_prior")))))
    return seen.select("doc_id", "host", "path", "host_docs", "path_docs", "classifier", "host_prior", "path_prior",
                       score.alias("score"), (score >= threshold).alias("keep"))
