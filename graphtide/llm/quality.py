"""Quality by hierarchical empirical Bayes: a document's evidence with the posteriors of its host and path.

A logistic model of text measures gives each document a log-likelihood ratio. Hosts and paths are summed up by grouped
aggregation: labels where there are, the model's probability elsewhere. The global mean is the prior of hosts, a host's
posterior the prior of its paths; the strength of each prior comes from the spread between groups (method of moments),
so that sparse sites shrink. A document's score adds its evidence to its path's log odds without its own share.

Defined results: null and empty texts have the measures of an empty text; a null host or path is a group of its own;
without two classes of labels the evidence is 0 for all; repeated rows count as often as they come. Labels are learned
only outside the held-out fold; of contradicting labels of one id the smaller counts.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphtide.llm.common import cut_lineage, fold, map_rows

HELD_OUT = (5, 0)
#: Bound of the sample of labelled rows for the logistic model.
SAMPLE = 20_000
RIDGE = 1.0
#: A prior counts at least and at most as many rows.
STRENGTH = (1.0, 1e6)
SYMBOLS = re.compile(r"[#$%&*|<>{}\[\]^~=\\@_]")
WORD = re.compile(r"\S+")
UPPER, DIGIT = re.compile(r"[^\W\d_]"), re.compile(r"\d")


def measures(text: str | None) -> list[float]:
    text = text or ""
    n = max(1, len(text))
    words = WORD.findall(text)
    m = max(1, len(words))
    lines = [line for line in text.split("\n") if line.strip()]
    counts = Counter(words)
    letters = len(UPPER.findall(text))
    upper = letters and sum(map(str.isupper, text)) / letters
    pairs = Counter(zip(words, words[1:], strict=False))
    return [
        np.log1p(len(words)),
        sum(map(len, words)) / m,
        letters / n,
        float(upper),
        len(DIGIT.findall(text)) / n,
        len(SYMBOLS.findall(text)) / m,
        text.count("!") / m,
        text.count(".") / m,
        sum(1 for w in words if len(w) == 1) / m,
        len(counts) / m,
        max(counts.values(), default=0) / m,
        1 - len(pairs) / max(1, m - 1),
        1 - len(set(lines)) / max(1, len(lines)),
        m / max(1, len(lines)) / 100,
    ]


N_MEASURES = 14


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, host, path, x of rows with doc_id, host, path, text."""

    def rows(batch):
        for row in batch:
            yield row["doc_id"], row["host"], row["path"], [float(v) for v in measures(row["text"])]

    return map_rows(docs.select("doc_id", "host", "path", "text"), rows, "doc_id long, host string, path string, x array<double>")


def fit(x: np.ndarray, y: np.ndarray, steps: int = 30) -> tuple[float, np.ndarray]:
    """Intercept and weights of a ridge logistic model on raw measures, by Newton's method."""
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / spread])
    w, ridge = np.zeros(z.shape[1]), np.diag([0.0] + [RIDGE] * x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge + 1e-9 * np.eye(len(w)), z.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] - (w[1:] / spread) @ mean), w[1:] / spread


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(n: Column, s: Column, prior: Column) -> list[Column]:
    """Sums over groups for the moments of a beta-binomial: squared distances from the prior beyond what the binomial gives."""
    free = prior * (1 - prior)
    return [F.sum((s - n * prior) ** 2 - n * free).alias("over"), F.sum(n * (n - 1) * free).alias("pairs")]


def _solved(row) -> float:
    """Prior rows from the correlation within groups."""
    rho = min(1.0, max(1e-6, row["over"] / row["pairs"])) if row["pairs"] else 1e-6
    return float(min(STRENGTH[1], max(STRENGTH[0], 1 / rho - 1)))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, host, path, held_out, evidence (log-likelihood ratio), host_posterior, path_posterior, score, keep. Takes docs (doc_id, text, host, path) and labels (doc_id, quality)."""
    x = cut_lineage(measured(docs))
    known = labels.filter(F.col("quality").isNotNull() & (fold(F.col("doc_id"), HELD_OUT[0]) != HELD_OUT[1])).groupBy("doc_id").agg(F.min("quality").cast("double").alias("y"))
    place = F.xxhash64(F.col("doc_id").cast("string"), F.lit("quality"))
    picked = x.join(F.broadcast(known.orderBy(place, "doc_id").limit(SAMPLE)), "doc_id").select("x", "y").collect()
    y = np.array([r["y"] for r in picked])
    if len(set(y.tolist())) == 2:
        base = float(y.mean())
        bias, weights = fit(np.array([r["x"] for r in picked]), y)
    else:
        base, bias, weights = (float(y.mean()) if len(y) else 0.5), 0.0, np.zeros(N_MEASURES)
        base = min(0.99, max(0.01, base))
        bias = float(np.log(base / (1 - base)))
    dot = F.lit(bias)
    for i, w in enumerate(weights):
        dot = dot + F.col("x")[i] * float(w)
    odds = F.least(F.lit(30.0), F.greatest(F.lit(-30.0), dot))
    p = 1 / (1 + F.exp(-odds))
    rows = cut_lineage(x.select("doc_id", "host", "path", odds.alias("odds"), p.alias("p")).join(known, "doc_id", "left").select("doc_id", "host", "path", (F.col("odds") - float(np.log(base / (1 - base)))).alias("evidence"), F.coalesce("y", "p").alias("q")))

    paths = cut_lineage(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("q").alias("s")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = min(1 - 1e-4, max(1e-4, whole["s"] / whole["n"])) if whole["n"] else 0.5
    k_host = _solved(hosts.agg(*_strength(F.col("n"), F.col("s"), F.lit(mean))).first())
    host_posterior = (F.col("s") + k_host * mean) / (F.col("n") + k_host)
    hosts = hosts.select(F.col("host").alias("h"), host_posterior.alias("host_posterior"))
    sites = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    k_path = _solved(sites.agg(*_strength(F.col("n"), F.col("s"), F.col("host_posterior"))).first())
    sites = sites.select(F.col("host").alias("h"), F.col("path").alias("t"), "n", "s", "host_posterior")
    joined = rows.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("t")))
    prior = F.col("host_posterior") * k_path
    without = (F.greatest(F.lit(0.0), F.col("s") - F.col("q")) + prior) / (F.col("n") - 1 + k_path)
    final = 1 / (1 + F.exp(-(F.col("evidence") + _logit(F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), without))))))
    held = F.coalesce(fold(F.col("doc_id"), HELD_OUT[0]) == HELD_OUT[1], F.lit(False))
    return joined.select("doc_id", "host", "path", held.alias("held_out"), "evidence", "host_posterior", ((F.col("s") + prior) / (F.col("n") + k_path)).alias("path_posterior"), final.alias("score"), (final >= 0.5).alias("keep"))
