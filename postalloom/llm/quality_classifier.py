"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

The class means and covariances come from sums that Spark takes over all labelled rows. Each covariance is shrunk towards the
pooled one and towards a multiple of the identity (Friedman, 1989). Scoring uses the Cholesky factors, inverted
once on the driver: the score is the logistic function of the difference of the log densities plus the log prior
odds.

Nulls: a null text is scored by its zero counts, as an empty one; a null doc_id is in fold 0 and never labelled; null labels are left out.
Very long texts are counted whole. Ties: a score of exactly 0.5 is class 1. Repeated rows are scored each; a document with several labels counts
once for each. Clashing columns are carried as one struct. An empty table gives an empty one, and without labels only the prior odds
speak: every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postalloom.llm.common import cut, table
from postalloom.llm.text_stats import COUNTS, counted, counted_rows

NAME = "op7_quadratic_quality"
ORACLE = None

#: Weight of the pooled covariance, and of the identity, in each class's.
TO_POOLED = 0.5
TO_IDENTITY = 0.05


def transform(counts: np.ndarray) -> np.ndarray:
    """Statistics of each row of COUNTS: logarithms and shares, finite for any text."""
    c = {name: counts[:, i].astype(float) for i, name in enumerate(COUNTS)}
    words, lines = np.maximum(c["n_words"], 1), np.maximum(c["n_lines"], 1)
    per_cent = lambda part, whole: np.log1p(100 * part / whole)
    return np.stack([
        np.log1p(c["n_words"]),
        np.log((c["word_chars"] + 5) / (words + 1)),
        per_cent(c["n_symbols"], words),
        per_cent(c["n_caps_words"], words),
        per_cent(c["n_exclaims"], words),
        per_cent(c["n_upper"], np.maximum(c["word_chars"], 1)),
        per_cent(c["n_repeat_words"], words),
        np.log((c["n_distinct_words"] + 1) / np.sqrt(words + 1)),
        c["n_dup_lines"] / lines,
        np.log((words + 1) / (lines + 1)),
    ], axis=1)


@dataclass
class Discriminant:
    """Per class: mean, inverse Cholesky factor and log of the factor's determinant, on standardised statistics."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    log_roots: list[float]
    log_odds: float

    @classmethod
    def fit(cls, n: np.ndarray, sums: np.ndarray, squares: np.ndarray, to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY) -> Discriminant:
        """From each class's number, sums and sums of products, class 0 first. A class without rows gets the other's figures, so only the prior speaks."""
        d = sums.shape[1]
        total = max(n.sum(), 1.0)
        centre = sums.sum(axis=0) / total
        scale = np.sqrt(np.maximum(np.diag(squares.sum(axis=0)) / total - centre**2, 0))
        scale[scale < 1e-6] = 1
        means, spreads = [], []
        for k in (0, 1):
            k = k if n[k] else 1 - k
            mean = sums[k] / n[k] if n[k] else centre
            spread = squares[k] / n[k] - np.outer(mean, mean) if n[k] else np.diag(scale**2)
            means.append((mean - centre) / scale)
            spreads.append(spread / np.outer(scale, scale))
        pooled = (n[0] * spreads[0] + n[1] * spreads[1]) / total if n.sum() else np.eye(d)
        factors, log_roots = [], []
        for spread in spreads:
            shrunk = (1 - to_pooled) * spread + to_pooled * pooled
            shrunk = (1 - to_identity) * shrunk + to_identity * max(np.trace(shrunk) / d, 1e-6) * np.eye(d)
            lower = np.linalg.cholesky(shrunk)
            factors.append(np.linalg.inv(lower))
            log_roots.append(float(np.log(np.diag(lower)).sum()))
        return cls(centre, scale, means, factors, log_roots, float(np.log((n[1] + 1) / (n[0] + 1))))

    def score(self, statistics: np.ndarray) -> np.ndarray:
        """P(class 1) of each row."""
        z = (statistics - self.centre) / self.scale
        logs = [-0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) - r for m, f, r in zip(self.means, self.factors, self.log_roots, strict=True)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1] - self.log_odds, -700, 700)))


def fold() -> F.Column:
    """The remainder by 3 of the CRC-32 of doc_id as text; null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3))


def fit(counts: DataFrame, labels: DataFrame) -> Discriminant:
    """From all rows of ``counts`` (doc_id and COUNTS) that ``labels`` rates outside fold 1; null labels and ids are left out.

    What comes to the driver is one row per class and sum, whatever the number of labels.
    """
    train = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold() != 1)).select("doc_id", F.col("quality").cast("int").alias("_class"))
    rated = cut(counts.select("doc_id", *COUNTS).join(train, "doc_id").select("_class", *COUNTS))  # else a broadcast join leaves two workers to each task

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = transform(frame[list(COUNTS)].to_numpy())
            for k in (0, 1):
                own = x[frame["_class"].to_numpy() == k]
                values = np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
                yield pd.DataFrame({"_class": k, "place": np.arange(len(values)), "value": values})

    parts = rated.mapInPandas(sums, "_class int, place int, value double").groupBy("_class", "place").agg(F.sum("value").alias("value"))
    d = transform(np.zeros((1, len(COUNTS)))).shape[1]
    flat = np.zeros((2, 1 + d + d * d))
    for row in parts.collect():
        flat[row["_class"], row["place"]] = row["value"]
    return Discriminant.fit(flat[:, 0], flat[:, 1 : 1 + d], flat[:, 1 + d :].reshape(2, d, d))


def scored(counts: DataFrame, model: Discriminant) -> DataFrame:
    """``counts`` with score, rounded to 9 digits so that the order of sums doesn't show."""

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        return pd.Series(model.score(transform(np.stack([c.to_numpy() for c in columns], axis=1))))

    return counts.withColumn("score", F.round(score(*COUNTS), 9))


def keep_good(docs: DataFrame, model: Discriminant, keep_from: float = 0.5) -> DataFrame:
    """The documents with a score of at least ``keep_from``, with their columns as they were. No shuffle."""
    rated = counted_rows(docs, {"_score": lambda counts: model.score(transform(counts))})
    return rated.where(F.round("_score", 9) >= keep_from).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score; null and empty texts are scored by their zero counts."""
    counts = cut(counted(table(spark, sf_dir, "documents"), ["doc_id"]))
    done = scored(counts, fit(counts, table(spark, sf_dir, "labels")))
    return done.select("doc_id", (fold() == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
