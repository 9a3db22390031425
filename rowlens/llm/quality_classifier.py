"""Regularised quadratic discriminant over transformed document statistics.

Each class is a Gaussian whose covariance is shrunk towards the pooled one and then towards a
multiple of the identity. Sums and cross products are plain aggregates, so fitting reads the
labelled rows once and brings (features^2 / 2) numbers per class to the driver. A score is the
logistic of the difference of the two log densities, from Cholesky factors computed once.

Defined cases: a null or empty text has the statistics of no words; repeated labels count as
often as they occur; labels other than 0 and 1, and null ids, teach nothing; with fewer than
`MIN_ROWS` rows in a class every score is the share of label 1 (one half without labels); a
document keeps one row whatever the labels hold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from rowlens.llm.quality_rules import text_counts
from rowlens.llm.ship import by_value

by_value(__name__)

FEATURES = (
    "length", "word_chars", "symbols", "dup_lines", "repeats", "upper", "marks", "digits",
    "distinct", "adjacent", "lines",
)
TO_POOLED, TO_IDENTITY = 0.1, 0.01
MIN_ROWS = 2


def features(counts: str) -> Column:
    """Array of transformed statistics from a struct of counts."""
    c = lambda name: F.col(f"{counts}.{name}").cast("double")
    words = F.greatest(c("n_words"), F.lit(1.0))
    chars = F.greatest(c("word_chars"), F.lit(1.0))
    lines = F.greatest(c("n_lines"), F.lit(1.0))
    log_rate = lambda x: F.log(x + F.lit(0.01))
    return F.array(
        F.log1p(c("n_words")), F.log1p(c("word_chars") / words), log_rate(c("n_symbols") / words),
        F.sqrt(c("n_dup_lines") / lines), F.sqrt(c("n_repeat_words") / words), log_rate(c("n_upper") / chars),
        log_rate(c("n_marks") / words), log_rate(c("n_digits") / chars), c("n_distinct") / words,
        F.sqrt(c("n_adjacent") / words), log_rate(c("n_lines") / words),
    )


@dataclass
class Model:
    """Per class: mean, inverse Cholesky factor of the covariance, constant of the log density."""

    means: list[np.ndarray]
    inverse_factors: list[np.ndarray]
    constants: list[float]
    share: float  # of label 1; the score where no class model could be fitted

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(x), self.share)
        logs = [
            k - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1)
            for m, f, k in zip(self.means, self.inverse_factors, self.constants, strict=True)
        ]
        return 1.0 / (1.0 + np.exp(-np.clip(logs[1] - logs[0], -700, 700)))


def fit(labelled: DataFrame, x: str, label: str, to_pooled=TO_POOLED, to_identity=TO_IDENTITY) -> Model:
    d = len(FEATURES)
    item = lambda i: F.col(x)[i]
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    rows = (
        labelled.where(F.col(label).isin(0, 1))
        .groupBy(F.col(label).cast("int").alias("_class"))
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.array(*[F.sum(item(i)) for i in range(d)]).alias("_s"),
            F.array(*[F.sum(item(i) * item(j)) for i, j in pairs]).alias("_p"),
        )
        .collect()  # two rows
    )
    found = {r["_class"]: r for r in rows}
    counts = [found[c]["_n"] if c in found else 0 for c in (0, 1)]
    share = counts[1] / sum(counts) if sum(counts) else 0.5
    if min(counts) < MIN_ROWS:
        return Model([], [], [], share)
    means, covs = [], []
    for c in (0, 1):
        mean = np.array(found[c]["_s"]) / counts[c]
        products = np.zeros((d, d))
        for (i, j), v in zip(pairs, found[c]["_p"], strict=True):
            products[i, j] = products[j, i] = v
        means.append(mean)
        covs.append(products / counts[c] - np.outer(mean, mean))
    pooled = (counts[0] * covs[0] + counts[1] * covs[1]) / sum(counts)
    factors, constants = [], []
    for c in (0, 1):
        cov = (1 - to_pooled) * covs[c] + to_pooled * pooled
        cov = (1 - to_identity) * cov + (to_identity * np.trace(cov) / d + 1e-9) * np.eye(d)
        chol = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(chol))
        constants.append(float(np.log(counts[c] / sum(counts)) - np.log(np.diag(chol)).sum()))
    return Model(means, factors, constants, share)


def scored(x: Column, model: Model) -> Column:
    def score(rows: pa.Array) -> pa.Array:
        if isinstance(rows, pa.ChunkedArray):
            rows = rows.combine_chunks()
        values = np.asarray(rows.flatten()).reshape(len(rows), -1) if len(rows) else np.empty((0, len(FEATURES)))
        return pa.array(model.score(values), pa.float64())

    return arrow_udf(score, "double")(x)


def with_features(docs: DataFrame, text: str = "text", into: str = "_x") -> DataFrame:
    return docs.withColumn("_counts", text_counts(F.col(text))).withColumn(into, features("_counts")).drop("_counts")
