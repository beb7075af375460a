"""Small models fitted on a bounded sample of labelled files."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shrinkwise.session import saved_table


def labelled_sample(files: DataFrame, labels: DataFrame, rel_path: str, text: str, label: str, most: int) -> DataFrame:
    """(key, text, label, weight): at most `most` labelled files of each label, 0 and 1, chosen by a hash of rel_path.

    weight is how many labelled rows each row stands for. The sample's keys are bounded by 2 x `most` rows, so they
    are broadcast and the texts are filtered where they are read. Where files or labels share keys, those rows are numbered
    and `most` of each label stay. Labels other than 0 and 1, and null keys, are left out.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(rel_path).isNotNull())
    known = known.select(F.col(rel_path).alias("key"), F.col(label).cast("int").alias("label"))
    totals = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    parts = []
    for y, n in sorted(totals.items()):
        chosen = known.where(F.col("label") == y).orderBy(F.xxhash64("key"), "key").limit(most)
        parts.append(chosen.withColumn("weight", F.lit(max(1.0, n / most))))
    if not parts:
        parts = [known.limit(0).withColumn("weight", F.lit(1.0))]
    chosen = parts[0].union(parts[1]) if len(parts) > 1 else parts[0]
    texts = files.select(F.col(rel_path).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "key").withColumn("number", F.monotonically_increasing_id())
    found = saved_table(found, "labelled")
    numbers = [found.where(F.col("label") == y).select("number").orderBy(F.xxhash64("key", "number"), "number").limit(most) for y in (0, 1)]
    kept = found.join(F.broadcast(numbers[0].union(numbers[1])), "number", "left_semi")
    return saved_table(kept.select("key", "text", "label", "weight"), "sample")


def logistic_fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression, the last for the constant, by Newton's method with a ridge on all but that."""
    x = np.hstack([x, np.ones((len(x), 1))])
    keep = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    w = np.zeros(x.shape[1])
    scale = weight / max(weight.sum(), 1e-12)
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (scale * p * (1 - p) + 1e-12)[:, None]).T @ x + keep * 1e-2, x.T @ (scale * (p - y)) + 1e-2 * keep @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
