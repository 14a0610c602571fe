"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other; every model sees the words of the
text and the probabilities of the categories before it. For training, those
probabilities come from models that did not see the row (out-of-fold, equal
texts in one fold), so a later model learns how reliable they are.

Words and the beginnings of words are hashed into one sparse vector of
presences: length and repetition of a text change nothing, and inflected forms
share their beginning.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame, functions as F, types as T

from flowtriage.llm.common import map_texts, plain_word_parts, text_or_empty
from flowtriage.sources.workspace import durable

#: Hashed features; lengths of word beginnings; folds; bound of the labelled rows a fit reads.
FEATURES, BEGINNINGS, FOLDS, FIT_ROWS = 1 << 17, (4, 5), 3, 20_000
#: Of labelled rows held out (half of 20,000), 0.4 found 1,061 of 1,076 toxic ones and 8 of 9,251 others.
THRESHOLD = 0.4
#: Fixed setting of every linear model.
_FIT = {"maxIter": 25, "regParam": 0.0005, "standardization": False, "tol": 1e-4}


def feature_ids(text: bytes, features: int = FEATURES) -> list[int]:
    """Sorted distinct hashed features of a text."""
    from xxhash import xxh3_64_intdigest

    words = set(chain.from_iterable(plain_word_parts(text)))
    found = {xxh3_64_intdigest(w) % features for w in words}
    for n in BEGINNINGS:
        found.update(xxh3_64_intdigest(w, n) % features for w in {w[:n] for w in words if len(w) > n})
    return sorted(found)


@dataclass(frozen=True)
class Chain:
    """Per category: weights of the hashed features, of the categories before it, and the intercept."""

    categories: tuple[str, ...]
    words: np.ndarray
    before: tuple[tuple[float, ...], ...]
    intercepts: tuple[float, ...]

    def probabilities(self, ids: Sequence[int]) -> list[float]:
        known: list[float] = []
        sums = self.words[:, ids].sum(axis=1) if len(ids) else np.zeros(len(self.categories))
        for k in range(len(self.categories)):
            score = float(sums[k]) + self.intercepts[k] + sum(w * p for w, p in zip(self.before[k], known))
            known.append(float(1 / (1 + np.exp(-np.clip(score, -60, 60)))))
        return known


def _linear(rows: DataFrame, label: str, size: int) -> tuple[np.ndarray, float]:
    """Weights and intercept; a constant where the rows have no label or one class only."""
    known = rows.where(F.col(label).isNotNull())
    n, positive = known.agg(F.count("*"), F.coalesce(F.sum(label), F.lit(0))).first()
    if positive in (0, n):
        return np.zeros(size), 30.0 if n and positive == n else -30.0
    model = LogisticRegression(featuresCol="features", labelCol=label, **_FIT).fit(known)
    return model.coefficients.toArray(), model.intercept


def fit_chain(
    docs: DataFrame,
    labels: DataFrame,
    categories: Sequence[str],
    doc_id: str = "doc_id",
    text: str = "text",
    fit_rows: int = FIT_ROWS,
    folds: int = FOLDS,
) -> Chain:
    """Fit on at most ``fit_rows`` labelled documents, chosen by the hash of their id.

    A document labelled more than once has a category if any of its labels has.
    A null label leaves the row out of that category's model. Without labels, or
    with one class only, a category's probability is the constant 0 or 1.
    """
    chosen = (
        labels.where(F.col(doc_id).isNotNull())
        .groupBy(F.col(doc_id).alias("_id"))
        .agg(*[F.max(F.col(c).cast("double")).alias(f"_label{k}") for k, c in enumerate(categories)])
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(fit_rows)
    )
    chosen = durable(chosen, "toxicity-labels")

    def make():
        return lambda texts: [[feature_ids(t) for t in texts]]

    wanted = docs.select(F.col(doc_id).alias("_id"), text_or_empty(text).alias("_text")).join(
        F.broadcast(chosen), "_id"  # at most fit_rows rows of a few numbers
    )
    names = [f"_label{k}" for k in range(len(categories))]
    wanted = wanted.withColumn("_fold", F.pmod(F.xxhash64("_text"), F.lit(folds)))
    ids = T.StructField("_ids", T.ArrayType(T.IntegerType()))
    rows = durable(map_texts(wanted, "_text", ["_id", "_fold", *names], [ids], make), "toxicity-rows")
    size = FEATURES + 8
    vector = F.udf(lambda found, *p: _vector(found, p), VectorUDT())
    words, before, intercepts = [], [], []
    for k, name in enumerate(names):
        rows = rows.withColumn("features", vector("_ids", *[f"_p{j}" for j in range(k)])).persist()
        weights, intercept = _linear(rows, name, size)
        words.append(weights[:FEATURES].astype(np.float32))
        before.append(tuple(float(w) for w in weights[FEATURES : FEATURES + k]))
        intercepts.append(float(intercept))
        if k + 1 < len(names):
            held = [_linear(rows.where(F.col("_fold") != f), name, size) for f in range(folds)]
            at = rows.sparkSession.sparkContext.broadcast(held)

            @F.udf(T.DoubleType())
            def out_of_fold(features, fold):
                w, b = at.value[fold]
                score = float(w[features.indices] @ features.values) + b
                return float(1 / (1 + np.exp(-np.clip(score, -60, 60))))

            scored = durable(
                rows.withColumn(f"_p{k}", out_of_fold("features", "_fold")).drop("features"), "toxicity-chain"
            )
            rows.unpersist()
            rows = scored
    rows.unpersist()
    return Chain(tuple(categories), np.vstack(words), tuple(before), tuple(intercepts))


def _vector(ids: Sequence[int], probabilities: Sequence[float]):
    places = [*ids, *(FEATURES + j for j in range(len(probabilities)))]
    return Vectors.sparse(FEATURES + 8, places, [*[1.0] * len(ids), *map(float, probabilities)])


def score_chain(
    docs: DataFrame,
    fitted: Chain,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``keep``, one column p_<category> each, and rejected: the last category reaches ``threshold``.

    A null or empty text is scored by the intercepts alone. One row per row;
    repeated rows get equal scores. Input columns named like a result are
    replaced. One scan, no shuffle.
    """
    model = docs.sparkSession.sparkContext.broadcast(fitted)

    def make():
        fitted = model.value

        def work(texts: list[bytes]):
            found = [fitted.probabilities(feature_ids(t)) for t in texts]
            return [*zip(*found), [p[-1] >= threshold for p in found]]

        return work

    fields = [T.StructField(f"p_{c}", T.DoubleType()) for c in fitted.categories]
    return map_texts(docs, text, keep, [*fields, T.StructField("rejected", T.BooleanType())], make)
