"""Quality classifier by positive-unlabelled learning.

Trusted good documents are the positives; what else the web gives has no labels. With the class prior `pi` and a loss l,
the risk is pi E_p[l(g)] + max(0, E_u[l(-g)] - pi E_p[l(-g)]): the second part stands for the negatives, is unbiased, and
is kept from going below zero; where it would, a step goes the other way. The prior is estimated from the same
two sets: a first model tells positives from unlabelled texts, and the least ratio of the shares of unlabelled and of
positive texts above a score bounds it (the best bin).

A text is seen by shares of its signs, words and lines, which don't depend on its length or language. The model is a
small network of one layer; features are made where the texts are, and only a bounded sample of them is fitted on.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMMON = frozenset(ord(c) for c in ".,;:'\"?-()’“”…–—¿¡«»、。")
N_FEATURES = 20


@dataclass(frozen=True)
class Model:
    """Centre and scale of the features, the network's weights and the class prior; without weights all scores are the prior."""

    centre: np.ndarray
    scale: np.ndarray
    weights: tuple[np.ndarray, np.ndarray, np.ndarray, float] | None
    prior: float


@lru_cache(1)
def sign_kinds() -> np.ndarray:
    """By code point, bits for letters, capitals, digits, white space, common signs and exclamation marks; 0 for any other sign."""
    tests = [str.isalpha, str.isupper, str.isdigit, str.isspace, lambda c: ord(c) in COMMON, lambda c: c == "!"]
    table = np.zeros(0x110000, np.uint8)
    for code in range(0x110000):
        c = chr(code)
        table[code] = sum(1 << k for k, test in enumerate(tests) if test(c))
    return table


def features(text: str) -> np.ndarray:
    """Shares of signs, words and lines of a whole text; zeros for a text without words."""
    out = np.zeros(N_FEATURES)
    words = text.split()
    if not words:
        return out
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = sign_kinds()[codes]
    letters, upper, digits, spaces, common, loud_signs = ((kinds & bit != 0).mean() for bit in (1, 2, 4, 8, 16, 32))
    other = (kinds == 0).mean()
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    lengths = np.fromiter(map(len, words), np.float64, len(words))
    frequent = Counter(words)
    place = {w: k for k, w in enumerate(frequent)}
    at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
    flags = np.array([(not w[-1].isalnum() and ord(w[-1]) not in COMMON, w.isupper() and len(w) > 1, not (w[0].isalnum() or any(map(str.isalnum, w)))) for w in place], np.float64)[at]
    same = float(np.count_nonzero(at[1:] == at[:-1])) / len(words)
    pairs = len(np.unique(at[1:] * len(place) + at[:-1])) / max(len(words) - 1, 1)
    starts = np.arange(0, max(len(words) - 19, 1), 40)  # runs of 40 words; a last one of fewer than 20 goes with the run before
    ends = np.append(starts[1:], len(words))
    odd, loud = (np.add.reduceat(flags[:, k], starts) / (ends - starts) for k in (0, 1))
    fresh = [len(set(words[i:j])) / (j - i) for i, j in zip(starts.tolist(), ends.tolist())]
    twice = (codes[1:] == codes[:-1]) & (kinds[1:] & 13 == 0)
    out[:] = [
        letters, upper / max(letters, 1e-9), digits, spaces, common, other, loud_signs,
        float(np.count_nonzero(twice)) / len(words), float(np.log1p(lengths.mean())), float(lengths.std() / 10), len(frequent) / len(words), max(frequent.values()) / len(words), same, pairs,
        len(set(lines)) / len(lines), float(flags[:, 2].mean()), odd.max(), min(fresh), loud.max(), odd.mean(),
    ]
    return out


def vectors(text: Column) -> Column:
    """The features of each text as an array of doubles; nulls are empty texts."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([features(t or "").tolist() for t in texts])

    return F.pandas_udf(run, "array<double>")(text)


def forward(x: np.ndarray, weights: tuple) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(x @ weights[0] + weights[1])
    return hidden, hidden @ weights[2] + weights[3]


def sigmoid(g: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(g, -40, 40)))


def fitted(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, units: int = 12, epochs: int = 150, rate: float = 0.02, decay: float = 3e-3, seed: int = 11) -> tuple:
    """Weights of least non-negative risk with the logistic loss; without a prior, of telling the two sets apart.

    Every step takes all rows; Adam's step sizes. The seed fixes the start.
    """
    rng = np.random.default_rng(seed)
    x, n, p = np.vstack([positive, unlabelled]), len(positive) + len(unlabelled), len(positive)
    theta = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], units)), np.zeros(units), rng.normal(0, 1 / np.sqrt(units), units), 0.0]
    mean, square = [0.0] * 4, [0.0] * 4
    for step in range(1, epochs + 1):
        hidden, g = forward(x, theta)
        s = sigmoid(g)
        # d/dg of l(g) = log(1 + exp(-g)) is s - 1, of l(-g) it is s.
        if prior is None:
            slope = np.concatenate([(s[:p] - 1) / p, s[p:] / (n - p)]) / 2
        else:
            lost = lambda z: np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0)  # noqa: E731, l(-z)
            negative = lost(g[p:]).mean() - prior * lost(g[:p]).mean()
            down = np.concatenate([-prior * s[:p] / p, s[p:] / (n - p)])
            up = np.concatenate([prior * (s[:p] - 1) / p, np.zeros(n - p)])
            slope = up + down if negative >= 0 else -down
        back = np.outer(slope, theta[2]) * (1 - hidden**2)
        grads = [x.T @ back + decay * theta[0], back.sum(0), hidden.T @ slope + decay * theta[2], slope.sum()]
        for k, grad in enumerate(grads):
            mean[k], square[k] = 0.9 * mean[k] + 0.1 * grad, 0.999 * square[k] + 0.001 * grad**2
            theta[k] = theta[k] - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    return tuple(theta)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled rows, by the best bin over scores of rows that the first model did not see.

    Of the rows above a score, the share of the unlabelled over the share of the positives is the prior where nothing
    but positives is left; the bin is the one of least upper bound, at 0.1 confidence for both shares. Either half of the
    rows is scored by a model of the other half, and the two estimates are averaged.
    """
    found = []
    for a, b in ((0, 1), (1, 0)):
        p, u = positive[b::2], unlabelled[b::2]
        if not len(positive[a::2]) or not len(unlabelled[a::2]) or not len(p) or not len(u):
            return 0.5
        weights = fitted(positive[a::2], unlabelled[a::2], None)
        p, u = forward(p, weights)[1], forward(u, weights)[1]
        cuts = np.quantile(p, np.linspace(0, 0.95, 96))
        q_p, q_u = (1 - np.searchsorted(np.sort(x), cuts, "left") / len(x) for x in (p, u))
        margin = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(len(u)) + 1 / np.sqrt(len(p)))
        best = int(((q_u + margin) / np.maximum(q_p, 1e-9)).argmin())
        found.append(q_u[best] / q_p[best])
    return float(np.clip(np.mean(found), 0.05, 0.99))


def train(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> Model:
    """A model of rows of doc_id and text, with the labels' rows of doc_id and quality.

    Positives are documents all of whose labels are 1; labels of other values are not read. Unlabelled are all documents. The classifier is
    fitted on a bounded sample: about `most` of each, chosen by a hash of doc_id; null ids are left out, of repeated ids one row counts.
    The numbers that reach the driver are their features. Without positives or documents nothing is learnt.
    """
    width = F.lit(1 << 50)
    chosen = lambda n: F.pmod(F.xxhash64(F.col("doc_id").cast("long")), width) < int(min(1.0, most / max(n, 1)) * (1 << 50))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    good = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality is not null")
    good = good.groupBy("doc_id").agg(F.min("quality").alias("least"), F.max("quality").alias("greatest")).where("least = 1 and greatest = 1").select("doc_id")
    of_good, of_docs = chosen(good.count()), chosen(docs.count())
    # One scan of the texts: a row is looked at where it is in either sample. The ids sent to it are about `most`.
    marked = docs.join(F.broadcast(good.where(of_good).withColumn("good", F.lit(True))), "doc_id", "left").where(F.col("good") | of_docs)
    seen = marked.select("doc_id", F.coalesce("good", F.lit(False)).alias("good"), of_docs.alias("any"), vectors(F.col("text")).alias("f"))
    rows = seen.groupBy("doc_id").agg(F.max("good").alias("good"), F.max("any").alias("any"), F.max("f").alias("f")).collect()  # at most about twice `most`
    rows.sort(key=lambda r: r["doc_id"])
    shaped = lambda test: np.array([r["f"] for r in rows if test(r)], np.float64).reshape(-1, N_FEATURES)
    positive, unlabelled = shaped(lambda r: r["good"]), shaped(lambda r: r["any"])
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), None, 0.0)
    centre, scale = unlabelled.mean(0), unlabelled.std(0)
    scale = np.where(scale < 1e-9, 1.0, scale)
    positive, unlabelled = (np.clip((x - centre) / scale, -8, 8) for x in (positive, unlabelled))
    prior = class_prior(positive, unlabelled)
    return Model(centre, scale, fitted(positive, unlabelled, prior), prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with score, 0 to 1: how likely a text is good. A column of that name is replaced; rows stay one for one.

    Null and empty texts are scored by their features, which are zeros. Texts are read whole.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            if model.weights is None:
                yield pd.Series(np.full(len(texts), model.prior))
                continue
            x = np.array([features(t or "") for t in texts]).reshape(-1, N_FEATURES)
            found = sigmoid(forward(np.clip((x - model.centre) / model.scale, -8, 8), model.weights)[1])
            yield pd.Series(np.round(found, 9))  # the last digits depend on the batch

    return docs.withColumn("score", F.pandas_udf(run, "double")(F.col("text").cast("string")))
