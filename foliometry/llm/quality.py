"""Quality classifier by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are texts labelled 1; the unlabelled texts are the corpus as it is. With the class prior p, the risk
p * R_pos(+) + max(0, R_unl(-) - p * R_pos(-)) is minimised by stochastic steps over a small network on shape features;
where the second part falls below 0, the step goes up it instead (the non-negative correction).

The class prior is estimated from positives and unlabelled texts alone (labels 0 are never read): a linear scorer parts the
two on one half of each, and on the other half the least ratio of the shares above a cut bounds the share of positives, taken
where the bound's own uncertainty is least; the halves are then swapped.

Fit: on bounded samples, at most max_positive labelled rows and max_unlabelled texts, chosen by a hash of the text; their
features (a few hundred bytes each) reach the driver, and the weights go out with the scoring function. Scoring reads each text
once, in whole, and shuffles nothing.

Defined results: null and empty texts have the features of an empty text and are scored; ids with both labels are not
trusted; without any positive, each score is 0.5; every row is scored by its own text, repeated rows alike, whatever their
ids; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliometry.llm.common import fold, slices

MAX_POSITIVE, MAX_UNLABELLED, HIDDEN = 12_000, 12_000, 24
CLASSES = 9
_CLASS = np.full(256, 8, np.int64)  # other symbols
_CLASS[128:] = 7
for _k, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".,;:?", "'\"()-!")):
    _CLASS[[ord(c) for c in _chars]] = _k
N_FEATURES = 96 + CLASSES * CLASSES + 10


def features(text: str | None) -> np.ndarray:
    """Shares of characters and of neighbouring character classes, and measures of length and repetition."""
    text = text or ""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, len(data))
    out = np.zeros(N_FEATURES, np.float32)
    out[:96] = np.sqrt(np.bincount(data, minlength=256)[32:128] / n)
    kinds = _CLASS[data]
    out[96 : 96 + CLASSES * CLASSES] = np.sqrt(np.bincount(kinds[:-1] * CLASSES + kinds[1:], minlength=CLASSES * CLASSES) / n)
    words, lines = text.split(), text.split("\n")
    w = max(1, len(words))
    ends = sum(x[-1] in "#$%&*!|" for x in words) / w
    out[-10:] = [
        sum(map(str.__eq__, words, words[1:])) / w,
        np.log1p(len(data)) / 10, len(set(words)) / w, len(data) / w / 10, len(set(lines)) / len(lines), np.log1p(len(lines)) / 5, w / len(lines) / 100, ends,
        sum(x[-1:] == "." for x in lines) / len(lines), len(set(words)) / w * np.log1p(w) / 10,
    ]
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    bias: np.ndarray
    second: np.ndarray
    last: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh((x - self.mean) / self.scale @ self.first + self.bias)
        return 1 / (1 + np.exp(-np.clip(hidden @ self.second + self.last, -30, 30)))


def _linear(positive: np.ndarray, unlabelled: np.ndarray) -> np.ndarray:
    """Direction of a ridge regression that parts the two."""
    x = np.concatenate([positive, unlabelled])
    weight = np.concatenate([np.full(len(positive), 0.5 / len(positive)), np.full(len(unlabelled), 0.5 / len(unlabelled))])
    y = np.concatenate([np.ones(len(positive)), -np.ones(len(unlabelled))])
    x = x - weight @ x
    return np.linalg.solve((x * weight[:, None]).T @ x + 1e-4 * np.eye(x.shape[1]), (x * weight[:, None]).T @ (y - weight @ y))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, risk: float = 0.1) -> float:
    """Share of positives among the unlabelled, between 0.05 and 0.99; 0.5 where there are too few rows to tell.

    Above any cut of a score, the unlabelled rows hold at least the prior times the positives' share; the ratio of the two shares
    comes near the prior where the cut leaves positives only.
    """
    if min(len(positive), len(unlabelled)) < 8:
        return 0.5
    found = []
    for k in range(2):
        way = _linear(positive[k::2], unlabelled[k::2])
        p, u = np.sort(positive[1 - k :: 2] @ way), np.sort(unlabelled[1 - k :: 2] @ way)
        cuts = np.unique(p)
        above_p, above_u = 1 - np.searchsorted(p, cuts) / len(p), 1 - np.searchsorted(u, cuts) / len(u)
        slack = np.sqrt(np.log(4 / risk) / 2) * (1 / np.sqrt(len(u)) + 1 / np.sqrt(len(p))) / above_p
        best = int(np.argmin(above_u / above_p + slack))
        found.append(above_u[best] / above_p[best])
    return float(np.clip(np.mean(found), 0.05, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 2000, batch: int = 256, rate: float = 0.006, seed: int = 5) -> Model:
    rng = np.random.default_rng(seed)
    d = positive.shape[1]
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(d), np.ones(d), np.zeros((d, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0, prior)
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 0.02
    p, u = (positive - mean) / scale, (unlabelled - mean) / scale
    params = [rng.standard_normal((d, HIDDEN)) / np.sqrt(d), np.zeros(HIDDEN), rng.standard_normal(HIDDEN) / 5, np.array([np.log(prior / (1 - prior))])]
    moments = [np.zeros_like(q) for q in params], [np.zeros_like(q) for q in params]
    for step in range(1, steps + 1):
        xp, xu = p[rng.integers(len(p), size=batch)], u[rng.integers(len(u), size=batch)]
        x = np.concatenate([xp, xu])
        hidden = np.tanh(x @ params[0] + params[1])
        g = np.clip(hidden @ params[2] + params[3][0], -30, 30)
        s = 1 / (1 + np.exp(-g))
        # logistic loss: for label + it is log(1 + e^-g) with slope s - 1, for label - log(1 + e^g) with slope s
        minus = np.log1p(np.exp(g))
        rest = minus[batch:].mean() - prior * minus[:batch].mean()
        slope = np.zeros(2 * batch)
        if rest >= 0:
            slope[:batch] = prior * (s[:batch] - 1) - prior * s[:batch]
            slope[batch:] = s[batch:]
        else:
            slope[:batch] = prior * s[:batch]
            slope[batch:] = -s[batch:]
        slope /= batch
        back = slope[:, None] * params[2] * (1 - hidden**2)
        grads = [x.T @ back + 1e-4 * params[0], back.sum(axis=0), hidden.T @ slope + 1e-4 * params[2], np.array([slope.sum()])]
        for k, gr in enumerate(grads):
            moments[0][k] = 0.9 * moments[0][k] + 0.1 * gr
            moments[1][k] = 0.999 * moments[1][k] + 0.001 * gr * gr
            params[k] = params[k] - rate * (1 - step / (steps + 1)) * moments[0][k] / (1 - 0.9**step) / (np.sqrt(moments[1][k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, params[0], params[1], params[2], float(params[3][0]), prior)


def _sampled(rows: DataFrame, most: int, salt: int, text: str) -> DataFrame:
    n = rows.count()
    return rows if n <= most else rows.where(F.pmod(F.xxhash64(F.lit(salt), text), F.lit(1_000_000_000)) < int(1e9 * most / n))


def _features_of(docs: DataFrame, text: str) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_pydict({"f": [features(t).tobytes() for t in batch.column(0).to_pylist()]}, schema=pa.schema([("f", pa.binary())]))

    rows = docs.select(F.col(text).alias("text")).mapInArrow(run, "f binary").collect()
    return np.array([np.frombuffer(r.f, np.float32) for r in rows], np.float64).reshape(-1, N_FEATURES)


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", doc_id: str = "doc_id", text: str = "text", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """usable: condition on the labels' ids that says which labels may be learned from."""
    trusted = labels.where(usable & F.col(label).isNotNull()).groupBy(doc_id).agg(F.min(label).alias("low"))
    positive = docs.join(trusted.where("low = 1").select(doc_id), doc_id, "left_semi").select(text)
    p = _features_of(_sampled(positive, max_positive, 51, text), text)
    u = _features_of(_sampled(docs.select(text), max_unlabelled, 52, text), text)
    prior = estimate_prior(p, u)
    return fit(p, u, prior)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score, 0 to 1: higher where label 1 is likelier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = np.array([features(t) for t in batch.column(1).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels, fold("doc_id", 5) != 0)
    return score(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
