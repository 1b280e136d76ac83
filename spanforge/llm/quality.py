"""Quality by positive-unlabelled learning: the non-negative unbiased risk, with an estimated class prior.

Trusted positives are labelled rows of class 1; the unlabelled set is all learnable text. No negative label is used. A
linear model over hashed features of the whole text (which kinds of characters follow one another, how often words
repeat) minimises, by SGD in numpy, the risk prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)).

The prior is the best-bin estimate: a first model tells positives from unlabelled text; of all thresholds on its score, the
one where the share of unlabelled texts above it, divided by that of kept positives, is least for sure. The scores of all
learnable texts are counted for it. Scores are calibrated on kept positives and unlabelled texts by the unbiased log risk.

The model is fitted on bounded samples (about TRAIN_ROWS positives, TRAIN_ROWS others), of which tasks send the features of whole texts.

Defined results: null text counts as empty and gets the score of no features; no positives: every score is a half; equal
texts, equal scores; other columns are kept; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, fields, map_lists, word_hashes

#: Rows of each kind (positive, unlabelled) that a model is fitted on.
TRAIN_ROWS = 2000
#: Bins in which scores are counted.
BINS = 1000
BUCKETS = 1 << 11
#: How many words back a repetition is looked for.
BACK = (1, 2, 3, 4)
SLOTS = BUCKETS + len(BACK) + 1
_CHUNK = 1 << 20
#: Classes of bytes: 0 space, 1 line feed, 2 small letter, 3 capital, 4 digit, 5 beyond ASCII, 6 and more: each mark alone.
_KIND = np.zeros(256, dtype=np.uint32)
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = 1 if _b == 10 else 0 if _b in (9, 11, 12, 13, 32) else 5 if _b > 127 else 2 if _c.islower() else 3 if _c.isupper() else 4 if _c.isdigit() else 6 + _b


def features(text: str | None) -> np.ndarray:
    """Counts of hashed 1-, 2- and 4-grams of the kinds of characters, scaled to unit sum; the share of words that repeat one BACK before; 1."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    out = np.zeros(SLOTS)
    for at in range(0, len(raw), _CHUNK):
        kind = _KIND[raw[at : at + _CHUNK]]
        runs = kind[np.concatenate(([True], kind[1:] != kind[:-1]))]  # what follows what, whatever the lengths
        for n in (1, 2, 4):
            if len(runs) >= n:
                h = np.zeros(len(runs) - n + 1, dtype=np.uint32)
                for i in range(n):
                    h = (h + runs[i : len(runs) - n + 1 + i] + np.uint32(n)) * np.uint32(0x9E3779B1)
                    h ^= h >> np.uint32(15)
                out[:BUCKETS] += np.bincount(h % np.uint32(BUCKETS), minlength=BUCKETS) / n
    total = out.sum()
    if total:
        out /= total
    words = word_hashes(text, fold=False)
    for i, n in enumerate(BACK):
        if len(words) > n:
            out[BUCKETS + i] = (words[n:] == words[:-n]).mean()
    out[-1] = 1.0
    return out.astype(np.float32)


@dataclass
class Model:
    weights: np.ndarray
    slope: float
    offset: float

    def score(self, text: object) -> float:
        z = float(features(text if isinstance(text, str) else None) @ self.weights)
        return float(1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -30, 30))))


def nonnegative_risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float, scale: np.ndarray | float = 1.0, steps: int = 300, rate: float = 5.0, batch: int = 512, seed: int = 5) -> np.ndarray:
    """Weights that minimise the non-negative unbiased risk of the sigmoid loss; where the bracket is negative, the step goes back up it."""
    rng = np.random.default_rng(seed)
    w = np.zeros(positive.shape[1])
    for step in range(steps):
        p, u = positive[rng.integers(len(positive), size=batch)] * scale, unlabelled[rng.integers(len(unlabelled), size=batch)] * scale
        sp, su = 1 / (1 + np.exp(-p @ w)), 1 / (1 + np.exp(-u @ w))
        dp, du = (sp * (1 - sp)) @ p / len(p), (su * (1 - su)) @ u / len(u)
        # the loss of calling x positive is 1 - s(x), of calling it negative s(x)
        bracket = su.mean() - prior * sp.mean()
        gradient = -prior * dp + (du - prior * dp) if bracket >= 0 else -(du - prior * dp)
        w -= rate * (1 - step / steps) * gradient
    return w


def _scale(positive: np.ndarray, unlabelled: np.ndarray) -> np.ndarray:
    scale = 1 / np.sqrt(np.maximum((positive**2).mean(axis=0) + (unlabelled**2).mean(axis=0), 1e-6))
    scale[-1] = 1.0
    return scale


def apart(positive: np.ndarray, unlabelled: np.ndarray, scale: np.ndarray, steps: int = 300, rate: float = 1.0) -> np.ndarray:
    """Weights of a logistic model that tells positives from unlabelled rows."""
    p, u, w = positive * scale, unlabelled * scale, np.zeros(positive.shape[1])
    for step in range(steps):
        sp, su = 1 / (1 + np.exp(-p @ w)), 1 / (1 + np.exp(-u @ w))
        w -= rate * (1 - step / steps) * ((sp - 1) @ p / len(p) + su @ u / len(u) + 0.001 * w)
    return w * scale


def bins(z: np.ndarray) -> np.ndarray:
    """The bin of each score, rising with it."""
    return np.minimum((BINS / (1 + np.exp(-np.clip(z, -30, 30)))).astype(np.int64), BINS - 1)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, doubt: float = 0.1) -> float:
    """The share of positives in unlabelled rows, from counts of kept positives and of unlabelled rows by bins of a score:
    the ratio of the shares above a threshold, at the threshold where it is least with its uncertainty added."""
    n_p, n_u = positive.sum(), unlabelled.sum()
    if not n_p or not n_u:
        return 0.5
    above_p, above_u = (np.cumsum(x[::-1])[::-1] / x.sum() for x in (positive, unlabelled))
    use = above_p > 0
    width = np.sqrt(np.log(4 / doubt) / (2 * n_p)) + np.sqrt(np.log(4 / doubt) / (2 * n_u))
    ratio = above_u[use] / above_p[use]
    return float(np.clip(ratio[np.argmin(ratio + width / above_p[use])], 0.02, 0.98))


def calibrated(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and offset that minimise the unbiased log risk of scores: mean over unlabelled of log(1 + e^t) less prior times the mean over positives of t."""
    middle, spread = unlabelled.mean(), unlabelled.std() or 1.0
    p, u = (positive - middle) / spread, (unlabelled - middle) / spread
    a, b = 1.0, 0.0
    for _ in range(2000):
        s = 1 / (1 + np.exp(-np.clip(a * u + b, -30, 30)))
        a, b = max(a - 2 * (float((s * u).mean()) - prior * float(p.mean()) + 0.001 * a), 0.0), b - 2 * (float(s.mean()) - prior)
    return a / spread, b - a * middle / spread


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, train: np.ndarray) -> Model:
    """From features; train marks the positives that the risk may see, the others calibrate."""
    scale = _scale(positive, unlabelled)
    w = nonnegative_risk(positive[train], unlabelled, prior, scale) * scale
    kept = positive[~train] if (~train).any() else positive
    return Model(w, *calibrated(kept @ w, unlabelled @ w, prior))


def train(docs: DataFrame, labels: DataFrame, learnable, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", rows: int = TRAIN_ROWS) -> Model:
    """Samples positives and unlabelled rows, at most about `rows` of each, estimates the prior over all learnable rows, and fits.

    An id with several labels has the largest of them; rows without an id or a label count for nothing."""
    positives = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label")).where("label = 1").where(learnable(F.col("id"))).select("id")
    texts = docs.where(F.col(text_col).isNotNull() & learnable(F.col(id_col))).select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    spread = F.pmod(F.xxhash64(F.lit("train"), "id"), F.lit(1 << 40))
    schema = fields("o long, x binary")

    def step(batch: dict[str, list]) -> dict[str, list]:
        return {"o": batch["o"], "x": [features(t).tobytes() for t in batch["t"]]}

    def sampled(df: DataFrame, n: int) -> np.ndarray:
        some = df.where(spread < int(min(1.0, 1.2 * rows / n) * (1 << 40))).select(spread.alias("o"), "t") if n else df.limit(0).select(spread.alias("o"), "t")
        found = map_lists(some, lambda: step, schema, rows=100).orderBy("o", "x").limit(int(1.2 * rows)).collect()
        return np.stack([np.frombuffer(r.x, dtype=np.float32) for r in found]) if found else np.empty((0, SLOTS), dtype=np.float32)

    n = positives.count()
    chosen = positives.where(spread < int(min(1.0, 1.2 * rows / n) * (1 << 40))) if n else positives
    positive, unlabelled = sampled(texts.join(chosen, "id", "left_semi"), n), sampled(texts, texts.count())
    if not len(positive):
        return Model(np.zeros(SLOTS), 0.0, 0.0)
    mine = np.arange(len(positive)) % 4 != 3 if len(positive) >= 8 else np.ones(len(positive), bool)
    first = apart(positive[mine], unlabelled, _scale(positive, unlabelled))
    kept = positive[~mine] if (~mine).any() else positive
    prior = estimate_prior(np.bincount(bins(kept @ first), minlength=BINS), counted(texts.select("t"), first))
    return fit(positive, unlabelled, prior, mine)


def counted(texts: DataFrame, weights: np.ndarray) -> np.ndarray:
    """How many of all texts (t) score in each bin."""
    shared = texts.sparkSession.sparkContext.broadcast(weights)  # of fixed size

    def step(batch: dict[str, list]) -> dict[str, list]:
        got = bins(np.array([features(t) @ shared.value for t in batch["t"]], dtype=float))
        found, n = np.unique(got, return_counts=True)
        return {"bin": found.tolist(), "n": n.tolist()}

    out = np.zeros(BINS, dtype=np.int64)
    for r in map_lists(texts, lambda: step, fields("bin int, n long")).groupBy("bin").agg(F.sum("n").alias("n")).collect():  # BINS rows at most
        out[r.bin] = r.n
    return out


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs with score and predicted (1 from the threshold on)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def step(texts: list) -> dict[str, list]:
        got = [shared.value.score(t) for t in texts]
        return {"score": got, "predicted": [int(x >= threshold) for x in got]}

    return add_columns(docs, lambda: step, text_col, fields("score double, predicted int"))
