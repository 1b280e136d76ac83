"""Language ID: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy, with calibrated rejection.

A text's subwords are the byte 3- and 4-grams inside its words (A-Z folded, every run of other ASCII characters one
boundary). Their embeddings, found by hash, are averaged over the whole text and classified by a linear softmax. A
temperature, and the probability under which a prediction is rejected, are fitted on labelled texts kept from training.
Training reads a bounded sample of labelled rows (about TRAIN_ROWS, whole texts, of which tasks send the shares of their
buckets only), as many of each language as can be; beyond the MANY commonest languages, all others are sampled alike.

Defined results: a null text, or one without any letter (Unicode L), is `und` with score 0 and is rejected; no labelled row:
all are `und`; equal texts, equal predictions; other columns are kept; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, fields, map_lists

#: Labelled rows that training may read, and languages that are sampled each by itself.
TRAIN_ROWS, MANY = 3000, 200
BUCKETS, DIMENSIONS = 1 << 15, 8
#: Characters of a piece from a text's middle, by which short texts are learnt too.
SHORT = 60
_WORDS = re.compile(r"[^\W\d_]+")  # letters, and numerals that are no decimal digits
#: Bytes as the subwords see them: A-Z folded, other ASCII that is no letter a boundary.
_CLASS = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], dtype=np.uint8)
_CHUNK = 1 << 20


def subwords(text: str) -> Iterator[np.ndarray]:
    """Buckets of all subwords of the text, in parts of bounded size."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    for at in range(0, max(1, len(raw)), _CHUNK):
        b = np.concatenate(([np.uint8(32)] if at == 0 else [], _CLASS[raw[max(0, at - 3 * (at > 0)) : at + _CHUNK]], [np.uint8(32)] if at + _CHUNK >= len(raw) else [])).astype(np.uint32)
        gap = b == 32
        out = []
        if len(b) >= 3:
            keep = ~gap[1:-1]
            out.append(((b[:-2] * 0x9E3779B1 + b[1:-1] * 0x85EBCA77 + b[2:] * 0xC2B2AE3D)[keep] * np.uint32(0x27D4EB2F)) >> np.uint32(17))
        if len(b) >= 4:
            keep = ~(gap[1:-2] | gap[2:-1])
            out.append(((b[:-3] * 0x165667B1 + b[1:-2] * 0x9E3779B1 + b[2:-1] * 0x85EBCA77 + b[3:] * 0xC2B2AE3D)[keep] * np.uint32(0x2C1B3C6D)) >> np.uint32(17))
        if out:
            yield np.concatenate(out)


def has_letter(text: str) -> bool:
    return any(c.isalpha() for m in _WORDS.finditer(text) for c in m.group())


Bag = tuple[np.ndarray, np.ndarray]


def bag(text: str) -> Bag:
    """The buckets of a text's subwords, and the share of each."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    for b in subwords(text):
        total += np.bincount(b, minlength=BUCKETS)
    found = np.flatnonzero(total)
    return found.astype(np.int32), (total[found] / max(1, total.sum())).astype(np.float32)


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # what each bucket adds to each label's logit
    bias: np.ndarray
    temperature: float
    reject_below: float

    def probabilities(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.labels)), 0
        for b in subwords(text):
            total += self.table[b].sum(axis=0, dtype=np.float64)
            n += len(b)
        return self._softmax(total / max(n, 1))

    def _softmax(self, logits: np.ndarray) -> np.ndarray:
        z = (logits + self.bias) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def of_bag(self, bag: Bag) -> np.ndarray:
        return self._softmax((self.table[bag[0]] * bag[1][:, None]).sum(axis=0, dtype=np.float64))

    def predict(self, text: object) -> tuple[str, float, bool]:
        if not self.labels or not isinstance(text, str) or not has_letter(text):
            return "und", 0.0, True
        p = self.probabilities(text)
        best = int(p.argmax())
        return self.labels[best], float(p[best]), bool(p[best] < self.reject_below)


def sgd(bags: list[Bag], targets: np.ndarray, classes: int, epochs: int = 6, rate: float = 6.0, seed: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings, weights and bias of the averaged-embedding softmax, by mini-batches."""
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights, bias = rng.normal(0, 0.5, (DIMENSIONS, classes)).astype(np.float32), np.zeros(classes, np.float32)
    use = np.array([i for i, b in enumerate(bags) if len(b[0])], dtype=np.int64)
    for epoch in range(epochs if len(use) else 0):
        step = rate * (1 - epoch / epochs)
        for batch in np.array_split(rng.permutation(use), max(1, len(use) // 32)):
            where = np.concatenate([bags[i][0] for i in batch])
            share = np.concatenate([bags[i][1] for i in batch])
            owner = np.repeat(np.arange(len(batch)), [len(bags[i][0]) for i in batch])
            starts = np.concatenate(([0], np.flatnonzero(np.diff(owner)) + 1))
            hidden = np.add.reduceat(embed[where] * share[:, None], starts, axis=0)
            z = hidden @ weights + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(batch)), targets[batch]] -= 1
            back = (p @ weights.T)[owner] * share[:, None]
            weights -= step / len(batch) * (hidden.T @ p)
            bias -= step / len(batch) * p.sum(axis=0)
            slots, at = np.unique(where, return_inverse=True)
            change = np.stack([np.bincount(at, back[:, d], len(slots)) for d in range(DIMENSIONS)], axis=1)
            embed[slots] -= (step * change).astype(np.float32)
    return embed, weights, bias


def learnt(text: str) -> tuple[Bag, Bag]:
    """What is learnt of a text: the whole, and a short piece of its middle."""
    middle = len(text) // 2
    return bag(text), bag(text[middle : middle + SHORT])


def fit(rows: list[tuple[str, str]], keep: float = 0.999) -> Model:
    """From (text, label)."""
    return fit_bags([(*learnt(text), label) for text, label in rows], keep)


def fit_bags(rows: list[tuple[Bag, Bag, str]], keep: float = 0.999) -> Model:
    """From (whole, piece, label); every fifth row calibrates. Predictions under the (1 - keep) quantile of the right ones' probabilities are rejected."""
    labels = sorted({label for *_, label in rows})
    if not labels:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    place = {label: i for i, label in enumerate(labels)}
    target = np.array([place[label] for *_, label in rows])
    tuned = np.arange(len(rows)) % 5 == 4 if len(rows) >= 50 else np.zeros(len(rows), bool)
    bags, targets = [], []
    for i in np.flatnonzero(~tuned):
        bags += rows[i][:2]
        targets += [target[i]] * 2
    embed, weights, bias = sgd(bags, np.array(targets), len(labels))
    model = Model(labels, (embed @ weights).astype(np.float32), bias.astype(np.float64), 1.0, 0.0)
    if tuned.any():
        p = np.stack([model.of_bag(rows[i][0]) for i in np.flatnonzero(tuned)])
        logits, right = np.log(np.maximum(p, 1e-12)), target[tuned]
        scale = np.geomspace(0.1, 10, 61)

        def loss(t: float) -> float:
            z = logits / t
            return float((np.log(np.exp(z - z.max(1, keepdims=True)).sum(1)) + z.max(1) - z[np.arange(len(z)), right]).mean())

        model.temperature = float(min(scale, key=loss))
        z = np.exp((logits - logits.max(1, keepdims=True)) / model.temperature)
        sure = (z / z.sum(1, keepdims=True))[np.arange(len(z)), right]
        sure = sure[logits.argmax(1) == right]
        model.reject_below = min(float(np.quantile(sure, 1 - keep)) * 0.9, 0.5) if len(sure) else 0.0
    return model


def train(docs: DataFrame, learnable, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", rows: int = TRAIN_ROWS) -> Model:
    """Fits a model on at most about `rows` labelled rows of docs where learnable holds."""
    labelled = docs.where(learnable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    by_lang = labelled.groupBy(lang_col).count()
    counts = by_lang.orderBy(F.desc("count"), lang_col).limit(MANY).collect()
    if not counts:
        return fit([])
    others, theirs = by_lang.agg(F.count(F.lit(1)), F.sum("count")).first()
    others, theirs = others - len(counts), theirs - sum(n for _, n in counts)
    spread = F.pmod(F.xxhash64(F.lit("train"), id_col, text_col), F.lit(1 << 40))
    each = -(-rows // (len(counts) + (others > 0)))
    common = F.col(lang_col).isin([lang for lang, _ in counts])
    chosen = ~common & (spread < int(min(1.0, 1.2 * each / max(1, theirs)) * (1 << 40)))
    for lang, n in counts:
        chosen = chosen | ((F.col(lang_col) == lang) & (spread < int(min(1.0, 1.2 * each / n) * (1 << 40))))
    schema = fields("o long, l string, whole_at binary, whole binary, piece_at binary, piece binary")

    def step(batch: dict[str, list]) -> dict[str, list]:
        out = [(o, label, *(x.tobytes() for part in learnt(text) for x in part)) for o, text, label in zip(batch["o"], batch["t"], batch["l"])]
        return dict(zip(schema.names, map(list, zip(*out)))) if out else {n: [] for n in schema.names}

    found = map_lists(labelled.where(chosen).select(spread.alias("o"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")), lambda: step, schema, rows=100)
    sample = found.orderBy("o", "l", "whole").limit(rows + rows // 5).collect()
    both = lambda at, share: (np.frombuffer(at, np.int32), np.frombuffer(share, np.float32))
    return fit_bags([(both(r.whole_at, r.whole), both(r.piece_at, r.piece), r.l) for r in sample])


def predict(docs: DataFrame, model: Model, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with lang_pred, score and rejected (names after prefix, which must make them new)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages of the bounded sample

    added = fields(f"`{prefix}lang_pred` string, `{prefix}score` double, `{prefix}rejected` boolean")

    def step(texts: list) -> dict[str, list]:
        return dict(zip(added.names, map(list, zip(*map(shared.value.predict, texts)))))

    return add_columns(docs, lambda: step, text_col, added)


def recognised(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs whose language is not rejected, with their own columns, whatever their names."""
    found = predict(docs.select(F.col(f"`{text_col}`").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")), model)
    return found.where("not rejected").select("doc.*")
