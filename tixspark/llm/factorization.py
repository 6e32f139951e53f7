"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): the
interactions of all pairs of features in time linear in their number. Word features are square
roots of relative frequencies; statistics of the structure (shares of kinds of characters,
repetition, lengths) and the length given in ``n_chars`` are features of their own.

It is fitted on at most ``SAMPLE`` labelled rows, those with the smallest hash of doc_id; only
their features reach the driver. Scoring reads whole texts.

Defined results: null and empty texts have the features of an empty text and get a score like
any other; a null ``n_chars`` stands for the text's length; rows of ``labels`` with nulls, and
documents with several different labels, are not learned from; with no labels or one class only,
all scores are that class's share (0.5 without any); repeated rows get the same score; columns
besides doc_id, text, n_chars and the labels are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shingles import _LOWER, _Powers, _cut, _word_hashes

SAMPLE, BUCKETS, RANK, EPOCHS, BATCH, RATE, DECAY, SEED = 12_000, 1 << 15, 8, 12, 64, 0.05, 1e-5, 7
STATISTICS = (
    "bias", "log length", "log given length", "log words", "word length", "upper case", "digits", "symbols", "other characters",
    "marks", "spaces", "line feeds", "capitals in a row", "same byte again", "distinct words", "most frequent word", "distinct pairs", "lines",
    "repeated lines",
)
_KIND = np.zeros(256, np.uint8)  # 1 upper, 2 lower, 3 digit, 4 mark, 5 symbol, 6 space, 7 line feed, 8 beyond ASCII
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 1, 2, 3, 8
_KIND[[i for i in range(33, 127) if not chr(i).isalnum()]] = 5
_KIND[[ord(c) for c in ".,;:'\"!?()-"]] = 4
_KIND[[32, 9, 11, 12, 13]], _KIND[10] = 6, 7


def features(text: str | None, given: float | None, powers: _Powers) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text's features: words first, then BUCKETS + the place in STATISTICS."""
    data = (text or "").encode("utf-8", "replace")
    raw = np.frombuffer(data, np.uint8)
    n = max(1, len(raw))
    kind = np.zeros(9)
    upper_runs = same = 0
    for i in range(0, len(raw), 1 << 20):
        k = _KIND[raw[i : i + (1 << 20)]]
        kind += np.bincount(k, minlength=9)
        upper_runs += int(((k[1:] == 1) & (k[:-1] == 1)).sum())
        same += int((raw[i + 1 : i + (1 << 20)] == raw[i : i + (1 << 20) - 1][: max(0, min(1 << 20, len(raw) - i) - 1)]).sum())
    low = data.translate(_LOWER)
    with np.errstate(over="ignore"):
        words = np.concatenate([_word_hashes(p, powers)[1] for p in _cut(low)]) if low else np.zeros(0, np.uint64)
        pairs = words[1:] * np.uint64(3) + words[:-1]
    m = max(1, len(words))
    bucket, count = np.unique((words >> np.uint64(64 - (BUCKETS.bit_length() - 1))).astype(np.int64), return_counts=True)
    lines = [x for x in (text or "").split("\n") if x.strip()]
    share = kind / n
    stats = np.array([
        1.0, np.log1p(len(raw)) / 8, np.log1p(given if given is not None and given == given and given >= 0 else len(text or "")) / 8, np.log1p(len(words)) / 8,
        min(len(raw) / m, 40) / 10, share[1] * 2, share[3] * 4, share[5] * 4, share[8] * 2, share[4] * 4, share[6] * 2, np.sqrt(share[7]) * 2,
        upper_runs / n * 2, same / n * 4, len(np.unique(words)) / m, (count.max() if len(count) else 0) / m * 2,
        len(np.unique(pairs)) / m, np.log1p(len(lines)) / 4, 1 - len(set(lines)) / max(1, len(lines)),
    ])
    return np.concatenate((bucket, BUCKETS + np.arange(len(stats)))).astype(np.int32), np.concatenate((np.sqrt(count / m), stats)).astype(np.float32)


@dataclass
class Machine:
    w: np.ndarray
    v: np.ndarray
    share: float | None = None  # of label 1, where there is nothing to tell classes by

    def margin(self, idx: np.ndarray, val: np.ndarray) -> float:
        vx = self.v[idx] * val[:, None]
        s = vx.sum(0)
        return float(self.w[idx] @ val + 0.5 * (s @ s - (vx * vx).sum()))

    def score(self, idx: np.ndarray, val: np.ndarray) -> float:
        if self.share is not None:
            return self.share
        return float(1 / (1 + np.exp(-np.clip(self.margin(idx, val), -30, 30))))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> Machine:
    """Mini-batch Adagrad on the logistic loss; classes weigh the square root of their inverse shares."""
    y = np.array([r[2] for r in rows], np.float64)
    size = BUCKETS + len(STATISTICS)
    rng = np.random.default_rng(SEED)
    w, v = np.zeros(size, np.float32), rng.normal(0, 0.02, (size, RANK)).astype(np.float32)
    if len(y) == 0 or y.min() == y.max():
        return Machine(w, v, float(y.mean()) if len(y) else 0.5)
    gw, gv = np.full(size, 1e-2, np.float32), np.full((size, RANK), 1e-2, np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            idx = np.concatenate([rows[i][0] for i in part])
            val = np.concatenate([rows[i][1] for i in part])
            cuts = np.cumsum([0, *[len(rows[i][0]) for i in part]])[:-1]
            own = np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part])
            vx = v[idx] * val[:, None]
            s = np.add.reduceat(vx, cuts, axis=0)
            z = np.add.reduceat(w[idx] * val, cuts) + 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), cuts))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)
            gx = (g[own] * val).astype(np.float32)
            uniq, inv = np.unique(idx, return_inverse=True)
            dw = np.bincount(inv, gx, len(uniq)).astype(np.float32) + DECAY * w[uniq]
            gain = gx[:, None] * (s[own] - vx)
            dv = np.stack([np.bincount(inv, gain[:, f], len(uniq)) for f in range(RANK)], 1).astype(np.float32) + DECAY * v[uniq]
            gw[uniq] += dw * dw
            gv[uniq] += dv * dv
            w[uniq] -= RATE * 4 * dw / np.sqrt(gw[uniq])
            v[uniq] -= RATE * dv / np.sqrt(gv[uniq])
    return Machine(w, v)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """``labels`` has doc_id and label (0 or 1). At most ``sample`` labelled rows are used."""
    one = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_top"))
    rank = F.xxhash64("doc_id")
    chosen = one.where("label = _top").orderBy(rank, "doc_id").limit(sample).select("doc_id", "label")
    rows = docs.select("doc_id", "text", "n_chars").join(F.broadcast(chosen), "doc_id")

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = _Powers()
        for batch in batches:
            got = [features(t, g, powers) for t, g in zip(batch["text"], batch["n_chars"], strict=True)]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "label": batch["label"].astype(int), "idx": [x[0].tobytes() for x in got], "val": [x[1].tobytes() for x in got]
            })

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = rows.mapInPandas(extract, f"doc_id {kind}, label int, idx binary, val binary")
    # A document that is there more than once counts as one row, that of the least features.
    got = got.groupBy("doc_id").agg(F.min(F.struct("idx", "val", "label")).alias("r")).select("doc_id", "r.*").toPandas().sort_values("doc_id")
    return train([(np.frombuffer(i, np.int32), np.frombuffer(x, np.float32), int(y)) for i, x, y in zip(got["idx"], got["val"], got["label"], strict=True)])


def quality(text: Column, n_chars: Column, machine: Machine) -> Column:
    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        powers = _Powers()
        for texts, given in batches:
            yield pd.Series([machine.score(*features(t, g, powers)) for t, g in zip(texts, given, strict=True)], dtype="float64")

    return run(text, n_chars)
