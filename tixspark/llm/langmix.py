"""Language identification by mixture inference.

Character trigram counts per language are gathered with Spark over all labelled rows. A
document is read as a mixture of languages: its trigrams are taken in runs of ``RUN``, each run
gets a likelihood under every language, and expectation-maximisation finds the proportions.
Languages are then taken in order of proportion, and the number of them is the one with the
best likelihood less a penalty of ``PENALTY`` * log(runs + 1) for each language; languages of less
than half a run are not tried.

Defined results: null texts and texts without a letter are ``und`` with score 0; ties go to the
language that sorts first; repeated rows get the same answer; without labelled text every
document is ``und``; columns besides doc_id, text and lang are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS, RUN, ROUNDS, PENALTY, SMOOTH = 1 << 15, 48, 12, 2.0, 0.1
#: Characters worked on at once; bounds a task's memory whatever the lengths of texts.
PIECE = 1 << 19
#: Most languages of a model, which every task holds: BUCKETS numbers of four bytes for each. More values of lang are an error before any text is read.
LANGUAGES = 1000


#: Code points with letters: the first four planes, one more for all others.
_PLANES = 0x40000


def letter_table() -> np.ndarray:
    """Code point -> lower-case letter's code point, 0 if it is no letter."""
    out = np.zeros(_PLANES + 1, np.uint32)
    for i in range(_PLANES):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def _codes(text: str, letters: np.ndarray) -> np.ndarray:
    cp = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return letters[np.minimum(cp, _PLANES)]


def _buckets(codes: np.ndarray) -> np.ndarray:
    """Buckets of the trigrams with a letter in the middle; every run of other characters counts as one space."""
    keep = (codes > 0) | np.append(codes[1:] > 0, False)
    c = codes[keep].astype(np.uint64)
    c = np.concatenate((np.zeros(1, np.uint64), c, np.zeros(1, np.uint64)))
    if len(c) < 3:
        return np.zeros(0, np.int64)
    h = c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:] * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(49)).astype(np.int64)[c[1:-1] > 0]


def _pieces(text: str) -> Iterator[str]:
    return (text[i : i + PIECE] for i in range(0, len(text), PIECE))


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    letters, counts = letter_table(), {}
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            have = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for piece in _pieces(text):
                have += np.bincount(_buckets(_codes(piece, letters)), minlength=BUCKETS)
    for lang, have in counts.items():
        at = np.flatnonzero(have)
        yield pd.DataFrame({"lang": lang, "bucket": at.astype(np.int32), "n": have[at]})


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # bucket x language: log probability


def fit(docs: DataFrame) -> Model:
    """Count the trigrams of every row with text and lang. The driver gets the sums only: BUCKETS numbers a language."""
    rows = docs.where("text is not null and lang is not null").select("lang", "text")
    if rows.select("lang").distinct().limit(LANGUAGES + 1).count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} different values of lang")
    sums = rows.mapInPandas(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(BUCKETS)
        counts[group["bucket"]] = group["n"]
        return pd.DataFrame({"lang": group["lang"].iloc[:1], "counts": [counts.astype("<f8").tobytes()]})

    got = sums.groupBy("lang").applyInPandas(pack, "lang string, counts binary").collect()
    got = sorted(got, key=lambda r: r["lang"])
    w = np.full((BUCKETS, len(got)), SMOOTH)
    for j, r in enumerate(got):
        w[:, j] += np.frombuffer(r["counts"], "<f8")
    return Model([r["lang"] for r in got], np.log(w / w.sum(0)).astype(np.float32) if got else w.astype(np.float32))


def _mixture(like: np.ndarray, size: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Proportions of the columns of ``like`` (runs x languages) and the log likelihood that they give."""
    pi = np.full(like.shape[1], 1 / like.shape[1])
    for _ in range(rounds):
        part = like * pi
        part *= (size / part.sum(1))[:, None]
        pi = part.sum(0) / size.sum()
    return pi, float(np.log((like * pi).sum(1)).sum())


def predict(text: str | None, model: Model, letters: np.ndarray) -> tuple[str, float, list[str], list[float]]:
    """(language, its proportion, the languages chosen, their proportions)."""
    if not text or not model.languages:
        return "und", 0.0, [], []
    scores, sizes = [], []
    for piece in _pieces(text):
        b = _buckets(_codes(piece, letters))
        if len(b):
            cuts = np.arange(0, len(b), RUN)
            scores.append(np.add.reduceat(model.weights[b], cuts, axis=0))
            sizes.append(np.diff(np.append(cuts, len(b))))
    if not scores:
        return "und", 0.0, [], []
    score, size = np.concatenate(scores).astype(np.float64), np.concatenate(sizes).astype(np.float64)
    like = np.exp(np.maximum(score - score.max(1, keepdims=True), -60))
    pi, _ = _mixture(like, size, ROUNDS)
    order = np.argsort(-pi, kind="stable")
    cost = PENALTY * np.log(len(like) + 1)
    best = None
    for k in range(1, len(order) + 1):
        if k > 1 and pi[order[k - 1]] * len(like) < 0.5:
            break  # less than half a run: it cannot pay for itself
        share, fit_ = _mixture(like[:, order[:k]], size, ROUNDS) if k > 1 else (np.ones(1), float(np.log(like[:, order[0]]).sum()))
        if best is None or fit_ - cost * k > best[0]:
            best = (fit_ - cost * k, order[:k], share)
    _, chosen, share = best
    top = int(np.argmax(share))
    score = float(share[top] if len(chosen) > 1 else pi[chosen[0]])
    return model.languages[chosen[top]], min(1.0, max(0.0, score)), [model.languages[i] for i in chosen], share.tolist()


def language(text: Column, model: Model) -> Column:
    """struct(lang_pred, score, languages, proportions) of a text column."""

    @F.pandas_udf("lang_pred string, score double, languages array<string>, proportions array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        letters = letter_table()
        for texts in batches:
            out = [predict(t, model, letters) for t in texts]
            yield pd.DataFrame(out, columns=["lang_pred", "score", "languages", "proportions"])

    return run(text)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, lang_pred, score, languages, proportions."""
    return docs.select("doc_id", language(F.col("text"), model).alias("l")).select("doc_id", "l.*")


def reject_unknown(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows whose language is ``und``, all columns kept."""
    found = docs.withColumn("__l", language(F.col("text"), model))
    return found.where(F.col("__l.lang_pred") != "und").drop("__l")
