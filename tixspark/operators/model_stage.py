"""Model inference over batches with a time limit and a fallback per row (SIM-5, SCR-20).

A model is loaded once by each worker and asked for a batch of texts at a time. Where a batch fails, its rows are asked for one by one;
rows that fail, take too long or come back in the wrong shape get no answer, and the caller's deterministic
form answers for them: the lexical vector for embeddings, the fallback decision for routing. If the model can't be
loaded at all, every row goes that way, as the reference does without a local model.

A call that outlives its limit can't be stopped; it keeps its thread, further calls get a new one, and after
``MAX_LATE`` of them the worker asks the model no more.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as LateError

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions.text import model_decision
from ..functions.vectors import embed_text

# Worker-side code is shipped by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_LATE = 3
#: Texts -> answers, one each; built by a loader that runs on the worker.
Model = Callable[[Sequence[str]], Sequence]
Loader = Callable[[], Model]


class Asker:
    """Asks a model in time; counts what it could not answer."""

    def __init__(self, loader: Loader, limit_s: float) -> None:
        self.limit_s, self.late = limit_s, 0
        self.pool = ThreadPoolExecutor(1)
        try:
            self.model: Model | None = loader()
        except Exception:  # noqa: BLE001  whatever the model's library raises, rows have their fallback
            self.model = None

    def call(self, texts: Sequence[str]) -> list | None:
        if self.model is None or self.late >= MAX_LATE:
            return None
        job = self.pool.submit(self.model, texts)
        try:
            out = list(job.result(timeout=self.limit_s))
        except LateError:
            self.late += 1
            self.pool = ThreadPoolExecutor(1)
            return None
        except Exception:  # noqa: BLE001
            return None
        return out if len(out) == len(texts) else None

    def answers(self, texts: Sequence[str]) -> list:
        """An answer or None for each text."""
        late = self.late
        out = self.call(texts)
        if out is not None:
            return out
        if self.late > late and len(texts) == 1:
            return [None]
        return [(one[0] if (one := self.call([t])) is not None else None) for t in texts] if len(texts) > 1 else [None]


def _in_batches(texts: pd.Series, asker: Asker, rows: int) -> Iterator:
    for at in range(0, len(texts), rows):
        part = [t if t is not None else "" for t in texts.iloc[at : at + rows]]
        yield from asker.answers(part)


def model_embedding(text: Column, dim: int, loader: Loader, limit_s: float = 30.0, rows: int = 64) -> Column:
    """array<float> of the model, scaled to length 1; null where it gave no usable vector of ``dim`` numbers."""

    def usable(v) -> list | None:
        try:
            x = np.asarray(v, np.float64)
        except (TypeError, ValueError):
            return None
        if x.shape != (dim,) or not np.isfinite(x).all():
            return None
        n = np.linalg.norm(x)
        return (x / n if n else x).astype(np.float32)

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        asker = Asker(loader, limit_s)
        for batch in batches:
            yield pd.Series([None if a is None else usable(a) for a in _in_batches(batch, asker, rows)], dtype="object")

    return run(text)


def embed_with(loader: Loader, limit_s: float = 30.0, rows: int = 64) -> Callable[[Column, int], Column]:
    """An embedding function for :func:`~tixspark.operators.route.route_tickets`: the model's vector, or the lexical one."""
    return lambda text, dim: F.coalesce(model_embedding(text, dim, loader, limit_s, rows), embed_text(text, dim))


def model_answers(text: Column, loader: Loader, limit_s: float = 30.0, rows: int = 8) -> Column:
    """The model's answer to each prompt, null where it gave none."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        asker = Asker(loader, limit_s)
        for batch in batches:
            yield pd.Series([a if isinstance(a, str) else None for a in _in_batches(batch, asker, rows)], dtype="object")

    return run(text)


def decide_with(loader: Loader, prompt: Callable[[DataFrame], Column], limit_s: float = 30.0, rows: int = 8) -> Callable[[DataFrame], DataFrame]:
    """A decision function for :func:`~tixspark.operators.route.route_tickets`: the model's JSON decision for the rows that need one,
    the deterministic decision where there is none or it can't be read. Cached rows are not asked for."""

    def decide(df: DataFrame) -> DataFrame:
        asked = df.where("needs_decision").withColumn("__answer", model_answers(prompt(df), loader, limit_s, rows))
        # Told apart, so that only the rows that need a decision reach the model.
        both = asked.unionByName(df.where("not needs_decision").withColumn("__answer", F.lit(None).cast("string")))
        told = model_decision(F.col("__answer"))
        usual = S.fallback_decision(F.col("assigned_category"), F.col("retrieved"), F.col("review_reason"))
        fields = ("steps", "escalation_required", "confidence", "rationale")
        full = S.complete_steps(told, F.col("assigned_category"), F.col("retrieved"))
        model = F.struct(*[full[n].alias(n) for n in fields])
        best = F.when(F.col("__answer").isNotNull() & told["parsed"], model).otherwise(F.struct(*[usual[n].alias(n) for n in fields]))
        return both.withColumn("decision", F.when(F.col("needs_decision"), best)).withColumn(
            "decided_by_model", F.coalesce(F.col("needs_decision") & F.col("__answer").isNotNull() & told["parsed"], F.lit(False))).drop("__answer")

    return decide
