"""Mergeable aggregate states of stored tables (AGG-1..9, AGG-10, AGG-22, FLT-8).

For every batch of a table a state is stored per day and dimensions: counts, exact decimal sums and
maxima. States of any batches and days merge by adding and comparing, so a dashboard reads a
few rows a day, and neither the facts nor, for privacy findings, the texts and their detectors.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import FactStore

#: Doubles are added as decimals, so that sums do not depend on the order of batches.
EXACT = "decimal(38,18)"


@dataclass(frozen=True)
class Rollup:
    """``dims`` and the columns that are counted (``flags``: rows where true), added and maximised per day."""

    store: FactStore
    table: str
    dims: tuple[str, ...]
    flags: dict[str, Column] = field(default_factory=dict)
    sums: dict[str, Column] = field(default_factory=dict)
    maxima: dict[str, Column] = field(default_factory=dict)
    time: str = "created_at"

    @property
    def states(self) -> str:
        return f"{self.table}.states"

    def advance(self) -> bool:
        """Store the states of the batches that have none yet, in one pass over them; False if there are none."""
        done, last = self.store.last_batch(self.states), self.store.last_batch(self.table)
        if last <= done:
            return False
        new = self.store.read(self.table, done).groupBy(F.to_date(self.time).alias("day"), *self.dims).agg(
            F.count("*").alias("n"), *[F.count_if(c).alias(n) for n, c in self.flags.items()],
            *[F.sum(c.cast(EXACT)).alias(n) for n, c in self.sums.items()], *[F.max(c).alias(n) for n, c in self.maxima.items()])
        return self.store.append(self.states, new, last, "day")

    def merged(self, *by: str, since: str | None = None) -> DataFrame:
        """One row per ``by`` (dimensions or day): n and the measures over all stored days, or those from ``since`` on."""
        states = self.store.read(self.states)
        if since:
            states = states.where(F.col("day") >= F.lit(since).cast("date"))
        added = ("n", *self.flags, *self.sums)
        return states.groupBy(*by).agg(*[F.sum(c).alias(c) for c in added], *[F.max(c).alias(c) for c in self.maxima])


def average(total: str, n: str = "n") -> Column:
    """The mean from an exact sum, 0 for no rows."""
    return F.when(F.coalesce(F.col(n), F.lit(0)) == 0, F.lit(0.0)).otherwise((F.col(total) / F.col(n)).cast("double"))
