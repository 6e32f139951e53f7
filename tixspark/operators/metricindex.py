"""A stored metric index for exact top-k cosine search (JOIN-5, SIM-3, WIN-1).

Vectors are stored once, by cells: a cell is a centre (one of the vectors, chosen by a hash) and the vectors nearest to it,
with the greatest angle between them, the radius. A query at an angle ``g`` from a centre is at least
``g - radius`` from everything in the cell. So a search first visits the ``FIRST`` most promising
cells of each query, takes the similarity of its k-th hit, and then compares just those cells that may
hold something as near. The answer is exact, with the order of ties of :func:`~tixspark.operators.topk.topk_similar`;
how many cells a query read is reported. In the first visits, stored vectors meet the
queries of their cell in a sorted stream, in which only the vectors of one cell part (``PART``) are held.
After that queries may want any number of cells, so that neither side is copied for a visit: blocks of neighbouring
cells pass blocks of queries (:mod:`~tixspark.operators.blocks`), and each query is compared with the cells it wants.

New batches of the vectors' table go to the centres that are there: radii and counts merge.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir, staged
from ..sources.store import FactStore
from .blocks import Wanted, pack, scan

# Worker-side code is shipped by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows per centre aimed at, centres of one vector length (they are held by every task), vectors of a cell part.
ROWS, CENTRES, PART = 2048, 4096, 8192
#: Rows of a block of stored vectors.
BLOCK = 4096
#: Cells that a query visits first; visits of one part that one task works on.
FIRST, VISITS = 2, 1 << 16
#: Allowance for rounding in bounds, as an angle and as a similarity.
SLACK = 1e-7
#: The cell of vectors that have no direction (null, empty, zero, not finite).
NOWHERE = -1

Centres = dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # by length: cells, unit vectors, radii


def _usable(v: str) -> Column:
    return F.expr(f"{v} is not null and exists({v}, x -> x != 0) and forall({v}, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")


def _units(vectors: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centres.T, -1.0, 1.0))


@dataclass(frozen=True)
class MetricIndex:
    """An index over the stored table ``table`` with an id, a vector and the columns that order ties."""

    store: FactStore
    table: str
    id: str
    vector: str
    order: tuple[str, ...] = ()
    rows: int = ROWS

    @property
    def cells(self) -> str:
        return f"{self.table}.cells"

    @property
    def spheres(self) -> str:
        return f"{self.table}.spheres"

    # -- building -----------------------------------------------------------------------

    def advance(self) -> bool:
        """Index the batches that are not indexed yet."""
        done, last = self.store.last_batch(self.spheres), self.store.last_batch(self.table)
        if last <= done:
            return False
        order = tuple(c for c in self.order if c != self.id)
        new = self.store.read(self.table, done).select(F.col(self.id).alias("id"), F.col(self.vector).cast("array<double>").alias("vec"), *order)
        known = self._centres() if done >= 0 else {}
        fresh = self._choose(new, known)
        centres = {**known, **fresh}
        names = ["cell", "angle"]

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                cell, angle = np.full(len(b), NOWHERE, np.int64), np.zeros(len(b))
                usable = b.pop("usable").to_numpy()
                lengths = b["vec"].map(lambda v: len(v) if v is not None else 0).to_numpy()
                for n in np.unique(lengths[usable]).tolist():
                    at = np.flatnonzero(usable & (lengths == n))
                    keys, units, _ = centres[n]
                    step = max(1, (1 << 21) // len(keys))
                    for a in range(0, len(at), step):
                        some = at[a : a + step]
                        g = _angles(_units(b["vec"].iloc[some]), units)
                        cell[some], angle[some] = keys[g.argmin(1)], g.min(1)
                yield b.assign(**dict(zip(names, (cell, angle), strict=True)))

        rows = new.withColumn("usable", _usable("vec"))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema.fields) + ", cell long, angle double"
        self.store.append(self.cells, rows.mapInPandas(assign, schema), last, "cell", ("id",))
        stored = self.store.read(self.cells, done)
        sizes = stored.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n"))
        chosen = [(int(c), n, u.tolist()) for n, (cells, units, _) in fresh.items() for c, u in zip(cells, units, strict=True)]
        chosen = self.store.spark.createDataFrame(chosen, "cell long, length int, centre array<double>")
        self.store.append(self.spheres, sizes.join(chosen, "cell", "full"), last, "cell")
        return True

    def _choose(self, new: DataFrame, known: Centres) -> Centres:
        """Centres for the vector lengths that have none: vectors taken by a hash of their ids, one per ``rows`` and at most CENTRES."""
        usable = new.where(_usable("vec")).select(F.size("vec").alias("length"), F.xxhash64("id", "vec").alias("h"), "vec")
        if known:
            usable = usable.where(~F.col("length").isin(list(known)))
        many = {r["length"]: r["n"] for r in usable.groupBy("length").agg(F.count("*").alias("n")).collect()}
        if not many:
            return {}
        wanted = {n: min(CENTRES, math.ceil(m / self.rows)) for n, m in many.items()}
        share = F.element_at(F.create_map(*[F.lit(x) for n in many for x in (n, wanted[n] / many[n])]), F.col("length"))
        top = F.lit(2.0**63) * (2 * share - 1)
        first = usable.groupBy("length").agg(F.min_by("vec", "h").alias("vec"))
        taken = usable.where(F.col("h") < top).select("length", "vec").unionByName(first)
        out: Centres = {}
        for n, rows in taken.distinct().toPandas().groupby("length"):  # about CENTRES rows of each length
            units = np.unique(_units(rows["vec"]), axis=0)
            out[int(n)] = (np.arange(len(units)) + (int(n) << 24), units, np.zeros(len(units)))
        return out

    def _centres(self) -> Centres:
        s = self.store.read(self.spheres).where(F.col("cell") != NOWHERE).groupBy("cell").agg(
            F.max("length").alias("length"), F.max("radius").alias("radius"), F.max_by("centre", F.size("centre")).alias("centre"))
        return {
            int(n): (g["cell"].to_numpy(np.int64), np.stack([np.asarray(c) for c in g["centre"]]), g["radius"].fillna(-np.inf).to_numpy())
            for n, g in s.toPandas().sort_values("cell").groupby("length")
        }

    # -- searching ----------------------------------------------------------------------

    def nearest(self, queries: DataFrame, k: int, query_id: str, query_vec: str, exclude_self: bool = False, fast_threshold: float = 0.95) -> DataFrame:
        """(query_id, rank, id, similarity, fast_candidate, cells_read, order columns) of each query's k nearest."""
        centres = self._centres()
        q = queries.select(F.col(query_id).alias("qid"), F.col(query_vec).cast("array<double>").alias("qv"))
        q = q.withColumn("ok", _usable("qv"))
        checkpoint_dir(q.sparkSession)
        first = self._visits(q.where("ok"), centres).checkpoint()
        order = tuple(c for c in self.order if c != self.id)
        found = self._meet(first, k, exclude_self, order).checkpoint()
        best = Window.partitionBy("qid").orderBy(F.col("similarity").desc())
        least = found.select("qid", "similarity", F.row_number().over(best).alias("r")).where(F.col("r") == k).select("qid", F.col("similarity").alias("least"))
        rest = staged(q.where("ok").join(least, "qid", "left").select("qid", "least", "qv"))
        asked = staged(pack(rest, "qv", (), 2 * BLOCK))
        stored = self.store.read(self.cells).where(F.col("cell") != NOWHERE).select("id", *order, "cell", "vec")
        stored = staged(pack(stored.repartitionByRange("cell").sortWithinPartitions("cell"), "vec", ("cell",), BLOCK))
        found = scan(asked, stored, k, "qid", (*order, "id"), exclude_self, _reach(centres)).drop("cell")
        read = self._counts(rest, centres)

        fast = F.coalesce((F.col("similarity") >= fast_threshold).cast("int"), F.lit(0))
        rank = Window.partitionBy("qid").orderBy(fast.desc(), F.col("similarity").desc_nulls_last(), *[F.col(c).asc() for c in order], F.col("id").asc())
        top = found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).checkpoint()
        # Queries with fewer than k comparable vectors go on with the first others in the corpus order, at most 2k + 1 rows.
        head = self.store.read(self.cells).orderBy(*[F.col(c).asc() for c in order], F.col("id").asc()).limit(2 * k + 1)
        head = head.select("id", *order, F.when(F.col("cell") == NOWHERE, 0).otherwise(F.size("vec")).alias("length"))
        have = top.groupBy("qid").agg(F.count("*").alias("have"))
        short = q.join(have, "qid", "left").where(F.coalesce("have", F.lit(0)) < k)
        fill = short.crossJoin(F.broadcast(head)).where("not ok or length != size(qv)")  # a few rows
        if exclude_self:
            fill = fill.where("id != qid")
        fill = fill.select("qid", "id", F.lit(None).cast("double").alias("similarity"), *order)
        both = top.drop("rank").unionByName(fill).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
        both = both.join(read, "qid", "left")
        return both.select(F.col("qid").alias(query_id), "rank", F.col("id").alias(self.id), "similarity", fast.alias("fast_candidate"),
                           F.coalesce("cells_read", F.lit(0)).alias("cells_read"), *order)

    def _visits(self, q: DataFrame, centres: Centres) -> DataFrame:
        """(qid, qv, cell): the first cells of each query."""

        def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part, keys, near in _bounds(batches, centres):
                lead = np.argsort(-near, axis=1, kind="stable")[:, :FIRST]
                i, j = np.nonzero(~np.isneginf(np.take_along_axis(near, lead, 1)))
                yield pd.DataFrame({"qid": part["qid"].to_numpy()[i], "qv": part["qv"].to_numpy()[i], "cell": keys[lead[i, j]]})

        kind = q.schema["qid"].dataType.simpleString()
        return q.select("qid", "qv").mapInPandas(choose, f"qid {kind}, qv array<double>, cell long")

    def _counts(self, q: DataFrame, centres: Centres) -> DataFrame:
        """(qid, cells_read): the first cells of each query and those whose bound reaches ``least`` (null: all)."""

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part, _, near in _bounds(batches, centres):
                want = near >= part["least"].fillna(-2.0).to_numpy(np.float64)[:, None] - SLACK
                np.put_along_axis(want, np.argsort(-near, axis=1, kind="stable")[:, :FIRST], True, 1)
                yield pd.DataFrame({"qid": part["qid"].to_numpy(), "cells_read": (want & ~np.isneginf(near)).sum(1)})

        counts = q.mapInPandas(count, f"qid {q.schema['qid'].dataType.simpleString()}, cells_read long")
        return counts.groupBy("qid").agg(F.sum("cells_read").alias("cells_read"))

    def _meet(self, visits: DataFrame, k: int, exclude_self: bool, order: tuple[str, ...]) -> DataFrame:
        """(qid, id, similarity, order columns): the k best of each visited cell part."""
        size = self.store.read(self.spheres).groupBy("cell").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / PART)).cast("int").alias("parts"))
        load = visits.groupBy("cell").agg(F.ceil(F.count("*") / VISITS).cast("int").alias("copies"))
        plan = F.broadcast(size.join(load, "cell"))  # a row per centre
        rows = self.store.read(self.cells).join(plan, "cell").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
        # A cell is worked on by one task for every VISITS of its visits; hardly any cell has more.
        rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        asks = visits.join(plan, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        asks = asks.withColumn("copy", F.pmod(F.xxhash64("qid"), "copies").cast("int"))
        kinds = {c: rows.schema[c].dataType for c in ("id", *order)}
        qid = visits.schema["qid"].dataType
        keys = ("cell", "part", "copy")
        left = rows.select(*keys, F.lit(0).alias("ask"), F.lit(None).cast(qid).alias("qid"), "vec", "id", *order)
        right = asks.select(*keys, F.lit(1).alias("ask"), "qid", F.col("qv").alias("vec"), *[F.lit(None).cast(t).alias(c) for c, t in kinds.items()])
        stream = left.unionByName(right).repartition(*keys).sortWithinPartitions(*keys, "ask")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            now, held, block = None, [], None
            for b in batches:
                for key, g in b.groupby(list(keys), sort=False):
                    if key != now:
                        now, held, block = key, [], None
                    mine = g["ask"].to_numpy() == 0
                    if mine.any():
                        held.append(g[mine])
                    if not mine.all() and held:
                        if block is None:
                            block = _Block(pd.concat(held, ignore_index=True), order)
                        yield from block.best(g[~mine], k, exclude_self)

        schema = f"qid {qid.simpleString()}, id {kinds['id'].simpleString()}, similarity double" + "".join(f", `{c}` {kinds[c].simpleString()}" for c in order)
        return stream.mapInPandas(run, schema)


def _near(units: np.ndarray, centres: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """The greatest similarity that unit vectors may have with anything in cells, -inf for those that hold nothing."""
    near = np.cos(np.maximum(0.0, _angles(units, centres) - radius - SLACK))
    near[:, np.isneginf(radius)] = -np.inf
    return near


def _bounds(batches: Iterator[pd.DataFrame], centres: Centres) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Queries of one length, the cells of that length and their bounds, a few queries at a time."""
    for b in batches:
        lengths = b["qv"].map(len).to_numpy()
        for n in np.unique(lengths).tolist():
            if n in centres:
                keys, units, radius = centres[n]
                rows, step = b[lengths == n], max(1, (1 << 21) // len(keys))
                for a in range(0, len(rows), step):
                    part = rows.iloc[a : a + step]
                    yield part, keys, _near(_units(part["qv"]), units, radius)


def _reach(centres: Centres) -> Wanted:
    """Whether queries want cells: those whose bound reaches their ``least``."""

    def wanted(units: np.ndarray, least: np.ndarray, cells: np.ndarray) -> np.ndarray:
        keys, points, radius = centres[units.shape[1]]
        at = np.searchsorted(keys, cells)
        return _near(units, points[at], radius[at]) >= least[:, None] - SLACK

    return wanted


class _Block:
    """The vectors of a cell part, ready to be compared."""

    def __init__(self, rows: pd.DataFrame, order: tuple[str, ...]) -> None:
        self.rows, self.order = rows, order
        self.x = np.stack([np.asarray(v, np.float64) for v in rows["vec"]])
        self.norm = np.linalg.norm(self.x, axis=1)
        place = [rows["id"].rank(method="dense").to_numpy(), *[rows[c].rank(method="dense", na_option="top").to_numpy() for c in reversed(order)]]
        self.place = np.lexsort(place).argsort()  # of each row in the order of ties

    def best(self, asks: pd.DataFrame, k: int, exclude_self: bool) -> Iterator[pd.DataFrame]:
        ids = self.rows["id"].to_numpy()
        step = max(1, (1 << 22) // len(ids))
        for a in range(0, len(asks), step):
            part = asks.iloc[a : a + step]
            q = np.stack([np.asarray(v, np.float64) for v in part["vec"]])
            qnorm = np.linalg.norm(q, axis=1)
            near = (q @ self.x.T) / np.outer(qnorm, self.norm)
            out_q, out_i, out_s = [], [], []
            for i, name in enumerate(part["qid"].to_numpy()):
                row = np.where(ids == name, -np.inf, near[i]) if exclude_self else near[i]
                cut = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -np.inf
                at = np.flatnonzero((row >= cut - 1e-12) & (row > -np.inf))
                # One sum per pair, so that equal vectors are equally near wherever they are stored.
                s = (self.x[at] * q[i]).sum(1) / (self.norm[at] * qnorm[i])
                top = np.lexsort((self.place[at], -s))[:k]
                out_q += [name] * len(top)
                out_i.append(at[top])
                out_s.append(s[top])
            rows = self.rows.iloc[np.concatenate(out_i)]
            yield pd.DataFrame({"qid": out_q, "id": rows["id"].to_numpy(), "similarity": np.concatenate(out_s), **{c: rows[c].to_numpy() for c in self.order}})
