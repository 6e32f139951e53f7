"""Vectors in packed blocks, and the scan of query blocks past corpus blocks.

A block is one row: the vectors of a few thousand rows as one compressed binary, beside the rows' own columns. Blocks are written
once. Query blocks are dealt to parts of a bounded number of queries, and meet corpus blocks as a Cartesian product: each task
streams a part of the corpus files past the query blocks of one part, so that nothing is copied for every pair of blocks and what
is written grows with the rows, not with the pairs. A worker holds one part of the queries, with the k best of each, and one corpus
block, whatever the sizes of files; a query has one list for each part of the corpus, and these are as few as keep all cores busy.

Pairs are screened in single precision with an allowance for its error; what may be among the k best is computed in
double precision as one sum per pair, so that equal vectors are equally near wherever they are. Rows of a corpus block may be
grouped in cells (:class:`_Cells`): a query is not compared with a cell that can't hold anything as near as its k best so far.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Worker-side code is shipped by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Similarities of a query chunk held at once; components of pairs compared in double precision at once.
CHUNK, PAIRS = 1 << 21, 1 << 19
#: Rows of a cell, about, and the directions by which cells are made. Blocks with fewer than four cells have none.
CELL, DIRECTIONS = 96, 4
#: Queries that are brought together at a time for a product with a cell, which then stay in the cache.
GATHERED = 512
#: Allowance for the error of a cell's bound: that of a root of 1 - t * t where t is near 1.
BOUND_SLACK = 4e-3
#: Queries of a part, tasks for each core, and corpus blocks that a task goes through.
PART, TASKS, STREAM = 8192, 4, 2048
#: Share of a block's pairs that cells must leave fewer than, to be gone through one by one.
SPARED = 0.8

#: Of the vectors of a block. Sparse vectors and those of few values take a fraction of their size on the way to the workers.
CODEC = "zstd"

#: (unit vectors of a chunk of queries, their ``least``, cells of a block) -> queries x cells wanted
Wanted = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def pack(rows: DataFrame, vec: str, order: tuple[str, ...], size: int, copies: int | None = None, cells: bool = False) -> DataFrame:
    """(block, n, dim, width, data, cells, rows): blocks of up to ``size`` rows of one vector length, in the order of ``order`` (nulls
    first). ``n`` is their number, ``width`` the bytes of a component; ``cells`` is null unless asked for.

    Vectors without a direction (null, empty, zero, not finite) have dim 0 and no data. Of equal vectors of a block only
    the first ``copies`` are kept, if the last column of ``order`` tells all rows of the block apart.
    """
    others = [f for f in rows.schema.fields if f.name != vec]
    kind = rows.schema[vec].dataType.elementType
    double = not isinstance(kind, T.FloatType)
    rows = rows.select(F.col(vec).cast("array<double>" if double else "array<float>").alias("__vec"), *[f.name for f in others])
    names = [f.name for f in others]

    kept_type = np.float64 if double else np.float32

    def emit(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        if order:
            table = table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in order], null_placement="at_start")).combine_chunks()
        vectors = pa.concat_arrays(table.column("__vec").chunks)
        begin, flat = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False).astype(kept_type, copy=False)
        lengths = np.where(vectors.is_null().to_numpy(zero_copy_only=False), 0, np.diff(begin))
        for n in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == n)
            if len(at) == len(table):
                x = flat[begin[0] : begin[-1]].reshape(len(at), n)
            else:
                x = flat[begin[at][:, None] + np.arange(n)] if n else np.zeros((len(at), 0), kept_type)
            good = np.isfinite(x).all(1) & (x != 0).any(1)
            yield from block(table, n, at[good], x if good.all() else x[good])
            yield from block(table, 0, at[~good], x[:0])

    def block(table: pa.Table, dim: int, at: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        if dim and copies is not None and len(table.column(order[-1]).unique()) == len(table):
            same = pd.factorize(np.array([v.tobytes() for v in x] + [None], object)[:-1])[0]
            first = pd.Series(same).groupby(same).cumcount().to_numpy() < copies
            at, x = (at, x) if first.all() else (at[first], x[first])
        if len(at):
            own = table.select(names).take(pa.array(at)).combine_chunks()
            own = pa.StructArray.from_arrays([pa.concat_arrays(own.column(c).chunks) for c in names], names=names)
            data = pa.compress(np.ascontiguousarray(x).tobytes(), CODEC, asbytes=True) if dim else b""
            made = _Cells.made(x) if cells and dim else None
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([v], pa.int32()) for v in (len(at), dim, x.itemsize)), pa.array([data], pa.binary()), pa.array([made], pa.binary()),
                 pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), own)], names=["n", "dim", "width", "data", "cells", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                held.append(batch.slice(at, size - n))
                at, n = at + held[-1].num_rows, n + held[-1].num_rows
                if n == size:
                    yield from emit(held)
                    held, n = [], 0
        if held:
            yield from emit(held)
        held.clear()
        pa.default_memory_pool().release_unused()  # a worker stays when its task is done

    own = T.StructType([T.StructField(f.name, f.dataType) for f in others])
    schema = T.StructType([*(T.StructField(c, T.IntegerType()) for c in ("n", "dim", "width")), T.StructField("data", T.BinaryType()),
                           T.StructField("cells", T.BinaryType()), T.StructField("rows", T.ArrayType(own))])
    return rows.mapInArrow(run, schema).withColumn("block", F.monotonically_increasing_id())


class _Cells:
    """Cells of a block's rows by their places along its DIRECTIONS main directions.

    A unit vector is (p, r) there: its components along the directions, and the length of all that is left. The product of two
    vectors is at most that of their (p, r), which are unit vectors too; so no row of a cell is nearer to a query than the
    angle between the query's (p, r) and the cell's centre, less the angle of the cell's farthest row.
    """

    def __init__(self, raw: bytes, dim: int) -> None:
        m, n = np.frombuffer(raw, np.int32, 2)
        at = 8
        self.rows = np.frombuffer(raw, np.int32, n, at)  # cell by cell
        self.begin = np.frombuffer(raw, np.int32, m + 1, at := at + 4 * n)
        self.axes = np.frombuffer(raw, np.float32, dim * DIRECTIONS, at := at + 4 * (m + 1)).reshape(dim, DIRECTIONS)
        self.centres = np.frombuffer(raw, np.float32, m * (DIRECTIONS + 1), at := at + self.axes.nbytes).reshape(m, DIRECTIONS + 1)
        self.near = np.frombuffer(raw, np.float32, m, at + self.centres.nbytes).astype(np.float64)

    @staticmethod
    def places(unit: np.ndarray, axes: np.ndarray) -> np.ndarray:
        p = (unit @ axes).astype(np.float64)
        return np.concatenate([p, np.sqrt(np.maximum(1 - (p * p).sum(1), 0))[:, None]], 1)

    @classmethod
    def made(cls, x: np.ndarray) -> bytes | None:
        n, dim = x.shape
        m = n // CELL
        if m < 4 or dim <= 2 * DIRECTIONS:
            return None
        x = x.astype(np.float64)
        unit = (x / np.sqrt((x * x).sum(1))[:, None]).astype(np.float32)
        random = np.random.default_rng(0)
        axes = random.normal(size=(dim, DIRECTIONS)).astype(np.float32)
        for _ in range(6):
            axes = np.linalg.qr(unit.T @ (unit @ axes))[0]
        axes = axes.astype(np.float32)
        place = cls.places(unit, axes)
        centres = place[random.choice(n, m, replace=False)]
        for _ in range(5):
            cell = (place @ centres.T).argmax(1)
            sums = np.zeros((m, place.shape[1]))
            np.add.at(sums, cell, place)
            length = np.sqrt((sums * sums).sum(1))
            centres = np.where((length > 0)[:, None], sums / np.where(length > 0, length, 1)[:, None], centres)
        centres = centres.astype(np.float32)
        near = place @ centres.T.astype(np.float64)
        cell = near.argmax(1)
        least = np.ones(m)
        np.minimum.at(least, cell, near[np.arange(n), cell])
        begin = np.concatenate([[0], np.cumsum(np.bincount(cell, minlength=m))])
        parts = np.array([m, n], np.int32), np.argsort(cell, kind="stable").astype(np.int32), begin.astype(np.int32), axes, centres, least.astype(np.float32)
        return b"".join(np.ascontiguousarray(x).tobytes() for x in parts)

    def wanted(self, unit: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Queries x cells that may hold a row at ``limit`` or nearer."""
        t = np.clip(self.places(unit, self.axes) @ self.centres.T.astype(np.float64), -1, 1)
        near = np.clip(self.near, -1, 1)
        most = t * near + np.sqrt((1 - t * t) * (1 - near * near))
        return (t >= near) | (most + BOUND_SLACK >= limit[:, None])


class _Vectors:
    """A block as it is compared: vectors, their unit vectors in single precision, their rows' columns."""

    def __init__(self, data: pa.Scalar, width: int, dim: int, rows: pa.Scalar, cells: bytes | None = None) -> None:
        n = len(rows.values)
        raw = pa.decompress(data.as_buffer(), n * dim * width, CODEC)
        self.x = np.frombuffer(raw, np.float32 if width == 4 else np.float64).reshape(n, dim)
        self.norm, self.unit = np.empty(n), np.empty((n, dim), np.float32)
        for a in range(0, n, 512):  # a piece stays in the cache
            x = self.x[a : a + 512].astype(np.float64)
            self.norm[a : a + 512] = np.sqrt((x**2).sum(1))
            self.unit[a : a + 512] = self.x[a : a + 512] / self.norm[a : a + 512, None]
        self.cells = _Cells(cells, dim) if cells else None
        self.rows = rows.values.take(pa.array(np.arange(n)))

    def __len__(self) -> int:
        return len(self.x)


class _Best:
    """The k best rows found so far of each query of a block."""

    def __init__(self, queries: _Vectors, k: int, order: tuple[str, ...]) -> None:
        self.queries, self.k, self.order = queries, k, order
        self.top = np.full((len(queries), k), -np.inf)  # similarities, ascending
        self.found: list[tuple[np.ndarray, np.ndarray, pa.StructArray]] = []
        self.n = 0

    def add(self, i: np.ndarray, s: np.ndarray, rows: pa.StructArray) -> None:
        if not len(i):
            return
        self.found.append((i, s, rows))
        self.n += len(i)
        if self.n > 8 * self.k * len(self.queries) + 4096:
            self.prune()

    def prune(self) -> None:
        if not self.found:
            return
        i, s = np.concatenate([f[0] for f in self.found]), np.concatenate([f[1] for f in self.found])
        rows = pa.concat_arrays([f[2] for f in self.found])
        keep = np.flatnonzero(s >= self.top[i, 0])
        i, s, rows = i[keep], s[keep], rows.take(pa.array(keep))
        keys = pa.table([pa.array(i), pa.array(-s), *[rows.field(c) for c in self.order]], names=["i", "s", *[f"o{n}" for n in range(len(self.order))]])
        at = pc.sort_indices(keys, sort_keys=[(c, "ascending") for c in keys.column_names], null_placement="at_start").to_numpy()
        at = at[pd.Series(i[at]).groupby(i[at]).cumcount().to_numpy() < self.k]
        self.found = [(i[at], s[at], rows.take(pa.array(at)))]
        self.n = len(at)


def _same(best: _Best, block: _Vectors, exclude: tuple[str, str] | None) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a query and itself, by query."""
    if not exclude:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a = pd.DataFrame({"id": best.queries.rows.field(exclude[0]).to_numpy(zero_copy_only=False), "i": np.arange(len(best.queries))})
    b = pd.DataFrame({"id": block.rows.field(exclude[1]).to_numpy(zero_copy_only=False), "j": np.arange(len(block))})
    both = a.merge(b, on="id")
    both = both[both["id"].notna()].sort_values("i")
    return both["i"].to_numpy(), both["j"].to_numpy()


def _compare(best: _Best, block: _Vectors, place: np.ndarray, exclude: tuple[str, str] | None, wanted: np.ndarray | None, least: np.ndarray | None, room: np.ndarray) -> None:
    q, k, n, dim = best.queries, best.k, len(block), block.x.shape[1]
    slack = (dim + 8) * 2.0**-22  # of a single precision sum of products of unit vectors
    same_i, same_j = _same(best, block, exclude)
    if block.cells and wanted is None and not np.isneginf(best.top[:, 0]).any():
        limit = best.top[:, 0] if least is None else np.maximum(best.top[:, 0], least)
        limit = np.maximum(limit - slack, -8.0).astype(np.float32)
        near = block.cells.wanted(q.unit, limit)
        if near.mean() < SPARED:
            i, j = _by_cell(q, block, near, limit, room)
            own = np.isin(i * n + j, same_i * n + same_j, invert=True)
            _settle(best, block, place, i[own], j[own])
            return
    who = np.arange(len(q)) if wanted is None else np.flatnonzero(wanted.any(1))
    step = max(1, len(room) // n)
    for a in range(0, len(who), step):
        part = who[a : a + step]
        s = np.matmul(q.unit[part], block.unit.T, out=room[: len(part) * n].reshape(len(part), n))
        if len(same_i):
            lo, hi = np.searchsorted(same_i, [part[0], part[-1] + 1])
            at = np.searchsorted(part, same_i[lo:hi])
            ok = part[at] == same_i[lo:hi]
            s[at[ok], same_j[lo:hi][ok]] = -np.inf
        if wanted is not None:
            s[~wanted[part]] = -np.inf
        limit = best.top[part, 0]
        if least is not None:
            limit = np.maximum(limit, least[part])
        none = np.flatnonzero(np.isneginf(limit))
        if len(none) and n > k:
            limit[none] = np.partition(s[none], n - k, axis=1)[:, n - k] - slack
        limit = np.maximum(limit - slack, -8.0).astype(np.float32)
        i, j = np.divmod(np.flatnonzero(s >= limit[:, None]), n)
        _settle(best, block, place, part[i], j)


def _by_cell(q: _Vectors, block: _Vectors, near: np.ndarray, limit: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs at ``limit`` or nearer by single precision, of queries and the cells they want (``near``)."""
    found_i, found_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for c in range(near.shape[1]):
        rows = block.cells.rows[block.cells.begin[c] : block.cells.begin[c + 1]]
        who = np.flatnonzero(near[:, c])
        if not len(rows) or not len(who):
            continue
        unit = block.unit[rows].T
        step = max(1, min(GATHERED, len(room) // (q.unit.shape[1] + len(rows))))
        for a in range(0, len(who), step):
            part = who[a : a + step]
            used = len(part) * q.unit.shape[1]  # of the room, by the queries; the products come after them
            asked = np.take(q.unit, part, axis=0, out=room[:used].reshape(len(part), -1), mode="clip")
            s = np.matmul(asked, unit, out=room[used : used + len(part) * len(rows)].reshape(len(part), len(rows)))
            i, j = np.divmod(np.flatnonzero(s >= limit[part, None]), len(rows))
            found_i.append(part[i])
            found_j.append(rows[j].astype(np.int64))
    return np.concatenate(found_i), np.concatenate(found_j)


def _settle(best: _Best, block: _Vectors, place: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Compute pairs of queries ``i`` and rows ``j`` in double precision and keep those among a query's k best."""
    if not len(i):
        return
    q, k = best.queries, best.k
    exact = np.empty(len(i))
    pairs = max(1, PAIRS // block.x.shape[1])
    for b in range(0, len(i), pairs):
        x, y = i[b : b + pairs], j[b : b + pairs]
        exact[b : b + pairs] = (q.x[x].astype(np.float64) * block.x[y]).sum(1) / (q.norm[x] * block.norm[y])
    keep = np.flatnonzero(exact >= best.top[i, 0])
    i, j, exact = i[keep], j[keep], exact[keep]
    order = np.lexsort((place[j], -exact, i))
    i, j, exact = i[order], j[order], exact[order]
    rank = pd.Series(i).groupby(i).cumcount().to_numpy()
    keep = rank < k
    i, j, exact, rank = i[keep], j[keep], exact[keep], rank[keep]
    part, at = np.unique(i, return_inverse=True)
    new = np.full((len(part), k), -np.inf)
    new[at, rank] = exact
    best.top[part] = np.sort(np.concatenate([best.top[part], new], 1), 1)[:, k:]
    best.add(i, exact, block.rows.take(pa.array(j)))


def _dealt(blocks: DataFrame) -> tuple[DataFrame, int]:
    """``blocks`` in partitions of PART rows at most, or of one block, and their number. The driver sees the rows of each block."""
    sizes, part, held = [], 0, 0
    for block, n in blocks.select("block", "n").orderBy("block").collect():
        part, held = (part, held + n) if held + n <= PART or not held else (part + 1, n)
        sizes.append((block, part))
    numbers = pa.table([pa.array([s[i] for s in sizes], kind) for i, kind in enumerate((pa.int64(), pa.int32()))], names=["block", "part"])
    numbers = blocks.sparkSession.createDataFrame(numbers)  # no job
    return blocks.join(F.broadcast(numbers), "block").repartitionById(part + 1, "part").drop("part"), part + 1


def scan(queries: DataFrame, corpus: DataFrame, k: int, query_id: str, order: tuple[str, ...], exclude_self: bool = False,
         wanted: Wanted | None = None, cell: str = "cell", least: str = "least") -> DataFrame:
    """(query id, similarity, the corpus rows' columns): the k best of each query in each part of the corpus blocks.

    ``queries`` and ``corpus`` are written blocks. Ties go by ``order`` (nulls first), whose last column is the corpus rows' id.
    With ``wanted`` the rows of a block have a ``cell``, and a query is compared with the cells it wants and with nothing under its ``least``.
    """
    q, dealt = _dealt(queries.where("dim > 0"))
    q = q.select(*[F.col(c).alias(f"q{c}") for c in ("dim", "block", "width", "data", "rows")])
    c = corpus.where("dim > 0")
    tasks = TASKS * q.sparkSession.sparkContext.defaultParallelism
    parts = max(-(-tasks // dealt), -(-c.select("block").count() // STREAM))
    c = c.select("dim", "block", "width", "data", "cells", "rows").coalesce(parts)
    own, asked = corpus.schema["rows"].dataType.elementType, queries.schema["rows"].dataType.elementType
    exclude = (query_id, order[-1]) if exclude_self and asked[query_id].dataType == own[order[-1]].dataType else None
    names = [f.name for f in own.fields]

    def out(best: _Best) -> Iterator[pa.RecordBatch]:
        best.prune()
        for i, s, rows in best.found:
            ids = best.queries.rows.field(query_id).take(pa.array(i))
            yield pa.RecordBatch.from_arrays([ids, pa.array(s), *[rows.field(c) for c in names]], names=["qid", "similarity", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room = np.empty(CHUNK, np.float32)  # a block has fewer rows
        states: dict[int, _Best] = {}
        now, block, place, groups, member = None, None, None, None, None
        for batch in batches:
            for r in range(batch.num_rows):
                dim, asked_dim, key, name = (batch.column(c)[r].as_py() for c in ("dim", "qdim", "qblock", "block"))
                if dim != asked_dim:
                    continue
                if key not in states:
                    states[key] = _Best(_Vectors(batch.column("qdata")[r], batch.column("qwidth")[r].as_py(), dim, batch.column("qrows")[r]), k, order)
                if name != now:
                    now, cells = name, None if wanted else batch.column("cells")[r].as_py()
                    block = _Vectors(batch.column("data")[r], batch.column("width")[r].as_py(), dim, batch.column("rows")[r], cells)
                    keys = pa.table([block.rows.field(c) for c in order], names=list(order))
                    place = np.argsort(pc.sort_indices(keys, sort_keys=[(c, "ascending") for c in order], null_placement="at_start").to_numpy())
                    if wanted:
                        groups, member = np.unique(block.rows.field(cell).to_numpy(), return_inverse=True)
                best, want, floor = states[key], None, None
                if wanted:
                    floor = best.queries.rows.field(least).to_numpy(zero_copy_only=False).astype(np.float64)
                    floor = np.where(np.isnan(floor), -np.inf, floor)
                    want = wanted(best.queries.x / best.queries.norm[:, None], floor, groups)[:, member]
                _compare(best, block, place, exclude, want, floor, room)
        for best in states.values():
            yield from out(best)
        states.clear()
        pa.default_memory_pool().release_unused()

    schema = T.StructType([T.StructField("qid", asked[query_id].dataType), T.StructField("similarity", T.DoubleType()), *own.fields])
    # The corpus is the side that streams, whatever the sizes: as a broadcast it would be held. Lengths are compared by the tasks:
    # as a condition they would make it a join on a handful of values.
    return c.hint("shuffle_replicate_nl").crossJoin(q).mapInArrow(run, schema)
