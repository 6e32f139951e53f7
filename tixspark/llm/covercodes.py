"""Vector code compression: product codes by Lloyd rounds over partition-local cover trees.

1. Every component becomes the integer floor(SCALE * x). Vectors are cut into ``PARTS`` parts, part
   p from p * dim / PARTS up to (p + 1) * dim / PARTS (rounded down), each with a codebook of at most
   ``ENTRIES`` entries, at first those parts of the vectors of the smallest ids.
2. Tasks cut their rows into blocks of ``BLOCK_BYTES`` (no shuffle). A block is written with a
   cover tree per part: a node of level l holds points within 2^l of its centre, children's
   centres are more than 2^(l - 1) apart. Points are ordered so that a node is a stretch, and
   cumulative sums give any node's count and sum at once.
3. A round walks each tree from the root. Where the second nearest entry is further from a
   node's centre than the nearest by more than twice the node's radius, the triangle inequality gives
   the whole node to the nearest entry; other nodes descend, and the points of ambiguous leaves
   are compared exactly in whole numbers (ties to the lower index).
4. Tasks send one sum per entry; the sums are merged and divided in Spark. Codebooks travel as a table,
   nothing goes through the driver but two totals.

Defined results: vectors that are null or hold null or non-finite components are dropped;
vectors of each length have codebooks of their own; a length that PARTS does not divide has
parts that differ by one, an empty vector the code of entries 0 and the error 0; with fewer than
ENTRIES vectors there are fewer entries; rows with a null id come last in the choice of first
entries, equal ids by their vectors; repeated rows count each; integers beyond +-2^26 are set to that limit,
so that all sums are exact; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_hot, staged

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LIMIT = 1 << 26
#: Bytes of components in a block, points of a leaf, numbers compared at once in a task.
BLOCK_BYTES, LEAF, CHUNK = 1 << 21, 8, 1 << 18
#: Bytes of all codebooks that may be broadcast.
BROADCAST_BYTES = 64 << 20


def bounds(dim: int) -> list[tuple[int, int]]:
    return [(p * dim // PARTS, (p + 1) * dim // PARTS) for p in range(PARTS)]


class CoverTree:
    """A cover tree over integer points: ``order`` of the points and, per node, lo, hi, squared radius, first child, children."""

    def __init__(self, points: np.ndarray, order: np.ndarray | None = None, nodes: np.ndarray | None = None) -> None:
        self.points = points
        self.order, self.nodes = (order, nodes) if order is not None else self._build()
        self.points = points[self.order]

    def _build(self) -> tuple[np.ndarray, np.ndarray]:
        points, n = self.points, len(self.points)
        order = np.arange(n)
        far = int(((points - points[0]) ** 2).sum(1).max())
        nodes = [(0, n, far, 0, 0)]
        active = np.array([0]) if far and n > LEAF else np.zeros(0, np.int64)
        level = (far - 1).bit_length() // 2 + 1 if far else 0  # 4^level > far
        while len(active):
            level -= 1
            cover = 4**level if level >= 0 else 0
            lo, hi = (np.array([nodes[a][k] for a in active.tolist()]) for k in (0, 1))
            size = hi - lo
            node = np.repeat(np.arange(len(active)), size)
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
            p = points[order[at]]
            child, near = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            rest, k = np.arange(len(at)), 0
            while len(rest):  # the first point left in each node becomes the centre of a child
                first = np.concatenate(([True], node[rest][1:] != node[rest][:-1]))
                centre = rest[first][np.cumsum(first) - 1]
                d = ((p[rest] - p[centre]) ** 2).sum(1)
                inside = d <= cover
                child[rest[inside]], near[rest[inside]] = k, d[inside]
                rest, k = rest[~inside], k + 1
            perm = np.lexsort((child, node))
            order[at] = order[at][perm]
            node, child, near = node[perm], child[perm], near[perm]
            start = np.flatnonzero(np.concatenate(([True], (node[1:] != node[:-1]) | (child[1:] != child[:-1]))))
            stop, owner = np.append(start[1:], len(at)), node[start]
            many = np.bincount(owner, minlength=len(active))
            radius = np.maximum.reduceat(near, start)
            alone = many[owner] == 1  # the node itself, one level further down
            nxt = active[owner[alone]].tolist()
            begin = at[start]
            for a, b, r, o in zip(begin[~alone].tolist(), (begin + stop - start)[~alone].tolist(), radius[~alone].tolist(), active[owner[~alone]].tolist(), strict=True):
                lo_, hi_, r_, first_, c_ = nodes[o]
                nodes[o] = (lo_, hi_, r_, first_ or len(nodes), c_ + 1)
                if r and b - a > LEAF:
                    nxt.append(len(nodes))
                nodes.append((a, b, r, 0, 0))
            active = np.array(sorted(nxt), np.int64)
        return order, np.array(nodes, np.int64)

    def assign(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Stretches (lo, hi, entry) given as a whole, and single points (at, entry), together every point once."""
        lo, hi, radius, first, many = self.nodes.T
        whole, single, front = [], [], np.zeros(1, np.int64)
        while len(front):
            best, second = nearest(self.points[lo[front]], entries)
            s1, s2, r = (np.sqrt(x.astype(float)) for x in (best[1], second, radius[front]))
            sure = (radius[front] == 0) | (s2 - s1 > 2 * r + 1e-6 * (1 + s2))
            whole.append(np.stack([lo[front[sure]], hi[front[sure]], best[0][sure]]))
            front = front[~sure]
            leaf = many[front] == 0
            single.append(_stretches(lo[front[leaf]], hi[front[leaf]]))
            front = _stretches(first[front[~leaf]], first[front[~leaf]] + many[front[~leaf]])
        whole, at = np.concatenate(whole, 1), np.concatenate(single)
        return *whole, at, nearest(self.points[at], entries)[0][0]


def _stretches(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    n = hi - lo
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """((index, squared distance) of the nearest entry, ties to the lower index; squared distance of the second)."""
    index, best, second = (np.zeros(len(points), np.int64) for _ in range(3))
    step = max(1, CHUNK // max(1, entries.size))
    for a in range(0, len(points), step):
        d = ((points[a : a + step, None, :] - entries[None, :, :]) ** 2).sum(2)
        i, rows = d.argmin(1), np.arange(len(d))
        index[a : a + step], best[a : a + step] = i, d[rows, i]
        d[rows, i] = np.iinfo(np.int64).max
        second[a : a + step] = d.min(1)
    return (index, best), second


def integers(vector: str) -> str:
    """SQL of the integer components of an array<double>."""
    return f"transform({vector}, x -> cast(greatest(-{LIMIT}, least({LIMIT}, floor(x * {SCALE}d))) as long))"


def valid_vectors(table: DataFrame) -> DataFrame:
    """vec_id, label, vec (array<double>), dim of the rows that take part."""
    v = table.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vec")).where("vec is not null")
    return v.where("forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))").withColumn("dim", F.size("vec"))


def first_codebooks(vectors: DataFrame) -> DataFrame:
    """dim, entries (array<long> by part, entry, position): the vectors of the smallest ids of each length."""
    order = Window.partitionBy("dim").orderBy(F.col("vec_id").asc_nulls_last(), "vec")
    first = vectors.withColumn("e", F.row_number().over(order)).where(F.col("e") <= ENTRIES)
    first = first.select("dim", "e", F.expr(integers("vec")).alias("q")).groupBy("dim").agg(F.expr("transform(array_sort(collect_list(struct(e, q))), s -> s.q)").alias("vs"))
    cut = f"slice(v, p * dim div {PARTS} + 1, cast((p + 1) * dim div {PARTS} - p * dim div {PARTS} as int))"
    return first.selectExpr("dim", f"flatten(transform(sequence(0, {PARTS - 1}), p -> flatten(transform(vs, v -> {cut})))) as entries", "size(vs) as k")


def build_blocks(vectors: DataFrame) -> DataFrame:
    """Blocks of vectors of one length: dim, ids, labels, comps, and for each part the order and the nodes of a cover tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        size = 0
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                rows = batch.filter(pa.array(dims == d))
                step = max(1, BLOCK_BYTES // (4 * d + 32))
                for a in range(0, rows.num_rows, step):
                    part = rows.slice(a, step)
                    held.setdefault(d, []).append(part)
                    size += part.num_rows * (4 * d + 32)
                    if size >= BLOCK_BYTES:
                        yield from flush(held)
                        held, size = {}, 0
        yield from flush(held)

    def flush(held: dict[int, list[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
        for d, parts in held.items():
            rows = pa.Table.from_batches(parts).combine_chunks()
            n = rows.num_rows
            vec = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in rows.column("vec").chunks]).reshape(n, d)
            q = np.clip(np.floor(vec * SCALE), -LIMIT, LIMIT).astype(np.int64)
            trees = [CoverTree(np.ascontiguousarray(q[:, a:b])) for a, b in bounds(d)]
            lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.concat_arrays(rows.column(c).chunks)) for c in ("vec_id", "label")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([d], pa.int32()), *lists, pa.array([q.astype("<i4").tobytes()], pa.binary()),
                 pa.array([[t.order.astype("<i4").tobytes() for t in trees]], pa.list_(pa.binary())),
                 pa.array([[t.nodes.astype("<i8").tobytes() for t in trees]], pa.list_(pa.binary()))],
                names=["dim", "ids", "labels", "comps", "orders", "nodes"],
            )

    kinds = [vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")]
    return vectors.mapInArrow(run, f"dim int, ids array<{kinds[0]}>, labels array<{kinds[1]}>, comps binary, orders array<binary>, nodes array<binary>")


def _trees(batch: pa.RecordBatch, row: int) -> Iterator[tuple[np.ndarray, CoverTree, np.ndarray]]:
    """(integer parts, tree, entries) of each part of a block with its codebook."""
    d = batch.column("dim")[row].as_py()
    q = np.frombuffer(batch.column("comps")[row].as_buffer(), "<i4").astype(np.int64)
    k = batch.column("k")[row].as_py()
    entries = batch.column("entries")[row].values.to_numpy(zero_copy_only=False)
    orders, nodes = (batch.column(c)[row].values for c in ("orders", "nodes"))
    q = q.reshape(len(batch.column("ids")[row].values), d)
    for p, (a, b) in enumerate(bounds(d)):
        points = np.ascontiguousarray(q[:, a:b])
        tree = CoverTree(points, np.frombuffer(orders[p].as_buffer(), "<i4"), np.frombuffer(nodes[p].as_buffer(), "<i8").reshape(-1, 5))
        yield points, tree, entries[a * k : b * k].reshape(k, b - a)


def _with_books(blocks: DataFrame, books: DataFrame) -> DataFrame:
    """Blocks with the codebooks of their length, broadcast if all codebooks are small."""
    size = books.agg(F.sum(F.size("entries"))).first()[0] or 0
    return blocks.join(F.broadcast(books) if size * 8 <= BROADCAST_BYTES else books, "dim")


def lloyd_round(blocks: DataFrame, books: DataFrame) -> DataFrame:
    """The codebooks after one round: floors of the means of what each entry is nearest to; unused entries stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # per length: sums and counts, as flat as the codebooks
        for batch in batches:
            for row in range(batch.num_rows):
                d, k = batch.column("dim")[row].as_py(), batch.column("k")[row].as_py()
                sums, counts = total.setdefault(d, (np.zeros(k * d, np.int64), np.zeros(k * d, np.int64)))
                for (a, b), (_, tree, entries) in zip(bounds(d), _trees(batch, row), strict=True):
                    lo, hi, whole, at, one = tree.assign(entries)
                    cum = np.concatenate((np.zeros((1, b - a), np.int64), np.cumsum(tree.points, 0)))
                    s, c = sums[a * k : b * k].reshape(k, b - a), counts[a * k : b * k].reshape(k, b - a)
                    np.add.at(s, whole, cum[hi] - cum[lo])
                    np.add.at(c, whole, (hi - lo)[:, None])
                    np.add.at(s, one, tree.points[at])
                    np.add.at(c, one, 1)
            if sum(len(s) for s, _ in total.values()) > CHUNK:
                yield from send(total)
                total = {}
        yield from send(total)

    def send(total: dict[int, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for d, (s, c) in total.items():
            at = np.flatnonzero(c)
            columns = [np.full(len(at), d, np.int32), at.astype(np.int32), s[at], c[at]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["dim", "at", "s", "c"])

    sums = _with_books(blocks, books).mapInArrow(run, "dim int, at int, s long, c long")
    sums = sums.groupBy("dim", "at").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
    old = books.selectExpr("dim", "k", "posexplode_outer(entries) as (at, v)")
    new = old.join(sums, ["dim", "at"], "left").selectExpr("dim", "k", "at", "if(c is null, v, (s - pmod(s, c)) div c) as v")
    return new.groupBy("dim", "k").agg(F.expr("transform(array_sort(collect_list(if(at is null, null, struct(at, v)))), s -> s.v)").alias("entries")).select("dim", "entries", "k")


def encode(blocks: DataFrame, books: DataFrame) -> DataFrame:
    """vec_id, label, dim, code (the entry of each part), error of each vector of the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, labels = (batch.column(c)[row].values for c in ("ids", "labels"))
                codes, error = np.zeros((len(ids), PARTS), np.uint8), np.zeros(len(ids), np.int64)
                for p, (points, tree, entries) in enumerate(_trees(batch, row)):
                    lo, hi, whole, at, one = tree.assign(entries)
                    place = np.zeros(len(ids), np.int64)
                    place[_stretches(lo, hi)] = np.repeat(whole, hi - lo)
                    place[at] = one
                    codes[tree.order, p] = place
                    error += ((points - entries[codes[:, p]]) ** 2).sum(1)
                code = [c.tobytes() for c in codes]
                dim = np.full(len(ids), batch.column("dim")[row].as_py(), np.int32)
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(dim), pa.array(code, pa.binary()), pa.array(error)], names=["vec_id", "label", "dim", "code", "error"])

    kinds = [blocks.schema[c].dataType.elementType.simpleString() for c in ("ids", "labels")]
    return _with_books(blocks, books).mapInArrow(run, f"vec_id {kinds[0]}, label {kinds[1]}, dim int, code binary, error long")


def compress(table: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(codes, codebooks): vec_id, label, dim, code, error of each vector, and dim, entries, k of each length."""
    vectors = valid_vectors(table)
    books = staged(first_codebooks(vectors))
    blocks = staged(build_blocks(vectors))
    for _ in range(rounds):
        books = staged(lloyd_round(blocks, books))
    return staged(encode(blocks, books)), books


def codes_digest(table: DataFrame) -> DataFrame:
    """Per vector: vec_id, code, error, label_error, codebooks_sha256."""
    codes, books = compress(table)
    key = F.when(F.col("label").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("label").cast("string"))).alias("label_key")
    codes = codes.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "dim", key)
    labels = staged(codes.groupBy("label_key").agg(F.sum("error").alias("label_error"), F.count("*").alias("rows")))
    sha = books.select("dim", F.sha2(F.array_join("entries", ","), 256).alias("codebooks_sha256"))
    out = join_hot(codes, labels, "label_key", "rows")
    counted = staged(codes.groupBy("dim").agg(F.count("*").alias("rows")).join(sha, "dim"))
    return join_hot(out, counted, "dim", "rows").select("vec_id", "code", "error", "label_error", "codebooks_sha256")
