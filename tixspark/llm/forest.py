"""Approximate nearest neighbours by cosine with a forest of hash prefixes.

The vectors of each length are dealt over shards of about ``SHARD_ROWS`` by a hash of their ids. For each
of ``TREES`` trees a shard keeps the sorted array of its vectors' hash strings: ``BITS`` signs of
random projections. A query descends in every tree to its longest prefix match and then
ascends in all trees at once, one bit a step, until the prefix ranges together hold ``READ``
times as many entries as the shard has vectors and ``SHARE`` of its vectors, never fewer than
``LEAST`` and k, or all there are; the query itself counts for neither. What the ranges hold is
compared exactly, and the best of all shards are the answer. Every query block visits every shard: vectors without
cluster structure (as here) give no shard that could be left out.

Defined results: vectors that are null, empty, zero, or that hold nulls or values that are not
finite take no part, as query or as candidate; only vectors of the same length are compared;
rows with a null id take no part; of several rows with one id the smallest vector (in array
order) counts; ties go to the smaller id; an empty table gives an empty result; columns besides
vec_id and embedding are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_side, staged

SHARD_ROWS, QUERY_ROWS, TREES, BITS, READ, SEED = 8192, 1024, 24, 32, 1.0, 11
#: Vectors other than the query that the ranges have to hold: a share of the shard's, and a number.
SHARE, LEAST = 0.5, 512


def valid_vectors(table: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, vec array<double>, dim) of the vectors that take part, one for each id."""
    v = table.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec")
    )
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(finite & F.exists("vec", lambda x: x != 0))
    return v.groupBy("id").agg(F.min("vec").alias("vec")).withColumn("dim", F.size("vec"))


def _planes(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED + dim).standard_normal((dim, TREES * BITS))


def _codes(x: np.ndarray) -> np.ndarray:
    """Hash strings as numbers: vectors x trees."""
    bits = (x @ _planes(x.shape[1]) > 0).reshape(len(x), TREES, BITS)
    return (bits * (np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64))).sum(2, dtype=np.uint64)


def build_shards(vectors: DataFrame) -> DataFrame:
    """One row per shard and length of vectors with a column shards (of their length): ids, vectors, and for each tree the order and the sorted hash strings."""

    def build(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        x = np.stack(group["vec"].to_numpy())
        codes = _codes(x / np.abs(x).max(1, keepdims=True))
        order = np.argsort(codes, axis=0, kind="stable")
        return pd.DataFrame({
            "dim": [key[0]], "shard": [key[1]], "ids": [group["id"].to_numpy(np.int64).tobytes()], "vecs": [x.tobytes()],
            "order": [order.T.astype(np.int32).tobytes()], "strings": [np.take_along_axis(codes, order, 0).T.astype(np.uint32).tobytes()],
        })

    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int"))
    return dealt.groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, ids binary, vecs binary, order binary, strings binary")


def candidates(strings: np.ndarray, order: np.ndarray, codes: np.ndarray, own: np.ndarray, k: int, read: float) -> np.ndarray:
    """Which rows each query reads (queries x rows), after descending and ascending together.

    ``strings`` and ``order``: trees x rows, sorted; ``codes``: queries x trees; ``own``: the
    row of each query itself, -1 where it is not in the shard.
    """
    trees, rows = strings.shape
    hit = np.zeros((len(codes), rows), bool)
    here = own >= 0
    need = np.minimum(rows - here, max(LEAST, k, int(np.ceil(SHARE * rows))))
    # Descend: the longest prefix that a query shares with any string of a tree is at its sorted place.
    length = np.zeros(len(codes), np.int64)
    for t in range(trees):
        at = np.searchsorted(strings[t], codes[:, t])
        for near in (np.clip(at - 1, 0, rows - 1), np.clip(at, 0, rows - 1)):
            apart = (strings[t][near] ^ codes[:, t]).astype(np.uint64)
            shared = BITS - np.where(apart > 0, np.floor(np.log2(np.maximum(apart, 1))).astype(np.int64) + 1, 0)
            length = np.maximum(length, shared)
    open_ = np.arange(len(codes))
    for bits in range(int(length.max(initial=0)), 0, -1):
        now = open_[length[open_] >= bits]
        if not len(now):
            continue
        low = (codes[now] >> np.uint64(BITS - bits)) << np.uint64(BITS - bits)
        high = low + np.uint64((1 << (BITS - bits)) - 1)
        begin, end = (np.empty((len(now), trees), np.int64) for _ in range(2))
        for t in range(trees):
            begin[:, t] = np.searchsorted(strings[t], low[:, t], "left")
            end[:, t] = np.searchsorted(strings[t], high[:, t], "right")
        entries = (end - begin).sum(1) - trees * here[now]
        full = []
        for j in np.flatnonzero((entries >= read * rows) & (entries >= need[now])):
            i = now[j]
            for t in range(trees):
                hit[i, order[t, begin[j, t] : end[j, t]]] = True
            if np.count_nonzero(hit[i]) - (here[i] and hit[i, own[i]]) >= need[i]:
                full.append(i)
        open_ = np.setdiff1d(open_, full, assume_unique=True)
    hit[open_] = True  # without a bit the ranges are the whole shard
    hit[np.flatnonzero(here), own[here]] = False
    return hit


def search_shard(row: dict, qid: np.ndarray, q: np.ndarray, k: int, read: float) -> pd.DataFrame:
    ids = np.frombuffer(row["ids"], np.int64)
    x = np.frombuffer(row["vecs"], np.float64).reshape(len(ids), -1)
    order = np.frombuffer(row["order"], np.int32).reshape(TREES, -1)
    strings = np.frombuffer(row["strings"], np.uint32).reshape(TREES, -1).astype(np.uint64)
    norm = np.sqrt((x * x).sum(1))
    own = np.searchsorted(ids, qid).clip(0, len(ids) - 1)  # a shard's ids are in order
    own = np.where(ids[own] == qid, own, -1)
    hits = candidates(strings, order, _codes(q / np.abs(q).max(1, keepdims=True)), own, k, read)
    found = []
    for i in range(len(q)):
        c = np.flatnonzero(hits[i])
        cos = x[c] @ q[i] / (norm[c] * np.sqrt((q[i] * q[i]).sum()))
        if len(c) > 4 * k:
            near = np.argpartition(-cos, k)[: k + 1]
            near = np.flatnonzero(cos >= cos[near].min() - 1e-12)  # with all ties
            c, cos = c[near], cos[near]
        best = np.lexsort((ids[c], -cos))[:k]
        found.append(pd.DataFrame({"query_id": qid[i], "vec_id": ids[c][best], "score": cos[best]}))
    return pd.concat(found, ignore_index=True)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, read: float = READ) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query; both inputs are (id, vec, dim)."""
    vectors = staged(vectors)
    lengths = staged(vectors.groupBy("dim").agg(F.ceil(F.count("*") / SHARD_ROWS).cast("int").alias("shards")))
    index = staged(build_shards(vectors.join(small_side(lengths), "dim")))
    blocks = max(1, -(-queries.count() // QUERY_ROWS))

    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        q = np.stack(group["vec"].to_numpy())
        return pd.DataFrame({"dim": [key[0]], "qids": [group["id"].to_numpy(np.int64).tobytes()], "qvecs": [q.tobytes()]})

    packed = queries.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int"))
    packed = packed.groupBy("dim", "block").applyInPandas(pack, "dim int, qids binary, qvecs binary")
    packed = packed.join(small_side(lengths), "dim").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                qid = np.frombuffer(row["qids"], np.int64)
                yield search_shard(row, qid, np.frombuffer(row["qvecs"], np.float64).reshape(len(qid), -1), k, read)

    found = packed.join(index, ["dim", "shard"]).mapInPandas(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
