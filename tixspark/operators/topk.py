"""Exact top-k cosine search of query vectors against a corpus (SIM-3, WIN-1, JOIN-5).

Brute force, as the reference, over packed blocks (:mod:`tixspark.operators.blocks`): no worker compares more than
one query block and one corpus block at a time, no pair is ever materialised as a row, and
nothing is copied for every pair of blocks:

1. queries and corpus are packed into blocks of about ``block_rows`` rows and written once; of equal vectors
   of a corpus block only the first k (or k + 1) in the corpus order can be among the k best and are kept;
2. every task streams corpus blocks past its query blocks, one after the other, and keeps each query's k best rows
   (ties at the k-th value are ordered exactly); cells of a block that can't hold any of these are left out;
3. the lists are merged with ``row_number() <= k`` per query, which Spark plans as a
   WindowGroupLimit; a query has one list for each part of the corpus files.

Written: queries + corpus once. The comparisons are queries x corpus, as those of the exact answer, less those that a
bound on the nearest row of a cell saves; how many depends on the vectors.

Order (the reference's): fast flag desc, similarity desc, then the corpus order
columns ascending. A zero vector has no similarity (NULL, sorted last: Q3).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from .blocks import pack, scan


def fill_short(found: DataFrame, queries: DataFrame, head: DataFrame, k: int, order: Sequence[str], exclude_self: bool, rank: Column) -> DataFrame:
    """``found`` with ranks up to k. Queries (qid, dim) with fewer than k comparable rows go on with the first others in the
    corpus order, without a similarity. ``head`` (dim, the columns of ``order``) holds the first 2k + 1 rows of the corpus."""
    have = found.groupBy("qid").agg(F.count("*").alias("have"))
    short = queries.join(have, "qid", "left").where(F.coalesce("have", F.lit(0)) < k)
    fill = short.withColumnRenamed("dim", "qdim").crossJoin(F.broadcast(head)).where("qdim = 0 or dim != qdim")  # a few rows
    if exclude_self:
        fill = fill.where(F.coalesce(F.col(order[-1]) != F.col("qid"), F.lit(True)))
    both = found.unionByName(fill.drop("qdim", "have", "dim").withColumn("similarity", F.lit(None).cast("double")))
    return both.withColumn("rank", rank).where(F.col("rank") <= k)


def topk_similar(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    query_id: str = "query_id",
    query_vec: str = "query_embedding",
    corpus_id: str = "ticket_id",
    corpus_vec: str = "embedding",
    corpus_order: Sequence[str] = ("created_at", "ticket_id"),
    carry: Sequence[str] = (),
    fast_threshold: float = 0.95,
    exclude_self: bool = False,
    block_rows: int = 4096,
) -> DataFrame:
    """Top-k corpus rows per query: (query_id, rank, corpus_id, similarity, fast_candidate, *carry)."""
    if k < 1:
        raise ValueError("k must be >= 1")
    order_cols = [c for c in corpus_order if c != corpus_id]
    carry_cols = [c for c in carry if c not in (corpus_id, *order_cols)]
    order = (*order_cols, "_cid")
    q = queries.select(F.col(query_id).alias("_qid"), F.col(query_vec).alias("_qv"))
    q = staged(pack(q, "_qv", (), block_rows))
    c = corpus.select(F.col(corpus_id).alias("_cid"), F.col(corpus_vec).alias("_cv"), *order_cols, *carry_cols)
    c = staged(pack(c, "_cv", order, block_rows, copies=k + 1, cells=True))

    found = scan(q, c, k, "_qid", order, exclude_self)
    fast = F.coalesce((F.col("similarity") >= fast_threshold).cast("int"), F.lit(0))
    w = Window.partitionBy("qid").orderBy(
        fast.desc(), F.col("similarity").desc_nulls_last(), *[F.col(x).asc() for x in order])
    rank = F.row_number().over(w)
    found = staged(found.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank"))
    head = c.select("dim", F.inline(F.slice("rows", 1, 2 * k + 1))).orderBy(*[F.col(x).asc() for x in order]).limit(2 * k + 1)
    asked = q.select("dim", F.inline(F.transform("rows", lambda x: F.struct(x["_qid"].alias("qid")))))
    ranked = fill_short(found, asked, head, k, order, exclude_self, rank)
    return ranked.select(
        F.col("qid").alias(query_id), "rank", F.col("_cid").alias(corpus_id), "similarity",
        fast.alias("fast_candidate"), *order_cols, *carry_cols)
