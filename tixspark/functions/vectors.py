"""Tokens, hashed embeddings and cosine similarity (SIM-1, SIM-2, SIM-4, SIM-5, SIM-6).

Tokenisation is a JVM regex (``regexp_extract_all``). The lexical embedding hashes each
token with BLAKE2b-8 (index = first 4 bytes big-endian mod dim, sign = low bit of byte
5), adds the signs and L2-normalises; the hash runs in an Arrow UDF
that hashes each *distinct* token once. ``md5_embedding_entries`` is the
same construction with MD5 in native Spark functions, used where a SQL oracle must
reproduce the vector.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

# Worker-side code of this module is shipped by value, so executors do not need the
# package on their path.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(sys.modules[__name__])
except (ImportError, AttributeError):  # pragma: no cover - older cloudpickle
    pass


#: Documents whose sums one task of :func:`md5_embedding_entries` holds.
DEALT = 4096

# Fixed value: the reference's token pattern (applied to lower-cased text).
TOKEN_PATTERN = r"[a-z0-9_./:-]+"


def tokens(text: Column) -> Column:
    """SIM-1."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN_PATTERN), 0)


def _token_slot(token: str, dim: int) -> tuple[int, float]:
    digest = hashlib.blake2b(token.encode("utf-8"), digest_size=8).digest()
    return int.from_bytes(digest[:4], "big") % dim, (1.0 if digest[4] & 1 else -1.0)


def lexical_embed_tokens(toks: list[str] | np.ndarray, dim: int, cache: dict | None = None) -> np.ndarray:
    """One document's normalised signed bag-of-tokens vector (zero vector stays zero)."""
    vec = np.zeros(dim, dtype=np.float64)
    cache = {} if cache is None else cache
    for t in toks:
        slot = cache.get(t)
        if slot is None:
            slot = cache[t] = _token_slot(t, dim)
        vec[slot[0]] += slot[1]
    norm = float(np.sqrt((vec * vec).sum()))
    return vec / norm if norm else vec


def _md5_slot(token: str, dim: int) -> tuple[int, float]:
    digest = hashlib.md5(token.encode("utf-8")).digest()
    return int.from_bytes(digest[:4], "big") % dim, (1.0 if digest[4] & 1 else -1.0)


#: Texts whose sums :func:`_embed_lists` holds at once, and distinct tokens whose slots a worker remembers.
TEXTS, KNOWN = 512, 1 << 17


def _embed_lists(lists: pa.Array, dim: int, slot: Callable[[str, int], tuple[int, float]], kind: type, known: dict[str, int]) -> pa.Array:
    """The vectors of token lists. Tokens are told apart and counted as Arrow and numpy hold them, not one by one.
    ``known`` has twice the index of a token's slot, and one more where it counts as 1."""
    out = []
    for a in range(0, len(lists), TEXTS):
        part = lists.slice(a, TEXTS)
        length = pc.fill_null(pc.list_value_length(part), 0).to_numpy()
        coded = part.flatten().dictionary_encode()
        if len(known) > KNOWN:
            known.clear()
        names = coded.dictionary.to_pylist()
        for t in names:
            if t not in known:
                at, sign = slot(t, dim)
                known[t] = 2 * at + (sign > 0)
        slots = np.fromiter((known[t] for t in names), np.int64, len(names))
        code = coded.indices.to_numpy()
        place = np.repeat(np.arange(len(part)) * dim, length) + (slots >> 1)[code]
        vec = np.bincount(place, ((slots & 1) * 2.0 - 1)[code], len(part) * dim).reshape(-1, dim)
        norm = np.sqrt((vec * vec).sum(1, keepdims=True))
        out.append((vec / np.where(norm > 0, norm, 1)).astype(kind, copy=False).ravel())
    pa.default_memory_pool().release_unused()  # the worker stays while the vectors are used
    flat = np.concatenate(out or [np.zeros(0, kind)])
    return pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1, dtype=np.int32) * dim), pa.array(flat))


def lexical_embedding(token_array: Column, dim: int = 384) -> Column:
    """SIM-2 as an Arrow UDF over the JVM-produced token arrays."""
    known: dict[str, int] = {}

    @F.arrow_udf(ArrayType(FloatType()))
    def _embed(batch: pa.Array) -> pa.Array:
        return _embed_lists(batch, dim, _token_slot, np.float32, known)

    return _embed(token_array)


def embed_text(text: Column, dim: int = 384) -> Column:
    """SIM-5 default: the lexical embedding of the text. A model-based embedding plugs in
    as any function Column → array<float> with the same contract (normalised, length dim)."""
    return lexical_embedding(tokens(text), dim)


def embed_text_md5(text: Column, dim: int = 384) -> Column:
    """SIM-2 with MD5 instead of BLAKE2b, as an embedding function with exact doubles (routing that SQL can follow)."""

    known: dict[str, int] = {}

    @F.arrow_udf("array<double>")
    def run(batch: pa.Array) -> pa.Array:
        return _embed_lists(batch, dim, _md5_slot, np.float64, known)

    return run(tokens(text))


def md5_embedding_entries(df: DataFrame, id_col: str, text_col: str, dim: int) -> DataFrame:
    """SIM-2 with MD5 instead of BLAKE2b, natively: sparse (id, idx, value) rows.

    Texts are dealt by document, ``DEALT`` rows to a task; tokens explode, are added per (document, idx) and divided by the
    document's norm in that task. It holds at most ``dim`` sums a document, whatever the number of documents.
    """
    # The count is taken of the ids alone (of the footers, where the rows are a table).
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.select(id_col).count() // DEALT))
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null").repartition(tasks, "id")
    # explode_outer + filter so the token scan is not repeated in an inferred size() filter.
    t = docs.select("id", F.explode_outer(tokens(F.col("text"))).alias("tok")).where(F.col("tok").isNotNull())
    h = F.md5(F.encode("tok", "UTF-8"))
    slots = t.select(
        "id",
        F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint"), F.lit(dim)).cast("int").alias("idx"),
        F.when((F.conv(F.substring(h, 9, 2), 16, 10).cast("int") % 2) == 1, 1.0).otherwise(-1.0).alias("sgn"),
    )
    summed = slots.groupBy("id", "idx").agg(F.sum("sgn").alias("v")).where(F.col("v") != 0)
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("id")))  # at most dim rows, on the same exchange
    return summed.select(F.col("id").alias(id_col), "idx", (F.col("v") / norm).alias("value"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                       lambda s, v: s + v)


def cosine_unit(a: Column, b: Column) -> Column:
    """SIM-4: dot product of two unit vectors clamped to [-1, 1]; 0 when either is
    empty or the lengths differ."""
    ok = (F.size(a) > 0) & (F.size(b) > 0) & (F.size(a) == F.size(b))
    return F.when(ok, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))).otherwise(F.lit(0.0))


def dim_guard(embedding: Column, dim: int) -> Column:
    """SIM-6."""
    return F.size(embedding) == dim
