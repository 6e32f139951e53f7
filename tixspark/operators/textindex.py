"""A trigram posting index for free-text search (FLT-2).

A literal of three characters or more can be in a text only if all its trigrams are. Postings (gram, ticket_id)
are stored bucketed and sorted by gram, so a search reads the row groups of its own grams. Each
batch of tickets adds its own postings. Candidates are checked against the literal afterwards, so
the answer is that of a scan; shorter literals do scan.

A task lists the tickets of each gram over a block of tickets (``BLOCK`` characters), so what is shuffled, sorted and
stored is a row per gram and block, and no row per gram and ticket; the store gives them back as rows. A ticket is
once in a list, and again in another block only with another of its versions.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import KEY, FactStore

# Worker-side code is shipped by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Characters that are indexed at a time; a longer text is a block of its own.
BLOCK = 1 << 22

#: Candidate ids up to this many are pushed into the scan as literals; more are joined.
PUSHED = 1000


def grams_of(literal: str) -> list[str]:
    return sorted({literal[i : i + 3] for i in range(len(literal) - 2)})


def posting_lists(keys: pa.Array, columns: list[pa.Array]) -> pa.RecordBatch:
    """gram, ticket_id (the distinct ``keys`` of the rows with it, ascending) of the trigrams of ``columns``."""
    names = pc.unique(keys).sort()
    owner = np.asarray(pc.index_in(keys, names), np.int64)
    found = []
    for texts in columns:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        sizes = np.asarray(pc.utf8_length(texts), np.int64)
        points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
        begins = np.flatnonzero(np.arange(len(points)) + 2 < np.repeat(np.cumsum(sizes), sizes))
        found.append((points, begins, np.repeat(owner, sizes)[begins]))
    alphabet = np.unique(np.concatenate([p for p, _, _ in found]))
    n, width, pairs = len(alphabet), max(1, len(names)), []
    for points, begins, rows in found:
        at = np.searchsorted(alphabet, points)
        gram = (at[begins] * n + at[begins + 1]) * n + at[begins + 2]
        # A block of very many different characters and tickets needs more than 63 bits.
        pairs.append(np.unique((gram if n**3 * width < 1 << 62 else gram.astype(object)) * width + rows))
    pairs = np.unique(np.concatenate(pairs))
    gram, row = (pairs // width).astype(np.int64), (pairs % width).astype(np.int64)
    starts = np.flatnonzero(np.diff(gram, prepend=-1))
    letters = alphabet[np.stack([gram[starts] // n // n, gram[starts] // n % n, gram[starts] % n], 1)] if len(gram) else np.zeros((0, 3), np.uint32)
    text = np.ascontiguousarray(letters.astype("<u4")).tobytes().decode("utf-32-le")
    grams = pa.array([text[i : i + 3] for i in range(0, len(text), 3)], pa.string())
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(gram)), pa.int32()), names.take(pa.array(row)))
    return pa.RecordBatch.from_arrays([grams, lists], ["gram", KEY])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The posting lists of the rows (key, size in bytes, texts) a block at a time."""
    for batch in batches:
        total = np.cumsum(np.asarray(batch.column(1), np.int64))
        at = 0
        while at < len(total):
            before = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, before + BLOCK, "right")))
            part = batch.slice(at, end - at)
            lists = posting_lists(part.column(0), part.columns[2:])
            # What leaves at a time is bounded as well.
            for i in range(0, lists.num_rows, 4096):
                yield lists.slice(i, 4096)
            at = end


@dataclass(frozen=True)
class TextIndex:
    store: FactStore
    table: str
    columns: tuple[str, ...]

    @property
    def postings(self) -> str:
        return f"{self.table}.grams"

    def advance(self) -> bool:
        """Add the postings of the batches that have none yet."""
        done, last = self.store.last_batch(self.postings), self.store.last_batch(self.table)
        if last <= done:
            return False
        texts = [F.lower(F.coalesce(F.col(c), F.lit(""))).alias(f"t{i}") for i, c in enumerate(self.columns)]
        rows = self.store.read(self.table, done).select(F.col(KEY).cast("string").alias(KEY), *texts)
        rows = rows.select(KEY, sum((F.octet_length(f"t{i}") for i in range(len(texts))), F.lit(0)).cast("long").alias("size"), *[f"t{i}" for i in range(len(texts))])
        new = rows.mapInArrow(_blocks, f"gram string, {KEY} array<string>")
        return self.store.append(self.postings, new, last, "gram", listed=KEY)

    def candidates(self, literal: str) -> DataFrame | None:
        """ticket_id of the tickets that may hold ``literal`` in any version; None if it is too short for the index."""
        grams = grams_of(literal.lower())
        if not grams:
            return None
        hits = self.store.read(self.postings).where(F.col("gram").isin(grams))
        return hits.groupBy(KEY).agg(F.count_distinct("gram").alias("hits")).where(F.col("hits") == len(grams)).select(KEY)

    def restrict(self, tickets: DataFrame, literal: str) -> DataFrame:
        """``tickets`` without those that can't hold ``literal``: few ids reach the scan, more are a semi join."""
        ids = self.candidates(literal)
        if ids is None:
            return tickets
        first = [r[0] for r in ids.limit(PUSHED + 1).collect()]
        return tickets.where(F.col(KEY).isin(first)) if len(first) <= PUSHED else tickets.join(ids, KEY, "left_semi")
