"""SimHash near-duplicates by a self-join of binary tries.

1. A text's words (A-Z lower-cased, split at ASCII white space) make shingles of ``WIDTH``
   words, repeats included; a fingerprint bit is 1 if it is set in over half of their XXH64.
2. Equal fingerprints are one from then on. Two fingerprints that differ in at most ``BUDGET``
   = 4 bits agree in at least one of five parts. So there are five tries, each over the
   fingerprints turned so that another part comes first, and each is joined below the nodes of
   that part, where no bit has been spent yet.
3. The join walks node pairs of a trie together, a bit a step: of (A, B) come (A0, B0) and
   (A1, B1) with the same number of differing bits and (A0, B1) and (A1, B0) with one more; a
   pair over the budget goes. A node is a range of sorted fingerprints. Pairs of a node with
   itself come first and deepest, and node pairs that lie in one component already are left:
   so a task sends a spanning forest of the links, never all pairs within a group.
4. A pair of nodes with more than ``NODE`` fingerprints is no work for one task: such pairs
   take their first steps (``STEP`` bits each) as joins of node counts, until all are small.

Defined results: a null or wordless text has the fingerprint zero, which links like any other; a
text of fewer than ``WIDTH`` words is one shingle; a null doc_id gets a null component and
links nothing; repeated rows are copies; ties do not matter, since a component has one smallest
id; an empty table gives an empty result; columns besides doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, small_side, staged
from .components import components
from .shingles import _LOWER, _cut

WIDTH, SEED, BUDGET = 4, 42, 4
#: Bits of the five parts, and where each begins.
PARTS = (13, 13, 13, 13, 12)
BEGINS = tuple(sum(PARTS[:i]) for i in range(len(PARTS)))
#: Fingerprints of a node pair that one task joins, and the bits of a step where there are more.
NODE, STEP = 1 << 18, 4
#: Rows joined at once in a task (more only for one large node), node pairs walked at once, pairs of fingerprints compared without another step.
ROWS, BLOCK, COMPARED = 1 << 16, 1 << 16, 64
_SIGN = -(1 << 63)


def simhash(text: bytes | None) -> int:
    """The fingerprint of a text as an unsigned number; works on some 100 kB at a time."""
    ones, n, tail = np.zeros(64, np.int64), 0, []
    for piece in _cut((text or b"").translate(_LOWER)):
        tail += piece.split()
        if len(tail) >= WIDTH:
            hashes, tail = _shingle_hashes(tail), tail[1 - WIDTH :]
            ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
            n += len(hashes)
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(tail), SEED) if tail else 0
    return int(np.packbits(2 * ones > n).view(">u8")[0])


def _shingle_hashes(words: list[bytes]) -> np.ndarray:
    data = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - WIDTH + 1].tolist()
    stops = (ends[WIDTH - 1 :] - 1).tolist()
    return np.array([xxhash.xxh64_intdigest(data[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            fps = np.fromiter((simhash(t.as_py()) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _turned(fps: DataFrame) -> DataFrame:
    """(trie, key) of every fingerprint in every trie; keys are turned, and order as signed numbers like their bits."""
    turns = [f"struct({i} as trie, (shiftleft(fp, {b}) | shiftrightunsigned(fp, {64 - b})) ^ {_SIGN} as key)" for i, b in enumerate(BEGINS) if b]
    return fps.selectExpr(f"inline(array(struct(0 as trie, fp ^ {_SIGN} as key), {', '.join(turns)}))")


def _depth(level: int) -> str:
    """Bits of the nodes of a trie on a level of ``node_pairs``."""
    return "case trie " + " ".join(f"when {i} then {min(63, p + level * STEP)}" for i, p in enumerate(PARTS)) + " end"


def _nodes(keys: DataFrame, level: int) -> DataFrame:
    """trie, depth, n (the first ``depth`` bits of the key), key."""
    return keys.selectExpr("trie", f"{_depth(level)} as depth", f"shiftrightunsigned(key ^ {_SIGN}, 64 - {_depth(level)}) as n", "key")


def node_pairs(keys: DataFrame, node: int = NODE) -> list[DataFrame]:
    """Tables (trie, depth, a, b, na, nb) of node pairs, each of at most ``node`` fingerprints, that together hold all links."""
    nodes = _nodes(keys, 0).groupBy("trie", "depth", F.col("n").alias("a")).agg(F.count("*").alias("na"))
    level = staged(nodes.where("na > 1").selectExpr("trie", "depth", "a", "a as b", "na", "na as nb"))
    found, size = [], "if(a = b, na, na + nb)"
    while True:
        found.append(level.where(f"{size} <= {node} or depth = 63"))
        large = staged(level.where(f"{size} > {node} and depth < 63"))
        if large.isEmpty():
            return found
        ends = large.select("trie", "depth", "a").union(large.select("trie", "depth", "b")).distinct()
        ends = small_side(staged(ends.withColumnRenamed("a", "n")))
        below = _nodes(keys, len(found) - 1).join(ends, ["trie", "depth", "n"])
        below = below.selectExpr("trie", "depth", "n", f"{_depth(len(found))} as below", f"shiftrightunsigned(key ^ {_SIGN}, 64 - {_depth(len(found))}) as child")
        below = staged(below.groupBy("trie", "depth", "n", "below", "child").agg(F.count("*").alias("c")))
        for c in ("a", "b"):
            large = large.drop(f"n{c}").join(below.selectExpr("trie", "depth", f"n as {c}", "below", f"child as {c}_child", f"c as n{c}"), ["trie", "depth", c, *(["below"] if c == "b" else [])])
        split = large.where(f"bit_count(a_child ^ b_child) <= {BUDGET} and (a != b or a_child <= b_child)")
        level = staged(split.selectExpr("trie", "below as depth", "a_child as a", "b_child as b", "na", "nb").where("a != b or na > 1"))


class _Join:
    """Walks node pairs over an array of keys in which the keys of every node are a sorted range."""

    def __init__(self, key: np.ndarray) -> None:
        self.key, self.label, self.ones = key, np.arange(len(key)), {}
        self.links: list[tuple[int, int]] = []
        self._mark()

    def _mark(self) -> None:
        self.change = np.concatenate(([0], np.cumsum(self.label[1:] != self.label[:-1])))

    def _middle(self, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
        """Where the keys with a one at ``bit`` begin in ranges of keys that agree before it."""
        if bit not in self.ones:
            one = (self.key >> np.uint64(63 - bit)) & np.uint64(1)
            self.ones[bit] = np.concatenate(([0], np.cumsum(one, dtype=np.int32)))
        return hi - (self.ones[bit][hi] - self.ones[bit][lo])

    def _one(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Whether ranges lie in one component."""
        return self.change[hi - 1] == self.change[lo]

    def _compare(self, alo: np.ndarray, na: np.ndarray, blo: np.ndarray, nb: np.ndarray) -> None:
        """Link the keys of small node pairs."""
        many = na * nb
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        width = np.repeat(nb, many)
        i, j = np.repeat(alo, many) + at // width, np.repeat(blo, many) + at % width
        near = (self.label[i] != self.label[j]) & (np.bitwise_count(self.key[i] ^ self.key[j]) <= BUDGET)
        i, j = i[near], j[near]
        if not len(i):
            return
        # One link for each two components is enough.
        pair = np.stack([np.minimum(self.label[i], self.label[j]), np.maximum(self.label[i], self.label[j])], 1)
        pair, first = np.unique(pair, axis=0, return_index=True)
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while x in up:
                x = up[x]
            return x

        for (x, y), k in zip(pair.tolist(), first.tolist(), strict=True):
            x, y = sorted((root(x), root(y)))
            if x != y:
                up[y] = x
                self.links.append((int(i[k]), int(j[k])))
        new = np.arange(len(self.label))
        for x in up:
            new[x] = root(x)
        self.label = new[self.label]
        self._mark()

    def walk(self, bit: int, alo: np.ndarray, ahi: np.ndarray, blo: np.ndarray, bhi: np.ndarray, err: np.ndarray) -> None:
        """Join node pairs that agree on how many of the first ``bit`` bits differ (``err``); a node may be paired with itself."""
        stack = [(bit, alo, ahi, blo, bhi, err)]
        while stack:
            bit, *block = stack.pop()
            alo, ahi, blo, bhi, err = block
            keep = ~((self.label[alo] == self.label[blo]) & self._one(alo, ahi) & self._one(blo, bhi))
            if keep.sum() > BLOCK:  # the rest waits, so that it can profit from what is found first
                cut = np.flatnonzero(keep)[BLOCK]
                stack.append((bit, *[x[cut:] for x in block]))
                keep[cut:] = False
            alo, ahi, blo, bhi, err = (x[keep] for x in block)
            na, nb = ahi - alo, bhi - blo
            small = na * nb <= COMPARED
            if small.any():
                self._compare(alo[small], na[small], blo[small], nb[small])
            alo, ahi, blo, bhi, err = (x[~small] for x in (alo, ahi, blo, bhi, err))
            if not len(alo):
                continue
            am, bm, self_ = self._middle(alo, ahi, bit), self._middle(blo, bhi, bit), alo == blo
            same = [np.concatenate(x) for x in ((alo, am), (am, ahi), (blo, bm), (bm, bhi), (err, err))]
            other = ~self_  # (A1, B0) of a node and itself is (A0, B1)
            cross = [np.concatenate(x) for x in ((alo, am[other]), (am, ahi[other]), (bm, blo[other]), (bhi, bm[other]), (err + 1, err[other] + 1))]
            for part in (cross, same):
                fit = (part[0] < part[1]) & (part[2] < part[3]) & (part[4] <= BUDGET) & ~((part[0] == part[2]) & (part[1] - part[0] < 2))
                if fit.any():
                    stack.append((bit + 1, *[x[fit] for x in part]))


def _join_rows(trie: np.ndarray, depth: np.ndarray, a: np.ndarray, b: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprints x, y) of whole node pairs whose rows are ordered by all columns."""
    key = key.view(np.uint64) ^ np.uint64(1 << 63)
    new = np.concatenate(([True], (trie[1:] != trie[:-1]) | (depth[1:] != depth[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(key))
    in_a = (key >> (64 - depth).astype(np.uint64)) == a.view(np.uint64)
    mid = lo + np.add.reduceat(in_a.astype(np.int64), lo)
    itself = a[lo] == b[lo]
    err = np.bitwise_count(a[lo] ^ b[lo]).astype(np.int64)
    join = _Join(key)
    for d in np.unique(depth).tolist():
        s = depth[lo] == d
        join.walk(d, lo[s], np.where(itself, hi, mid)[s], np.where(itself, lo, mid)[s], hi[s], err[s])
    if not join.links:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.array(join.links)
    turn = np.array(BEGINS, np.uint64)[trie[ends]]
    fp = (key[ends] >> turn) | (key[ends] << ((np.uint64(64) - turn) & np.uint64(63)))
    return fp[:, 0].view(np.int64), fp[:, 1].view(np.int64)


def trie_links(fps: DataFrame, node: int = NODE) -> DataFrame:
    """(a, b): links that join the same components as all pairs of ``fps`` (distinct fp) within the budget."""
    keys = _turned(fps)
    parts = None  # every row goes to the node pairs of its node; on the first level these are its own and no other's
    for level, pairs in enumerate(node_pairs(keys, node)):
        ends = pairs.selectExpr("trie", "depth", "a", "b", "inline(if(a = b, array(struct(a as n)), array(struct(a as n), struct(b as n))))")
        rows = _nodes(keys, level).join(small_side(staged(ends)), ["trie", "depth", "n"]).select("trie", "depth", "a", "b", "key")
        parts = rows if parts is None else parts.unionByName(rows)

    columns = ("trie", "depth", "a", "b", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])
            rows += batch.num_rows
            if rows >= ROWS:
                whole = [np.concatenate(x) for x in zip(*held, strict=True)]
                last = np.flatnonzero(np.any([x[:-1] != x[1:] for x in whole[:4]], axis=0))
                cut = int(last[-1]) + 1 if len(last) else 0  # the last node pair may go on in the next batch
                if cut:
                    yield links([x[:cut] for x in whole])
                held, rows = [[x[cut:] for x in whole]], rows - cut
        if rows:
            yield links([np.concatenate(x) for x in zip(*held, strict=True)])

    def links(columns: list[np.ndarray]) -> pa.RecordBatch:
        x, y = _join_rows(*columns)
        return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    ordered = parts.repartition("trie", "depth", "a", "b").sortWithinPartitions(*columns)
    return ordered.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, node: int = NODE) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id that links reach)."""
    info = staged(fingerprints(docs))
    known = staged(info.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")))
    roots = components(staged(trie_links(known.select("fp"), node)))
    known = known.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    known = staged(known)
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    named = staged(known.join(least, "root").select("fp", "rows", "component_id"))
    out = join_hot(info.where("doc_id is not null"), named, "fp", "rows")
    out = out.unionByName(info.where("doc_id is null").withColumn("component_id", F.col("doc_id")))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
