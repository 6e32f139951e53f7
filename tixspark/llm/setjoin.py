"""N-gram Jaccard join with set-relation skipping, and its near-duplicate classes.

Every text becomes the set of its distinct word shingles; equal sets are one set from then on.
Two sets link when 100 * |a n b| >= 80 * |a u b|. The steps:

1. Shingles are counted over all documents; the most frequent ones come last in the order of
   prefixes. The order decides the speed only, never the result.
2. Of sets that share two bucket minima, the one with the largest share of frequent shingles
   leads (of edited copies, the one with the fewest edits); sets are compared with their leader and
   the leader of that one. Sets that really link to a leader are the highly similar sets whose
   answers are used later. A set that shares half of itself with a leader is in its group, linked or not.
3. Prefixes are grouped by shingle. Index lists are ordered by set size, then position; for a
   set, only the blocks of sizes that can link are entered, and a block is left at the first
   position that the positional bound rules out. Sets known to be linked are not paired, nor
   those whose parity bitmaps (a bit for each of 256 hash classes) differ in more places than
   linked sets have shingles of their own, nor those of which one has too few shingles in all lists
   to share as many as a link needs. Nor are sets a, b of one group where the leader's answers
   |L n a| and |L n b| are too small: |a n b| <= min(|L n a|, |L n b|) + |(a - L) n (b - L)|, so such
   sets link only with shingles in common that L does not have. These few have lists of their own,
   in groups that hold more than one component; edited copies just below the threshold, which
   have most of L in common, are not paired by it.
4. Answers are derived: with d(x) the part of x outside its leader and L, M the leaders of a, b,
   |a n b| <= |L n M| + d(a) + d(b), and >= |L n M| less the parts of the leaders outside a and b.
   Only pairs that these bounds leave open are compared.
5. Links join into components; no pair is needed inside a component that is already known.

Defined results: null texts and texts without words have an empty set, which links with nothing
and is its own component; a null doc_id gets a null component and takes no part; repeated rows
are copies; ties do not matter, since a component has one smallest id; an empty table gives an
empty result; columns besides doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_hot, small_side, staged
from .components import components
from .shingles import WIDTH, mix, set_id, shingle_sets

#: Share of the union that two sets have in common at least, as NUM / DEN.
NUM, DEN = 4, 5
#: Minima of hash ranges, two of which make a key for leaders.
RANGES, KEYS = 8, 4
#: Shingles in at least HEAVY documents are told to all tasks, the most frequent TOLD of them at most (16 bytes each).
HEAVY, TOLD = 24, 1 << 20
#: Shingles kept in a task before they are sent on, and entries (17 bytes each) of index lists.
FLUSH, FLUSH_LISTS = 1 << 20, 1 << 18
#: Shingles, and entries of index lists, that a pandas group is to hold about; there are as many groups as that takes.
GROUP, GROUP_LISTS = 1 << 20, 1 << 18
#: Bytes of text for a shingle, about. It decides the number of groups only.
WORD_BYTES = 6
#: Rows of texts worked on at once.
ROWS = 256
#: Columns of the parity bitmap.
BITMAP = ("b0", "b1", "b2", "b3")
#: Index lists of up to this many sets are paired all at once.
SHORT = 32


def needed(a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | int:
    """The least overlap of linked sets of sizes a and b: ceil(NUM / (NUM + DEN) * (a + b))."""
    return -(-NUM * (a + b) // (NUM + DEN))


def _prefix(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Rows with their sets, a few at a time: Arrow batches may hold tens of MB of text."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, list(shingle_sets(part.column("text").to_pylist()))


Frequent = tuple[np.ndarray, np.ndarray]


def _counts(s: np.ndarray, frequent: Frequent) -> np.ndarray:
    """How many documents have each shingle of a set, 0 for those that are not frequent."""
    tokens, dfs = frequent
    if not len(tokens):
        return np.zeros(len(s), np.int64)
    short = (s >> np.uint64(24)).astype(np.int64)
    at = np.minimum(np.searchsorted(tokens, short), len(tokens) - 1)
    return np.where(tokens[at] == short, dfs[at], 0)


def describe(docs: DataFrame, frequent: Broadcast) -> DataFrame:
    """doc_id, text_key, set_id, n, keys, shared (the share of frequent shingles) of each row."""
    edges = (np.arange(1, RANGES, dtype=np.uint64) << np.uint64(64 - RANGES.bit_length() + 1)).astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches):
            keys, shared, bitmaps = [], [], []
            for s in sets:
                cut = [0, *np.searchsorted(s, edges).tolist(), len(s)]
                least = [int(s[cut[i]]) if cut[i] < cut[i + 1] else None for i in range(RANGES)]
                pairs = ((least[2 * k], least[2 * k + 1], k) for k in range(KEYS))
                keys.append([(a * 3 + b * 5 + c) % (1 << 64) - (1 << 63) for a, b, c in pairs if a is not None and b is not None])
                shared.append(float((_counts(s, frequent.value) > 0).mean()) if len(s) else 0.0)
                odd = np.bincount((s & np.uint64(255)).astype(np.int64), minlength=256) & 1
                bitmaps.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_key"), pa.array([set_id(s) for s in sets], pa.int64()),
                 pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(shared, pa.float64()),
                 *[pa.array([b[i] for b in bitmaps], pa.int64()) for i in range(4)]],
                names=["doc_id", "text_key", "set_id", "n", "keys", "shared", *BITMAP],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, text_key long, set_id long, n long, keys array<long>, shared double, " + ", ".join(f"{b} long" for b in BITMAP))


def _rows(parts: int, values: np.ndarray, columns: list[np.ndarray], dealt: bool = False) -> Iterator[pa.RecordBatch]:
    """Byte planes of columns (ordered by ``values``), a row for each of ``parts`` ranges of the values, or (``dealt``) of their hashes."""
    if not len(values):
        return
    step = (1 << 64) // parts + 1
    to = (mix(values) if dealt else values) // np.uint64(step)
    order = np.lexsort((values, to)) if dealt else np.argsort(values, kind="stable")
    cuts = np.searchsorted(to[order], np.arange(1, parts, dtype=np.uint64))
    planes = [np.ascontiguousarray(c[order]).view(np.uint8).reshape(len(order), -1) for c in columns]
    part, n, data = [], [], []
    for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(order)], strict=True)):
        if b > a:
            part.append(i)
            n.append(int(b - a))
            data.append(b"".join(p[a:b].T.tobytes() for p in planes))
    yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(n, pa.int32()), pa.array(data, pa.binary())], names=["part", "n", "data"])


def _planes(group: pd.DataFrame, widths: list[int]) -> list[np.ndarray]:
    """The inverse of ``_rows`` for one part: for each column the rows x width bytes."""
    found: list[list[np.ndarray]] = [[] for _ in widths]
    for n, data in zip(group["n"], group["data"], strict=True):
        raw, at = np.frombuffer(data, np.uint8), 0
        for k, w in enumerate(widths):
            found[k].append(raw[at : at + n * w].reshape(w, n).T)
            at += n * w
    return [np.concatenate(f) for f in found]


def _wide(b: np.ndarray, kind: str) -> np.ndarray:
    return np.ascontiguousarray(b).view(kind).ravel()


def _parts(df: DataFrame, entries: int, group: int) -> int:
    """The number of pandas groups for so many entries: a group does not grow with the table."""
    return max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-entries // group))


def frequent_shingles(texts: DataFrame, parts: int) -> DataFrame:
    """(token, df): the first 40 bits of shingles in at least HEAVY documents. Copies within a batch count once."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for _, sets in _sets(batches):
            for s in {set_id(s): s for s in sets}.values():
                kept.append(s)
                size += len(s)
                if size >= FLUSH:
                    yield from flush(kept)
                    kept, size = [], 0
        yield from flush(kept)

    def flush(kept: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if kept:
            all_ = np.sort(np.concatenate(kept))
            first = all_.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :5]
            yield from _rows(parts, all_, [first])

    def count(group: pd.DataFrame) -> pd.DataFrame:
        (b,) = _planes(group, [5])
        value = np.zeros((len(b), 8), np.uint8)
        value[:, 3:] = b
        token, df = np.unique(_wide(value, ">u8").astype(np.int64), return_counts=True)
        return pd.DataFrame({"token": token[df >= HEAVY], "df": df[df >= HEAVY].astype(np.int64)})

    packed = texts.select("text").mapInArrow(send, "part int, n int, data binary")
    return packed.groupBy("part").applyInPandas(count, "token long, df long")


def packed_prefixes(texts: DataFrame, frequent: Broadcast, parts: int) -> DataFrame:
    """(part, n, data): the entries of index lists, for each set that a task has. See ``_rows``.

    Of a shingle the first 40 bits are sent. Shingles that agree in these share a list: pairs may
    be counted too often, never too seldom, as entries at different positions stay apart. Prefixes
    hold the lowest hashes of sets, so shingles are dealt to parts by a hash of their own.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = {}, 0
        for _, sets in _sets(batches):
            for s in sets:
                if not len(s) or (key := set_id(s)) in kept:
                    continue
                df = _counts(s, frequent.value)
                if df.any():
                    s = s[np.argsort(df, kind="stable")]
                p = s[: _prefix(len(s))].copy()
                kept[key] = p
                size += len(p)
                if size >= FLUSH_LISTS:
                    yield from flush(kept)
                    kept, size = {}, 0
        yield from flush(kept)

    def flush(kept: dict) -> Iterator[pa.RecordBatch]:
        if kept:
            many = [len(p) for p in kept.values()]
            token = np.concatenate(list(kept.values()))
            key = np.repeat(np.array(list(kept), np.int64), many)
            pos = np.concatenate([np.arange(m, dtype=np.uint32) for m in many])
            token &= ~np.uint64((1 << 24) - 1)
            yield from _rows(parts, token, [token.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :5], key, pos], dealt=True)

    return texts.select("text").mapInArrow(send, "part int, n int, data binary")


def index_lists(texts: DataFrame, frequent: Broadcast, parts: int) -> DataFrame:
    """(token, set_id, pos) of the prefixes, for the shingles that are in the prefix of two sets or more."""

    def lists(group: pd.DataFrame) -> pd.DataFrame:
        t, key, pos = _planes(group, [5, 8, 4])
        value = np.zeros((len(t), 8), np.uint8)
        value[:, :5] = t
        token, key, pos = _wide(value, ">u8").astype(np.uint64).view(np.int64), _wide(key, np.int64), _wide(pos, np.uint32)
        order = np.lexsort((pos, key, token))
        token, key, pos = token[order], key[order], pos[order]
        fresh = np.ones(len(token), bool)  # one entry for a set that several tasks sent
        fresh[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1]) | (pos[1:] != pos[:-1])
        token, key, pos = token[fresh], key[fresh], pos[fresh]
        same = token[1:] == token[:-1]
        more = np.append(same, False) | np.insert(same, 0, False)
        return pd.DataFrame({"token": token[more], "set_id": key[more], "pos": pos[more].astype(np.int32)})

    packed = packed_prefixes(texts, frequent, parts)
    return packed.groupBy("part").applyInPandas(lists, "token long, set_id long, pos int")


def _fits(ni: np.ndarray, pi: np.ndarray, nj: np.ndarray, pj: np.ndarray) -> np.ndarray:
    """Whether sets of sizes ni >= nj with a shingle in common at places pi, pj can link.

    Before the shingle they share at most min(pi, pj) others, after it what is left of the shorter rest.
    """
    least = needed(ni, nj)
    return (DEN * nj >= NUM * ni) & (pi - pj <= ni - least) & (pj - pi <= nj - least)


def _near(bits: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the bitmaps allow a link: a shingle in one set only turns one bit, and linked sets have few such."""
    apart = np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64)
    return apart <= n[i] + n[j] - 2 * needed(n[i], n[j])


#: Of each row of index lists: the set's leader, its overlap with it, and how many rows the set has in all lists.
Told = tuple[np.ndarray, np.ndarray, np.ndarray]


def _rest(n: np.ndarray, ov: np.ndarray, i: np.ndarray, j: np.ndarray, answered: bool) -> np.ndarray:
    """What sets share at most besides the shingles that lists have of both.

    In lists of prefixes, the set whose prefix ends first shares at most its rest; in lists of all
    shingles outside a leader, what both share with the leader is left.
    """
    return np.minimum(ov[i], ov[j]) if answered else -(-NUM * np.maximum(n[i], n[j]) // DEN) - 1


def _open(told: Told, n: np.ndarray, i: np.ndarray, j: np.ndarray, answered: bool) -> np.ndarray:
    """Whether sets can link by the number of their rows, and (``answered``) one leader's answers leave that to other shingles, or do not."""
    lead, ov, many = told
    least = needed(n[i], n[j])
    ruled = (lead[i] == lead[j]) & (np.minimum(ov[i], ov[j]) < least)
    return (ruled == answered) & (np.minimum(many[i], many[j]) + _rest(n, ov, i, j, answered) >= least)


def _short_lists(
    token: np.ndarray, n: np.ndarray, pos: np.ndarray, comp: np.ndarray, bits: np.ndarray, longest: int, told: Told, answered: bool
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (later, earlier) of rows of index lists of at most ``longest`` rows, all lists at once."""
    for d in range(1, longest):
        i = np.flatnonzero(token[d:] == token[:-d]) + d
        if not len(i):
            return
        j = i - d
        keep = (comp[i] != comp[j]) & _fits(n[i], pos[i], n[j], pos[j]) & _open(told, n, i, j, answered)
        i, j = i[keep], j[keep]
        keep = _near(bits, n, i, j)
        yield i[keep], j[keep]


def _long_list(n: np.ndarray, pos: np.ndarray, comp: np.ndarray, bits: np.ndarray, told: Told, answered: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one index list, ordered by size and position.

    For each row only the blocks of sizes that can link are entered, and of a block only the
    stretch of positions that the positional bounds allow.
    """
    sizes, begin = np.unique(n, return_index=True)
    begin = np.append(begin, len(n))
    for i in range(len(n)):
        for k in range(np.searchsorted(sizes, -(-NUM * n[i] // DEN)), len(sizes)):
            a, b = begin[k], min(begin[k + 1], i)
            if a >= b:
                break
            least = needed(int(n[i]), int(sizes[k]))
            low, high = pos[i] - (n[i] - least), pos[i] + (sizes[k] - least)
            a, b = a + np.searchsorted(pos[a:b], low), a + np.searchsorted(pos[a:b], high, side="right")
            j = np.arange(a, b)[comp[a:b] != comp[i]]
            j = j[_open(told, n, np.full(len(j), i), j, answered)]
            if len(j) and len(j := j[_near(bits, n, np.full(len(j), i), j)]):
                yield np.full(len(j), i), j


def list_pairs(
    token: np.ndarray, n: np.ndarray, pos: np.ndarray, comp: np.ndarray, bits: np.ndarray, short: int = SHORT,
    told: Told | None = None, answered: bool = False,
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (later, earlier) of rows of the index lists (ordered by token, n, pos) that can link and are not known to.

    With ``told``, only pairs that their leader's answers rule out but for other shingles (``answered``), or all others.
    """
    if told is None:
        told = np.arange(len(n)), n, n
    cuts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    ends = np.append(cuts[1:], len(token))
    apart = np.add.reduceat((comp != np.repeat(comp[cuts], ends - cuts)).astype(np.int64), cuts) > 0
    few = apart & (ends - cuts <= short)
    at = np.flatnonzero(np.repeat(few, ends - cuts))
    found = [(at[i], at[j]) for i, j in _short_lists(token[at], n[at], pos[at], comp[at], bits[at], short, tuple(x[at] for x in told), answered)]
    for a, b in zip(cuts[apart & ~few].tolist(), ends[apart & ~few].tolist(), strict=True):
        found += [(i + a, j + a) for i, j in _long_list(n[a:b], pos[a:b], comp[a:b], bits[a:b], tuple(x[a:b] for x in told), answered)]
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *[f[k] for f in found]]) for k in (0, 1))


def listed_pairs(lists: DataFrame, answered: bool = False) -> DataFrame:
    """(a, b, na, nb, rest, c) with a < b from ``lists`` (token, set_id, n, pos, comp, lead, ov, many and the bitmap).

    c counts the lists of a task that hold both; for rest see ``_rest``.
    """

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            if rest is not None:
                batch = pd.concat([rest, batch], ignore_index=True)
            last = batch["token"].iloc[-1] if len(batch) else None
            whole = np.searchsorted(batch["token"].to_numpy(), last) if len(batch) else 0
            rest = batch.iloc[whole:]
            if whole:
                yield found(batch.iloc[:whole])
        if rest is not None and len(rest):
            yield found(rest)

    def found(batch: pd.DataFrame) -> pd.DataFrame:
        token, key, n, pos, comp, *told = (batch[c].to_numpy() for c in ("token", "set_id", "n", "pos", "comp", "lead", "ov", "many"))
        bits = np.stack([batch[b].to_numpy() for b in BITMAP], 1).view(np.uint64)
        i, j = list_pairs(token, n, pos.astype(np.int64), comp, bits, told=tuple(told), answered=answered)
        x, y = np.where(key[i] < key[j], i, j), np.where(key[i] < key[j], j, i)
        out = pd.DataFrame({"a": key[x], "b": key[y], "na": n[x], "nb": n[y], "rest": _rest(n, told[1], i, j, answered)})
        return out.groupby(["a", "b", "na", "nb", "rest"], as_index=False).size().rename(columns={"size": "c"})

    ordered = lists.repartition("token").sortWithinPartitions("token", "n", "pos")
    return ordered.mapInPandas(pairs, "a long, b long, na long, nb long, rest long, c long")


def candidate_pairs(lists: DataFrame, answered: bool = False) -> DataFrame:
    """(a, b) with a < b of the listed pairs that share enough: |a n b| <= count + rest."""
    counted = listed_pairs(lists, answered).groupBy("a", "b", "na", "nb", "rest").agg(F.sum("c").alias("c"))
    return counted.where(f"{NUM + DEN} * (c + rest) >= {NUM} * (na + nb)").select("a", "b")


def outside_lists(leads: DataFrame, known: DataFrame) -> DataFrame:
    """Lists (token, set_id, n, pos) of the shingles that sets have outside their leader; lists are of one group.

    Groups of one component have none.
    """
    mixed = known.groupBy("lead").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("c"))
    mixed = staged(mixed.where("c0 < c1").select("lead", "c"))
    rows = join_hot(leads, mixed, "lead", "c").select("set_id", "lead", "own").join(known.select("set_id", "n"), "set_id")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                own = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column("own")]
                at = np.repeat(np.arange(len(own)), [len(o) for o in own])
                columns = [pa.array(np.concatenate(own))] + [pa.array(part.column(c).to_numpy()[at]) for c in ("lead", "set_id", "n")]
                yield pa.RecordBatch.from_arrays(columns, names=["token", "lead", "set_id", "n"])

    rows = rows.mapInArrow(spread, "token long, lead long, set_id long, n long")
    return rows.select(F.xxhash64("lead", "token").alias("token"), "set_id", "n", F.lit(0).alias("pos"))


def overlaps(pairs: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the exact sizes na, nb, ov = |a n b| and own, b's shingles outside a.

    own is null where less than half of the larger set is in common. Texts are read again for the sets needed only.
    """
    pairs = staged(pairs)
    want = pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct()
    want = staged(want.join(sets, "set_id").select("set_id", "doc_id", "text_key"))

    def content(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _sets(batches):
            out = {k: s.tobytes() for k, s in zip(part.column("set_id").to_pylist(), found, strict=True) if set_id(s) == k}
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.binary())], names=["set_id", "data"])

    rows = docs.join(small_side(want), ["doc_id", "text_key"]).select("set_id", "text")
    data = staged(rows.mapInArrow(content, "set_id long, data binary").groupBy("set_id").agg(F.first("data").alias("data")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb, ov, own = [], [], [], []
            for x, y in zip(batch.column("xa"), batch.column("xb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y
                na.append(len(x))
                nb.append(len(y))
                ov.append(int(both.sum()))
                own.append(y[~both].tobytes() if 2 * ov[-1] >= max(len(x), len(y)) else None)
            sizes = [pa.array(v, pa.int64()) for v in (na, nb, ov)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *sizes, pa.array(own, pa.binary())], names=["a", "b", "na", "nb", "ov", "own"])

    both = pairs.join(data.select(F.col("set_id").alias("a"), F.col("data").alias("xa")), "a")
    both = both.join(data.select(F.col("set_id").alias("b"), F.col("data").alias("xb")), "b")
    return staged(both.select("a", "b", "xa", "xb").mapInArrow(compare, "a long, b long, na long, nb long, ov long, own binary"))


_LINKED = f"{NUM + DEN} * ov >= {NUM} * (na + nb)"


def _leaders(sets: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (a: leader, b, na, nb, ov) of sets with leaders, and each set's leader (set_id, lead, ov, own), linked or not.

    Leaders are those of the keys that a set has, and the leader of the first of them. A set's
    own leader is the first (by its share of frequent shingles) that has half of it.
    """
    keyed = sets.select("set_id", "shared", F.explode("keys").alias("key"))
    lead = F.max(F.struct("shared", "set_id")).alias("x")
    least = staged(keyed.groupBy("key").agg(lead, F.count("*").alias("c")).where("c > 1").select("key", F.col("x.set_id").alias("a"), F.col("x.shared").alias("rank")))
    stars = staged(keyed.join(least, "key").where("set_id != a").select("a", F.col("set_id").alias("b"), "rank").distinct())
    first = staged(stars.groupBy("b").agg(F.max(F.struct("rank", "a")).alias("x")).select("b", F.col("x.a").alias("a")))
    second = first.join(first.select(F.col("b").alias("a"), F.col("a").alias("up")), "a").select(F.col("up").alias("a"), "b")
    found = overlaps(stars.select("a", "b").unionByName(second).distinct(), docs, sets)
    ranked = found.where("own is not null").join(sets.select(F.col("set_id").alias("a"), "shared"), "a")
    leads = ranked.groupBy("b").agg(F.max(F.struct("shared", "a", "ov", "own")).alias("x"))
    leads = staged(leads.select(F.col("b").alias("set_id"), F.col("x.a").alias("lead"), "x.ov", "x.own"))
    return found.where(_LINKED).drop("own"), leads


def _settle(pairs: DataFrame, stars: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """The links (a, b) among ``pairs``, or links of their leaders that imply the same components."""
    best = stars.groupBy("b").agg(F.max(F.struct("ov", "a", "na", "nb")).alias("x"))
    best = (best.select(F.col("b").alias("set_id"), F.col("x.a").alias("lead"), (F.col("x.nb") - F.col("x.ov")).alias("out"), (F.col("x.na") - F.col("x.ov")).alias("miss")))
    size = sets.select("set_id", "n")
    zero = F.lit(0).cast("long")
    for c in ("a", "b"):
        side = size.join(best, "set_id", "left").select(
            F.col("set_id").alias(c), F.col("n").alias(f"n{c}"), F.coalesce("lead", "set_id").alias(f"l{c}"),
            F.coalesce("out", zero).alias(f"out{c}"), F.coalesce("miss", zero).alias(f"miss{c}"),
        )
        pairs = pairs.join(side, c)
    pairs = staged(pairs)
    heads = pairs.where("la != lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct()
    heads = overlaps(heads, docs, sets)
    linked = heads.where(_LINKED).select("a", "b")
    known = heads.where(f"not ({_LINKED})").select(F.col("a").alias("ha"), F.col("b").alias("hb"), F.col("ov").alias("hov"))
    left = pairs.join(known, (F.least("la", "lb") == F.col("ha")) & (F.greatest("la", "lb") == F.col("hb")))
    need = f"(({NUM} * (na + nb) + {NUM + DEN - 1}) div {NUM + DEN})"
    left = staged(left.selectExpr("a", "b", f"hov + outa + outb < {need} as no", f"hov - missa - missb >= {need} as yes"))
    derived = left.where("yes").select("a", "b")
    compared = overlaps(left.where("not no and not yes").select("a", "b"), docs, sets).where(_LINKED).select("a", "b")
    return linked.unionByName(derived).unionByName(compared)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, text_key, n_shingles, component_id (the smallest doc_id that links reach), root (the component's own key)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.xxhash64("text", F.octet_length("text")).alias("text_key"))
    texts = docs.where("doc_id is not null")
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    top = frequent_shingles(texts, _parts(texts, n_bytes // WORD_BYTES, GROUP)).orderBy(F.desc("df"), "token").limit(TOLD).toPandas().sort_values("token")
    frequent = spark.sparkContext.broadcast((top["token"].to_numpy(np.int64), top["df"].to_numpy(np.int64)))
    info = staged(describe(docs, frequent))
    first = F.min(F.struct("doc_id", "text_key"))
    sets = info.where("n > 0 and doc_id is not null").groupBy("set_id").agg(first.alias("d"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("shared").alias("shared"), *[F.first(b).alias(b) for b in BITMAP])
    sets = staged(sets.select("set_id", "d.doc_id", "d.text_key", "n", "keys", "shared", *BITMAP))

    stars, leads = _leaders(sets, texts)
    roots = staged(components(stars.select("a", "b")))

    entries = info.where("n > 0 and doc_id is not null").agg(F.sum(F.expr(f"n - ({NUM} * n + {DEN - 1}) div {DEN} + 1"))).first()[0] or 0
    lists = staged(index_lists(texts, frequent, _parts(texts, entries, GROUP_LISTS)))
    known = roots.select(F.col("node").alias("set_id"), F.col("root").alias("comp"))
    known = sets.select("set_id", "n", *BITMAP).join(known, "set_id", "left").withColumn("comp", F.coalesce("comp", "set_id"))
    known = known.join(leads.select("set_id", "lead", "ov"), "set_id", "left")
    known = staged(known.withColumn("lead", F.coalesce("lead", "set_id")).withColumn("ov", F.coalesce("ov", "n")))
    many = lists.groupBy("set_id").agg(F.count("*").alias("many"))
    pairs = candidate_pairs(lists.join(known.join(many, "set_id"), "set_id"))
    outside = outside_lists(leads, known).join(known.withColumn("many", F.col("n") - F.col("ov")).drop("n"), "set_id")
    outside = candidate_pairs(outside, answered=True)
    links = _settle(pairs.unionByName(outside), stars, texts, sets)

    # Join the components that the new links connect.
    root = roots.select(F.col("node"), "root")
    for c in ("a", "b"):
        links = links.join(root.withColumnRenamed("node", c), c, "left").withColumn(c, F.coalesce("root", c)).drop("root")
    upper = staged(components(links))
    roots = roots.join(upper.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    roots = roots.select(F.col("node").alias("set_id"), F.coalesce("top", "root").alias("root"))
    roots = roots.unionByName(upper.select(F.col("node").alias("set_id"), "root")).groupBy("set_id").agg(F.min("root").alias("root"))
    named = staged(sets.select("set_id", "doc_id").join(roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id")))
    least = (named.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    named = staged(named.join(least, "root").select("set_id", "component_id", "root"))
    out = info.join(named, "set_id", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), own).alias("component_id"), "root")


#: Rows without an id take part in ``one_per_group`` under numbers from here on, made of their texts.
UNNUMBERED = 1 << 62


def one_per_group(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: of the smallest id, rows without one last, ties by the text.

    Repeated rows are one group. Rows without words are linked with nothing, and all stay.
    """
    key = F.xxhash64(docs["text"], F.octet_length(docs["text"]))
    named = docs.withColumn("__k", key).withColumn("__d", F.coalesce(docs["doc_id"].cast("long"), F.lit(UNNUMBERED) + F.col("__k").bitwiseAND(F.lit(UNNUMBERED - 1))))
    found = near_duplicates(named.select(F.col("__d").alias("doc_id"), "text"))
    first = Window.partitionBy("root").orderBy("doc_id", "text_key")
    keep = found.where("n_shingles > 0 and doc_id = component_id").withColumn("rn", F.row_number().over(first)).where("rn = 1")
    keep = staged(keep.select(F.col("doc_id").alias("__d"), F.col("text_key").alias("__k")))
    rows = named.join(keep, ["__d", "__k"])
    # What is left of a row's copies has the same id and text; one of them stays.
    one = Window.partitionBy("__d", "__k").orderBy(F.xxhash64(*docs.columns))
    kept = rows.withColumn("__n", F.row_number().over(one)).where("__n = 1").select(*docs.columns)
    return kept.unionByName(docs.where(~F.coalesce(docs["text"], F.lit("")).rlike(r"[^\x20\x09-\x0D]")))
