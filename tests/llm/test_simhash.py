import random

import numpy as np
import xxhash
from .helpers import DOCS, awkward, split5, with_clashes, words

from tixspark.llm import simhash
from tixspark.llm.common import table


def fingerprint(text):
    w = [x.encode() for x in split5(text)]
    grams = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_reached(ids, fps):
    fp, parent = np.array(fps, np.uint64), list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fp[:i] ^ fp[i]) <= 4).tolist():
            if ids[i] is not None and ids[j] is not None:
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [None if d is None else least[find(i)] for i, d in enumerate(ids)]


def check(docs, **more):
    rows = docs.select("doc_id", "text").collect()
    fps = [fingerprint(r.text) for r in rows]
    want = sorted(zip([r.doc_id for r in rows], [f"{f:016x}" for f in fps], least_reached([r.doc_id for r in rows], fps)), key=repr)
    got = simhash.near_duplicates(docs, **more)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect()), key=repr) == want
    return want


def test_documents(spark):
    check(table(spark, "/root/testdata/sf0.001", "documents"))


def test_odd_rows_and_clashes(spark):
    check(with_clashes(spark.createDataFrame(awkward(), DOCS)))
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def test_near_copies(spark):
    rng, rows = random.Random(7), []
    for _ in range(6):
        base = words(rng, 300).split()
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
            rows.append((len(rows) + 10, " \n".join(w).upper() if rng.random() < 0.3 else " ".join(w), "en", "s", 0))
    docs = spark.createDataFrame(rows, DOCS)
    assert 6 <= len({c for _, _, c in check(docs)}) < len(rows)
    check(docs, node=3)  # all large node pairs take their first steps as joins


def test_cut_texts_have_whole_shingles():
    rng = random.Random(1)
    text = words(rng, 150_000, 9_000)
    assert simhash.simhash(text.encode()) == fingerprint(text)


def near_set(rng, n):
    """Random fingerprints, chains of near ones, and a dense ball, in tangled order."""
    base = [int(x) for x in rng.integers(0, 1 << 63, n // 4, dtype=np.uint64)]
    out = list(base)
    for x in base[: n // 8]:
        for _ in range(3):
            x ^= sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False))
            out.append(x)
    while len(out) < n:
        out.append(base[0] ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 4), replace=False)))
    return sorted(set(out))


def components_of(fps, links):
    at, label = {f: i for i, f in enumerate(fps)}, list(range(len(fps)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in links:
        a, b = a & (2**64 - 1), b & (2**64 - 1)
        assert (a ^ b).bit_count() <= 4
        label[find(at[a])] = find(at[b])
    return [find(i) for i in range(len(fps))]


def test_trie_links(spark):
    fps = near_set(np.random.default_rng(4), 3000)
    ids = list(range(len(fps)))
    want = least_reached(ids, fps)
    frame = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    for node in (simhash.NODE, 40):
        links = simhash.trie_links(frame, node).collect()
        root = components_of(fps, [(r.a, r.b) for r in links])
        least = {}
        for i, r in enumerate(root):
            least.setdefault(r, i)
        assert [least[r] for r in root] == want


def test_a_dense_group_sends_a_forest_only():
    """All of a group of near copies link with each other; the links sent grow with its size, not its square."""
    far = [a ^ b ^ c for a in (0, 1, 2, 4) for b in (1 << k for k in range(20, 60)) for c in (1 << k for k in range(30, 64))]
    key = np.unique(np.array(far, np.uint64))
    join = simhash._Join(key)
    zero = np.zeros(1, np.int64)
    join.walk(0, zero, zero + len(key), zero, zero + len(key), zero)
    assert 1000 < len(key) and len(join.links) < len(key)
    assert len(set(join.label.tolist())) == len(set(least_reached(list(range(len(key))), key.tolist())))
