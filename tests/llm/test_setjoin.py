import random

import numpy as np
from .helpers import DOCS, awkward, split5, with_clashes, words

from tixspark.llm import setjoin
from tixspark.llm.common import table
from tixspark.llm.components import components
from tixspark.llm.shingles import shingle_sets


def grams(text):
    w = split5(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """Sizes and smallest linked ids by comparing all texts."""
    sets = [(r.doc_id, grams(r.text)) for r in rows]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (a, x) in enumerate(sets):
        for j, (b, y) in enumerate(sets[:i]):
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(x), None if d is None else least[find(i)]) for i, (d, x) in enumerate(sets)), key=repr)


def got(docs):
    rows = setjoin.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()
    return sorted(map(tuple, rows), key=repr)


def test_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    assert got(docs) == brute(docs.select("doc_id", "text").collect())


def test_near_copies_around_the_threshold(spark):
    rng, rows = random.Random(3), []
    for _ in range(12):
        base = words(rng, rng.randint(20, 150), 60).split()
        for _ in range(14):
            w = list(base)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
            rows.append((len(rows), " ".join(w).upper() if rng.random() < 0.3 else "\n ".join(w), "en", "s", 0))
    docs = spark.createDataFrame(rows, DOCS)
    want = brute(docs.collect())
    assert got(docs) == want
    assert 12 < len({c for _, _, c in want}) < len(rows)
    # The same with every shingle counted as frequent, so that prefixes are in order of frequency.
    before = setjoin.HEAVY
    try:
        setjoin.HEAVY = 2
        assert got(docs) == want
    finally:
        setjoin.HEAVY = before


def edited(rng, base, edits, mark):
    w = list(base)
    for at in rng.sample(range(len(w)), edits):
        w[at] = f"{mark}{rng.randrange(10**6)}"
    return w


def test_copies_below_the_threshold_are_not_listed_in_pairs(spark, monkeypatch):
    """Their leader's answers rule the pairs out; what copies of copies have in common outside the leader still links."""
    listed, count = [], setjoin.listed_pairs
    monkeypatch.setattr(setjoin, "listed_pairs", lambda lists, answered=False: listed.append(count(lists, answered)) or listed[-1])
    made = {}
    for copies in (60, 240):
        rng = random.Random(8)
        base = [f"w{i}" for i in range(300)]
        near = [edited(rng, base, rng.randint(1, 3), "a") for _ in range(copies)]
        below = [edited(rng, base, rng.randint(7, 9), "b") for _ in range(copies // 2)]
        again = [edited(rng, w, rng.randint(1, 6), "c") for w in below[::10]] + [edited(rng, w, 6, "d") for w in near[::10]]
        rows = [(i, " ".join(w), "en", "s", 0) for i, w in enumerate([base, *near, *below, *again])]
        docs = spark.createDataFrame(rows, DOCS)
        assert got(docs) == brute(docs.collect())
        made[copies] = sum(f.count() for f in listed)
        listed.clear()
    assert made[60] < 100 and made[240] < 400  # 14,673 and 255,899 without the leader's answers


def test_pairs_that_a_leader_answers_are_left_to_what_is_outside():
    rng = np.random.default_rng(1)
    token, n = np.sort(rng.integers(0, 9, 200)), rng.integers(20, 30, 200)
    order = np.lexsort((n, token))
    token, n, comp, lead = token[order], n[order], rng.integers(0, 50, 200), rng.integers(0, 3, 200)
    ov, pos, bits, many = rng.integers(15, 30, 200), np.zeros(200, np.int64), np.zeros((200, 4), np.uint64), np.full(200, 99)
    pairs = lambda short, **more: sorted(zip(*(x.tolist() for x in setjoin.list_pairs(token, n, pos, comp, bits, short, **more)), strict=True))
    for short in (1, 100):
        both = [pairs(short, told=(lead, ov, many), answered=answered) for answered in (False, True)]
        assert sorted(both[0] + both[1]) == pairs(short) and all(both)
        assert all(lead[i] == lead[j] and min(ov[i], ov[j]) < setjoin.needed(n[i], n[j]) for i, j in both[1])
        assert not any(lead[i] == lead[j] and min(ov[i], ov[j]) < setjoin.needed(n[i], n[j]) for i, j in both[0])
        few = pairs(short, told=(np.arange(200), n, np.full(200, 3)))
        assert few == [(i, j) for i, j in pairs(short) if 3 + -(-4 * max(n[i], n[j]) // 5) - 1 >= setjoin.needed(n[i], n[j])] != pairs(short)


def test_awkward_rows(spark):
    docs = with_clashes(spark.createDataFrame(awkward(), DOCS))
    assert got(docs) == brute(docs.collect())
    assert got(docs.limit(0)) == []
    kept = setjoin.one_per_group(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {1, 2, 3, 4, 6, 8, 9, None}


def test_one_row_of_a_group_stays(spark):
    """Repeated rows, rows of one id with near texts, rows without an id: one row a component; what has no words stays."""
    base = [f"w{i}" for i in range(60)]
    text, near, far = " ".join(base), " ".join([*base[:-1], "x"]), " ".join(f"v{i}" for i in range(30))
    rows = [(1, text), (1, text), (None, text), (None, text), (2, text), (1, near), (None, near), (3, far), (3, far + " y z"), (None, "only here and nowhere else at all"),
            (None, "only here and nowhere else at all"), (7, "other words"), (7, "of the same id"), (8, None), (8, None), (None, " ")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    kept = sorted(((r.doc_id, r.text) for r in setjoin.one_per_group(docs).collect()), key=repr)
    assert len(kept) == 8 and kept.count((8, None)) == 2
    assert [k for k in kept if k[0] == 1 and k[1] in (text, near)] and len([k for k in kept if k[0] in (1, 2)]) == 1
    assert len([k for k in kept if k[0] == 3]) == 1 and len([k for k in kept if k[0] == 7]) == 2
    assert sorted(k[1] for k in kept if k[0] is None) == [" ", "only here and nowhere else at all"]


def test_positional_skipping_keeps_all_pairs():
    rng = np.random.default_rng(0)
    for short in (1, 4, 100):
        token, n = np.sort(rng.integers(0, 12, 300)), rng.integers(5, 40, 300)
        pos = np.array([rng.integers(0, setjoin._prefix(int(x))) for x in n])
        order = np.lexsort((pos, n, token))
        token, n, pos, comp = token[order], n[order], pos[order], rng.integers(0, 40, 300)
        bits = np.zeros((300, 4), np.uint64)
        bits[:7] = np.uint64(0xFFFFFFFF)  # 128 places apart from the others
        seen = list(zip(*setjoin.list_pairs(token, n, pos, comp, bits, short), strict=True))
        want = {
            (i, j) for i in range(300) for j in range(i)
            if token[i] == token[j] and comp[i] != comp[j] and (i < 7) == (j < 7) and 5 * n[j] >= 4 * n[i]
            and min(pos[i], pos[j]) + 1 + min(n[i] - pos[i], n[j] - pos[j]) - 1 >= setjoin.needed(int(n[i]), int(n[j]))
        }
        assert len(seen) == len(set(seen)) and want == {(int(i), int(j)) for i, j in seen}


def test_shingles_of_long_and_odd_texts(monkeypatch):
    from tixspark.llm import shingles

    rng = random.Random(9)
    texts = [words(rng, 3000), None, "", "a", "a b c d e", "A  B\tc\nd e ", "é É x", words(rng, 10)]
    one = [s.tolist() for s in shingle_sets(texts)]
    monkeypatch.setattr(shingles, "PIECE", 256)
    assert one == [s.tolist() for s in shingle_sets(texts)]
    assert one[4] == one[5] and one[1] == one[2] == [] and len(one[3]) == 1
    assert len(one[0]) == len(grams(texts[0]))


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(200, 260)] + [(rng.randrange(100), rng.randrange(100)) for _ in range(60)] + [(500, i) for i in range(501, 560)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in found} == want and len(found) == len(want)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_entries_of_prefixes_are_dealt_evenly_and_groups_do_not_grow(spark, monkeypatch):
    """Prefixes are the low hashes of sets; a part must not get more of them for that. Copies in a task are sent once."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"v{rng.randrange(10**6)}" for _ in range(200)), "en", "s", 0) for i in range(400)]
    docs = spark.createDataFrame(rows + [(i + 400, *r[1:]) for i, r in enumerate(rows)], DOCS).coalesce(1)
    none = spark.sparkContext.broadcast((np.zeros(0, np.int64), np.zeros(0, np.int64)))
    packed = setjoin.packed_prefixes(docs, none, 64)
    assert all(len(r["data"]) == 17 * r["n"] for r in packed.collect())  # 24 with whole hashes and sizes
    dealt = [r["sum(n)"] for r in packed.groupBy("part").sum("n").collect()]
    assert len(dealt) == 64 and sum(dealt) == 400 * setjoin._prefix(196)
    assert max(dealt) < 1.5 * sum(dealt) / 64  # 4.7 times the mean when dealt by the hash that orders prefixes
    for group in (setjoin.GROUP, setjoin.GROUP_LISTS):
        parts = [setjoin._parts(docs, entries, group) for entries in (0, 1000 * group, 2000 * group)]
        assert parts == [64, 1000, 2000]
    want = got(docs)
    monkeypatch.setattr(setjoin, "GROUP", 50)
    monkeypatch.setattr(setjoin, "GROUP_LISTS", 50)
    monkeypatch.setattr(setjoin, "FLUSH_LISTS", 500)
    assert got(docs) == want and all(c == d % 400 for d, _, c in want)
