import hashlib
import math
import random

import numpy as np

from tixspark.llm import covercodes
from tixspark.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows):
    """The contract's rule, one vector after the other."""
    by_dim = {}
    for i, x, label in rows:
        if x is not None and all(v is not None and math.isfinite(v) for v in x):
            q = [max(-(2**26), min(2**26, math.floor(256 * float(np.float32(v))))) for v in x]
            by_dim.setdefault(len(x), []).append((i is None, i if i is not None else 0, [float(np.float32(v)) for v in x], q, label))
    out = []
    for d, vs in by_dim.items():
        vs.sort(key=lambda v: v[:3])
        cuts = [(p * d // 16, (p + 1) * d // 16) for p in range(16)]
        books = [[v[3][a:b] for v in vs[:64]] for a, b in cuts]

        def near(part, book):
            ds = [sum((x - y) ** 2 for x, y in zip(part, e)) for e in book]
            return ds.index(min(ds)), min(ds)

        for _ in range(2):
            for p, (a, b) in enumerate(cuts):
                got = [[] for _ in books[p]]
                for v in vs:
                    got[near(v[3][a:b], books[p])[0]].append(v[3][a:b])
                books[p] = [[sum(c) // len(g) for c in zip(*g)] if g else e for g, e in zip(got, books[p])]
        sha = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
        for null, i, _, q, label in vs:
            best = [near(q[a:b], books[p]) for p, (a, b) in enumerate(cuts)]
            out.append((None if null else i, "".join(f"{e:02x}" for e, _ in best), sum(s for _, s in best), label, sha))
    labels = {}
    for *_, error, label, _ in out:
        labels[label] = labels.get(label, 0) + error
    return sorted(((i, code, error, labels[label], sha) for i, code, error, label, sha in out), key=repr)


def got(frame):
    out = covercodes.codes_digest(frame)
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted(map(tuple, out.collect()), key=repr)


def test_embeddings(spark):
    t = table(spark, "/root/testdata/sf0.001", "embeddings")
    assert got(t) == plain([tuple(r) for r in t.select("vec_id", "embedding", "label").collect()])


def test_odd_rows(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(32)], rng.choice([None, 1, 2])) for i in range(150)]
    rows += [(i % 7, [round(rng.gauss(0, 0.01), 2) for _ in range(32)], 3) for i in range(60)]  # ties, repeated ids and vectors
    rows += [(None, [0.0] * 32, 1), (None, [0.5] * 32, None), (3, None, 1), (4, [], 1), (5, [], None), (6, [1.0, None], 1), (7, [float("nan")] * 32, 1),
             (8, [float("inf")] * 32, 1), (9, [1e30] * 32, 1), (10, [-1e30] * 31 + [1.0], 2), (11, [1.0] * 20, 2), (12, [2.0] * 20, 2), (13, [-0.001], None)]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as dim", "'x' as k", "'x' as entries", "'x' as rows", "'x' as code", "'x' as error")
    want = plain(rows)
    assert got(frame) == want
    monkeypatch.setattr(covercodes, "BLOCK_BYTES", 2000)  # many blocks
    assert got(frame.repartition(3)) == want
    assert got(spark.createDataFrame([], SCHEMA)) == []


def test_cover_tree():
    """Nodes hold what their radius says; whole nodes and single points give the nearest entry of every point, few points singly."""
    rng = np.random.default_rng(3)
    centres = rng.integers(-2000, 2000, (30, 4))
    points = np.concatenate([centres[rng.integers(0, 30, 3000)] + rng.integers(-20, 20, (3000, 4)), np.repeat(centres[:1], 200, 0)])
    tree = covercodes.CoverTree(points)
    assert sorted(tree.order.tolist()) == list(range(len(points)))
    for lo, hi, radius, first, many in tree.nodes.tolist():
        d = ((tree.points[lo:hi] - tree.points[lo]) ** 2).sum(1)
        assert d.max() == radius
        if many:
            kids = tree.nodes[first : first + many]
            assert kids[0][0] == lo and kids[-1][1] == hi and (kids[1:, 0] == kids[:-1, 1]).all()
        else:
            assert radius == 0 or hi - lo <= covercodes.LEAF
    for entries in (centres, points[:64], np.repeat(points[:3], 2, 0)):
        lo, hi, whole, at, one = tree.assign(entries)
        place = np.full(len(points), -1)
        for a, b, e in zip(lo, hi, whole):
            assert (place[a:b] == -1).all()
            place[a:b] = e
        place[at] = one
        want = ((tree.points[:, None, :] - entries[None]) ** 2).sum(2).argmin(1)
        assert (place == want).all()
        if entries is centres:
            assert len(at) + len(lo) < len(points) // 4
