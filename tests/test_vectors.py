import hashlib
import math
import re

import numpy as np
from pyspark.sql import functions as F

from tixspark.functions import vectors as V
from tixspark.operators import blocks
from tixspark.operators.topk import topk_similar
from tixspark.session import staged


def _py_embed(text, dim):
    vec = [0.0] * dim
    for tok in re.findall(r"[a-z0-9_./:-]+", text.lower()):
        d = hashlib.blake2b(tok.encode("utf-8"), digest_size=8).digest()
        vec[int.from_bytes(d[:4], "big") % dim] += 1.0 if d[4] & 1 else -1.0
    n = math.sqrt(sum(v * v for v in vec))
    return vec if n == 0 else [v / n for v in vec]


def test_lexical_embedding_matches_python(spark):
    texts = ["VPN timeout on gateway 10.0.0.1", "", "Payment API returns 503; retry /v1/pay", "ÉTÉ été 42"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    rows = {r.id: r.e for r in df.select("id", V.embed_text(F.col("t"), 64).alias("e")).collect()}
    for i, t in enumerate(texts):
        assert np.allclose(rows[i], _py_embed(t, 64), atol=1e-6)


def test_topk_blocked_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    q = [(i, rng.normal(size=8).tolist()) for i in range(37)]
    c = [(f"T{j:03d}", rng.normal(size=8).tolist(), j % 5) for j in range(53)]
    c.append(("T999", c[3][1], 9))  # exact tie with T003: the order column decides
    qdf = spark.createDataFrame(q, "query_id int, query_embedding array<double>")
    cdf = spark.createDataFrame(c, "ticket_id string, embedding array<double>, created_at int")
    got = topk_similar(qdf, cdf, k=4, block_rows=10).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.ticket_id))
    for qi, qv in q:
        sims = []
        for tid, cv, ca in c:
            s = float(np.dot(qv, cv) / (np.linalg.norm(qv) * np.linalg.norm(cv)))
            sims.append((-(s >= 0.95), -s, ca, tid))
        want = [t[3] for t in sorted(sims)[:4]]
        assert [t for _, t in sorted(by[qi])] == want


def test_topk_over_blocks_in_many_partitions(spark):
    rng = np.random.default_rng(11)
    vectors = rng.normal(size=(90, 12))
    vectors[40:70] = vectors[7]  # more copies than k in several blocks: the order column decides
    rows = [(f"T{i:03d}", v.tolist(), (i * 37) % 5) for i, v in enumerate(vectors)]
    rows += [("none", None, 0), ("zero", [0.0] * 12, 1), ("short", [1.0], 0), ("nan", [float("nan")] * 12, 2)]
    df = spark.createDataFrame(rows, "ticket_id string, embedding array<double>, created_at int")
    q = df.select(F.col("ticket_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows if v and np.isfinite(v).all() and any(v)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for exclude in (False, True):
            got = {}
            for r in topk_similar(q, df, k=4, block_rows=7, exclude_self=exclude).collect():
                got.setdefault(r.query_id, {})[r.rank] = r.ticket_id
            for qid, _, _ in rows:
                near = lambda i: float((unit[qid] * unit[i]).sum()) if qid in unit and i in unit and len(unit[i]) == len(unit[qid]) else None
                keys = [(-round(n, 10) if (n := near(i)) is not None else 9, at, i) for i, _, at in rows if not (exclude and i == qid)]
                assert [got[qid][r] for r in (1, 2, 3, 4)] == [k[2] for k in sorted(keys)[:4]], (qid, exclude)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_query_blocks_are_dealt_to_parts_of_bounded_size(spark, monkeypatch):
    """All blocks of a file were one task's, held as a whole: its memory grew with the table."""
    monkeypatch.setattr(blocks, "PART", 20)
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(90, 12)))]
    df = spark.createDataFrame(rows, "qid int, v array<double>")
    q = staged(blocks.pack(df.coalesce(1), "v", (), 8))
    dealt, n = blocks._dealt(q)
    held = [r.n for r in dealt.groupBy(F.spark_partition_id()).agg(F.sum("n").alias("n")).collect()]
    assert sum(held) == 90 and max(held) <= 20 and n == len(held)
    c = staged(blocks.pack(df.withColumnRenamed("qid", "id"), "v", ("id",), 8, copies=4, cells=True))
    got = {}
    for r in blocks.scan(q, c, 3, "qid", ("id",), exclude_self=True).collect():
        got.setdefault(r.qid, []).append((-r.similarity, r.id))
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    for i in range(90):
        s = x @ x[i]
        s[i] = -2
        assert [j for _, j in sorted(got[i])[:3]] == np.argsort(-s)[:3].tolist()


def test_cells_leave_out_rows_but_none_that_is_near(spark):
    rng = np.random.default_rng(9)
    middle = rng.normal(size=(12, 40)) * 3
    x = middle[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 40)) * rng.choice([0.05, 1.0], (1500, 1))
    x[100:140] = x[7]
    x[200] = 1e-30
    unit = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    cells = blocks._Cells(blocks._Cells.made(x), 40)
    assert sorted(cells.rows.tolist()) == list(range(1500))
    s = unit.astype(np.float64) @ unit.T.astype(np.float64)
    near = cells.wanted(unit, np.sort(s, 1)[:, -5])
    cell = np.repeat(np.arange(near.shape[1]), np.diff(cells.begin))
    kept = near[:, cell]
    assert kept[s[:, cells.rows] >= np.sort(s, 1)[:, [-5]]].all() and kept.mean() < 0.5
    ids = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(ids, "query_id int, query_embedding array<double>")
    c = df.select(F.col("query_id").alias("ticket_id"), F.col("query_embedding").alias("embedding"), F.lit(0).alias("created_at"))
    got = {}
    for r in topk_similar(df.where("query_id % 10 = 7"), c.repartition(1), k=5, block_rows=500, fast_threshold=2.0).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.ticket_id
    x = x / np.linalg.norm(x, axis=1)[:, None]
    for i in range(7, 1500, 10):
        n = (x[i] * x).sum(1).round(12)
        assert [got[i][r] for r in (1, 2, 3, 4, 5)] == np.lexsort((np.arange(1500), -n))[:5].tolist()


def test_embeddings_of_more_texts_than_are_held_at_once(spark):
    texts = [None, "", "É a-b a-b", "..."] + [f"word{i % 90} alarm {i} alarm" for i in range(1300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").coalesce(1)
    rows = {r.id: r for r in df.select("id", V.embed_text(F.col("t"), 16).alias("e"), V.embed_text_md5(F.col("t"), 16).alias("m")).collect()}
    for i, t in enumerate(texts):
        assert np.allclose(rows[i].e, _py_embed(t or "", 16), atol=1e-6)
        vec = [0.0] * 16
        for tok in re.findall(r"[a-z0-9_./:-]+", (t or "").lower()):
            h = hashlib.md5(tok.encode()).digest()
            vec[int.from_bytes(h[:4], "big") % 16] += 1.0 if h[4] & 1 else -1.0
        assert np.allclose(rows[i].m, np.array(vec) / (np.linalg.norm(vec) or 1), atol=1e-12)
