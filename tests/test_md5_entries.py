import hashlib
import math

from tixspark.functions import vectors as V


def brute(rows, dim):
    sums = {}
    for i, text in rows:
        if i is not None:
            for t in (text or "").split():
                h = hashlib.md5(t.encode()).digest()
                at = i, int.from_bytes(h[:4], "big") % dim
                sums[at] = sums.get(at, 0) + (1 if h[4] & 1 else -1)
    norm = {}
    for (i, _), v in sums.items():
        norm[i] = norm.get(i, 0) + v * v
    return {at: v / math.sqrt(norm[at[0]]) for at, v in sums.items() if v}


def test_a_task_holds_a_bounded_number_of_documents(spark, monkeypatch):
    monkeypatch.setattr(V, "DEALT", 16)
    rows = [(i % 390, " ".join(f"w{i * k % 57}" for k in range(i % 40))) for i in range(400)] + [(None, "lost words"), (7, None), (1000, "")]
    frame = spark.createDataFrame(rows, "d long, body string").coalesce(1)
    out = V.md5_embedding_entries(frame, "d", "body", 32)
    got = {(r.d, r.idx): r.value for r in out.collect()}
    expected = brute(rows, 32)
    assert set(got) == set(expected) and all(abs(got[k] - expected[k]) < 1e-12 for k in got)
    # As many tasks as the documents need, and the texts are dealt once: sums and norms need no exchange of their own.
    assert out.rdd.getNumPartitions() >= 403 // 16
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange") == 1
