import datetime as dt

import pytest
from pyspark.sql import functions as F

from tixspark.operators.rollup import Rollup, average
from tixspark.operators.textindex import TextIndex, grams_of
from tixspark.plans.search import search_tickets
from tixspark.sources import fixtures
from tixspark.sources.store import FactStore, LatestSnapshot, delete

from conftest import SF001

DAY = dt.datetime(2024, 1, 1)
VERSIONS = "ticket_id string, event_id long, route string, score double, created_at timestamp_ntz"


def version(ticket, event, route, hour, score=0.5):
    return ticket, event, route, score, DAY + dt.timedelta(hours=hour)


@pytest.fixture(scope="module")
def facts(spark, tmp_path_factory):
    store = FactStore(spark, str(tmp_path_factory.mktemp("store")), buckets=4)
    store.append("tickets", fixtures.tickets(spark, SF001), 0)
    store.append("decisions", fixtures.routing_decisions(spark, SF001), 0)
    return store


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange" in line and "BroadcastExchange" not in line]


def test_search_over_stored_tables_exchanges_no_fact(spark, facts):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = search_tickets(facts.read("tickets"), facts.read("decisions"))
        assert exchanges(found) == []
        plain = search_tickets(fixtures.tickets(spark, SF001), fixtures.routing_decisions(spark, SF001))
        assert len(exchanges(plain)) == 2
        assert found.collect() == plain.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_point_lookup_reads_one_bucket(spark, facts):
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        one = facts.read("decisions").where("ticket_id = 'DOC-000007'")
        plan = one._jdf.queryExecution().explainString(one._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        assert "EqualTo(ticket_id,DOC-000007)" in plan and "SelectedBucketsCount: 1 out of 4" in plan
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


def test_batches_once_replayed_torn_and_after_a_restart(spark, tmp_path):
    root = str(tmp_path / "s")
    store = FactStore(spark, root, buckets=2)
    first = spark.createDataFrame([version("a", 1, "x", 1), version("b", 2, "y", 2)], VERSIONS)
    assert store.append("d", first, 0) and not store.append("d", first, 0)
    later = spark.createDataFrame([version("a", 3, "z", 3)], VERSIONS)
    assert store.append("d", later, 2) and not store.append("d", later, 1)  # an older batch adds nothing
    assert store.read("d").count() == 3 and store.read("d", 0).count() == 1
    # A run is lost after it wrote a batch and before the ledger: readers don't see it, and the next run replaces it.
    delete(spark, f"{root}/d.ledger")
    store = FactStore(spark, root)
    assert store.last_batch("d") == -1 and store.read("d").count() == 0
    assert store.append("d", first, 0) and store.append("d", later, 1)
    assert store.read("d").count() == 3
    # Another session opens the folder and takes buckets and columns from it.
    spark.sql(f"drop table {store.name_of('d')}")
    again = FactStore(spark, root, buckets=7)
    assert sorted(r.event_id for r in again.read("d").collect()) == [1, 2, 3] and again.spec("d")["buckets"] == 2
    with pytest.raises(KeyError):
        again.read("none")


def test_snapshot_with_late_tied_and_replayed_versions(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "s"), buckets=2)
    snap = LatestSnapshot(store, "d", ("created_at", "event_id"), ("route",))
    with pytest.raises(ValueError):
        snap.read()
    batches = [
        [version("a", 1, "a1", 5), version("b", 2, "b2", 5), version("c", 3, "c3", 1), version("c", 4, "c4", 2)],
        [version("a", 9, "late", 1), version("b", 8, "b8", 5), version("d", 5, "d5", 1)],  # older; tied with a greater id; new
        [version("b", 6, "tied", 5), version("c", 7, "c7", 9), (None, 11, "none", 0.5, None)],  # tied with a smaller id; newer; no key
    ]
    for i, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, VERSIONS)
        assert store.append("d", frame, i) and snap.advance() and not snap.advance()
        assert not store.append("d", frame, i) and not snap.advance()
    got = {r.ticket_id: r.route for r in snap.read().collect()}
    assert got == {"a": "a1", "b": "b8", "c": "c7", "d": "d5", None: "none"}
    assert snap.mark() == (2, 2)
    snap.forget(keep=1)
    assert snap.read().count() == 5 and not store.has("d.latest/v0")


def test_snapshot_reads_new_batches_only(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "s"), buckets=2)
    for i in range(3):
        store.append("d", spark.createDataFrame([version(f"t{i}", i, "x", i)], VERSIONS), i)
    files = store.read("d", 1).inputFiles()
    assert files and all("batch_id=2" in f for f in files)


def test_states_merge_over_batches_and_days(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "s"), buckets=2)
    roll = Rollup(store, "d", ("route",), {"good": F.col("score") > 0.5}, {"score": F.col("score")}, {"last": F.col("event_id")})
    rows = [version("a", 1, "x", 1, 0.1), version("a", 2, "x", 30, 0.2), version("b", 3, "y", 2, 0.9), version("b", 4, "x", 3, None)]
    store.append("d", spark.createDataFrame(rows, VERSIONS), 0)
    assert roll.advance() and not roll.advance()
    store.append("d", spark.createDataFrame([version("c", 7, "x", 1, 0.7)], VERSIONS), 1)
    store.append("d", spark.createDataFrame([], VERSIONS), 2)
    assert roll.advance()
    total = roll.merged().first()
    assert (total.n, total.good, float(total.score), total["last"]) == (5, 2, 1.9, 7)
    assert {(r.route, r.n) for r in roll.merged("route").collect()} == {("x", 4), ("y", 1)}
    assert roll.merged(since="2024-01-02").first().n == 1
    assert roll.merged("day").count() == 2
    # Nothing but the states is read.
    assert all(".states" in f for f in roll.merged().inputFiles())
    assert roll.merged().select(average("score").alias("a")).first().a == pytest.approx(0.38)


def test_text_index(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "s"), buckets=2)
    index = TextIndex(store, "t", ("number", "body"))
    rows = [("a", "N1", "The quick brown fox"), ("b", "N2", None), ("c", "quick", "x"), ("d", "N4", "qui ick ck b"), ("e", "N5", "É\nÉÉ 😀😀😀"), ("f", None, "")]
    store.append("t", spark.createDataFrame(rows, "ticket_id string, number string, body string"), 0)
    assert index.advance() and not index.advance()
    store.append("t", spark.createDataFrame([("g", "N7", "QUICK again")], "ticket_id string, number string, body string"), 1)
    assert index.advance()
    assert {r.batch_id: r["count"] for r in store.read("t.grams").where("ticket_id = 'g'").groupBy("batch_id").count().collect()} == {1: len(grams_of("quick again"))}

    def ids(q):
        found = index.candidates(q)
        return None if found is None else sorted(r.ticket_id for r in found.collect())

    assert ids("QUICK") == ["a", "c", "g"]
    assert ids("quick b") == ["a"]
    assert ids("é\né") == ["e"] and ids("😀😀😀") == ["e"]
    assert ids("zzz") == [] and ids("qu") is None
    few = index.restrict(store.read("t"), "brown")
    assert [r.ticket_id for r in few.collect()] == ["a"]
    assert "EqualTo(ticket_id,a)" in few._jdf.queryExecution().executedPlan().toString() or "In(ticket_id" in few._jdf.queryExecution().executedPlan().toString()
    assert index.restrict(store.read("t"), "q").count() == 7


def brute_topk(queries, corpus, k, exclude_self):
    """The reference's order: fast flag, similarity (none last), order column, id."""
    import numpy as np

    def near(a, b):
        if a is None or b is None or len(a) != len(b) or not len(a) or not any(a) or not any(b):
            return None
        x, y = np.array(a), np.array(b)
        return float((x * y).sum() / (np.linalg.norm(x) * np.linalg.norm(y)))

    out = []
    for qid, q in queries:
        rows = [(near(q, v), at, i) for i, v, at in corpus if not (exclude_self and i == qid)]
        rows.sort(key=lambda r: (-((r[0] if r[0] is not None else -9) >= 0.95), r[0] is None, -round(r[0], 12) if r[0] is not None else 0, r[1], r[2]))
        out += [(qid, n + 1, i) for n, (_, _, i) in enumerate(rows[:k])]
    return sorted(out)


def test_metric_index_is_exact_and_reads_few_cells(spark, tmp_path):
    import numpy as np

    from tixspark.operators.metricindex import MetricIndex

    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    corpus = [(f"v{i:04d}", (centres[i % 12] + 0.05 * rng.normal(size=16)).tolist(), i % 7) for i in range(600)]
    corpus += [("dup1", corpus[3][1], 0), ("dup2", corpus[3][1], 0), ("zero", [0.0] * 16, 1), ("none", None, 2), ("empty", [], 3), ("short", [1.0, 2.0], 4), ("short2", [2.0, 1.0], 4)]
    schema = "id string, vec array<double>, at int"
    store = FactStore(spark, str(tmp_path / "s"), buckets=4)
    index = MetricIndex(store, "v", "id", "vec", ("at",), rows=40)
    store.append("v", spark.createDataFrame(corpus[:400], schema), 0, "id")
    assert index.advance() and not index.advance()
    store.append("v", spark.createDataFrame(corpus[400:], schema), 1, "id")
    assert index.advance()
    queries = [(i, v) for i, v, _ in corpus[:40] + corpus[-8:]]
    frame = spark.createDataFrame(queries, "q string, qv array<double>")
    for exclude in (False, True):
        rows = index.nearest(frame, 4, "q", "qv", exclude_self=exclude).collect()
        assert sorted((r.q, r["rank"], r.id) for r in rows) == brute_topk(queries, corpus, 4, exclude)
    cells = store.read("v.spheres").select("cell").distinct().count()
    read = [r.cells_read for r in rows if r.q.startswith("v0")]
    assert max(read) < cells / 2


def test_metric_index_copies_no_vectors_for_its_second_round(spark, tmp_path, monkeypatch):
    import numpy as np

    from tixspark.operators.metricindex import FIRST, MetricIndex

    rng = np.random.default_rng(6)
    corpus = [(f"v{i:04d}", rng.normal(size=24).tolist(), i % 7) for i in range(300)]  # no clusters: nearly all cells are read
    store = FactStore(spark, str(tmp_path / "s"), buckets=4)
    store.append("v", spark.createDataFrame(corpus, "id string, vec array<double>, at int"), 0, "id")
    index = MetricIndex(store, "v", "id", "vec", ("at",), rows=10)
    index.advance()
    asked, meet = [], MetricIndex._meet
    monkeypatch.setattr(MetricIndex, "_meet", lambda self, visits, *a: asked.append(visits.count()) or meet(self, visits, *a))
    queries = [(i, v) for i, v, _ in corpus[:50]]
    rows = index.nearest(spark.createDataFrame(queries, "q string, qv array<double>"), 4, "q", "qv", exclude_self=True).collect()
    assert sorted((r.q, r["rank"], r.id) for r in rows) == brute_topk(queries, corpus, 4, True)
    assert min(r.cells_read for r in rows) > FIRST and sum(asked) <= FIRST * len(queries)
