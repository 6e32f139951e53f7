"""Queries over stored, bucketed fact tables, their snapshots, states and text index.

The fixture facts are stored in a few batches below the shared checkpoint folder, once per session and input folder; every
query asks for what it needs, and batches that are stored already add nothing.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import pyround
from ..operators.metricindex import MetricIndex
from ..operators.rollup import Rollup, average
from ..operators.textindex import TextIndex
from ..session import checkpoint_dir
from ..sources import fixtures
from ..sources.fixtures import with_views
from ..settings import FIXTURE
from ..sources.store import KEY, FactStore, LatestSnapshot
from ..sources.tables import read_table
from .common import r1, r4, safe_ratio
from .detail import _STATUS_SQL, routing_status
from .registry import ORACLES, register
from .routing import evidence_rows
from .search import _search_sql, search_tickets
from .vectors import approved_knowledge

_STORES: dict[tuple[str, str], FactStore] = {}


def fixture_store(spark: SparkSession, sf_dir: str, *tables: str) -> FactStore:
    """The store of ``sf_dir`` with ``tables`` (of tickets, decisions, reviews, audit, vectors, knowledge) filled."""
    app = spark.sparkContext.applicationId
    if (app, sf_dir) not in _STORES:
        root = f"{checkpoint_dir(spark).rstrip('/')}/{app}/store-{hashlib.sha256(sf_dir.encode()).hexdigest()[:12]}"
        _STORES[app, sf_dir] = FactStore(spark, root)
    store = _STORES[app, sf_dir]
    for name in tables:
        key = "neighbor_id" if name == "vectors" else KEY
        for batch_id, rows in enumerate(_batches(spark, sf_dir, name)):
            store.append(name, rows, batch_id, key, same=("description", "sanitized_text") if name == "tickets" else None)
    return store


def _batches(spark: SparkSession, sf_dir: str, name: str) -> list[DataFrame]:
    """The batches in which a fact table arrives. Batches of decisions hold times of all kinds, so versions arrive late."""
    if name == "tickets":
        rows, by, n = fixtures.tickets(spark, sf_dir), "ticket_id", 2
    elif name == "decisions":
        rows, by, n = fixtures.routing_decisions(spark, sf_dir), "event_id", 3
    elif name == "vectors":
        rows, by, n = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("neighbor_id"), "embedding"), "neighbor_id", 2
    elif name == "knowledge":
        t = approved_knowledge(fixtures.tickets_with_embedding(spark, sf_dir), FIXTURE)
        rows = t.select("ticket_id", "embedding", "created_at", "category", "assignment_group", "resolution", "source")
        return [rows]
    elif name == "reviews":
        rows, by, n = fixtures.review_events(spark, sf_dir), "review_id", 1
    else:
        rows, by, n = fixtures.privacy_audit(spark, sf_dir), "ticket_id", 2
    return [rows.where(F.pmod(F.xxhash64(by), F.lit(n)) == b) for b in range(n)]


# --- round trips, replay, joins, lookups -------------------------------------------------

_TICKET_COLS = ("ticket_id", "number", "short_description", "sanitized_text", "category", "assignment_group", "resolution",
                "urgency", "impact", "source", "created_at")


@register("stored_tickets", with_views(f"select {', '.join(_TICKET_COLS)} from tickets", "tickets"))
def q_stored_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-1, SRC-6: the tickets as stored and read back."""
    return fixture_store(spark, sf_dir, "tickets").read("tickets").select(*_TICKET_COLS)


@register("stored_reviews", with_views("select review_id, ticket_id, decision, reviewer, notes, created_at from review_events", "review_events"))
def q_stored_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-4."""
    store = fixture_store(spark, sf_dir, "reviews")
    return store.read("reviews").select("review_id", "ticket_id", "decision", "reviewer", "notes", "created_at")


@register("stored_replay", with_views("""
select ticket_id, count(*) as versions, min(event_id) as first_event, max(event_id) as last_event from routing_decisions group by ticket_id""",
                                      "routing_decisions"))
def q_stored_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-3: decisions delivered in three batches, two of them twice: every version is stored once."""
    store = fixture_store(spark, sf_dir, "decisions")
    for batch_id, rows in list(enumerate(_batches(spark, sf_dir, "decisions")))[1:]:
        if store.append("decisions", rows, batch_id):
            raise RuntimeError("a stored batch was stored again")
    return store.read("decisions").groupBy("ticket_id").agg(
        F.count("*").alias("versions"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


@register("stored_search", _search_sql("status = 'resolved' and urgency = 2 and source = 'curated'", 300))
def q_stored_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-1 over bucketed tables: neither side is exchanged."""
    store = fixture_store(spark, sf_dir, "tickets", "decisions")
    return search_tickets(store.read("tickets"), store.read("decisions"), status="resolved", urgency=2, source="curated", limit=300)


@register("stored_detail", ORACLES["ticket_detail"])
def q_stored_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-4 over bucketed tables; only matched tickets are looked up through an exchange."""
    from .detail import ticket_details

    store = fixture_store(spark, sf_dir, "tickets", "decisions", "audit")
    return ticket_details(store.read("tickets"), store.read("decisions"), store.read("audit"))


@register("stored_status_point", with_views(_STATUS_SQL.format("where ticket_id = 'DOC-000007'"), "routing_decisions"))
def q_stored_status_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-10 on the key of the stored table: the id reaches the scan and selects one bucket."""
    return routing_status(fixture_store(spark, sf_dir, "decisions").read("decisions"), "DOC-000007")


# --- latest state as snapshot plus delta ------------------------------------------------------

DECISION_STATE = ("route_path", "confidence_score", "escalation_required", "semantic_cache_hit")


def decision_snapshot(store: FactStore) -> LatestSnapshot:
    return LatestSnapshot(store, "decisions", ("created_at", "event_id"), DECISION_STATE)


@register("snapshot_decisions", ORACLES["latest_decisions"])
def q_snapshot_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-13, WIN-3: the snapshot after three batches, advanced after each of them where it was not yet."""
    store = fixture_store(spark, sf_dir)
    snapshot = decision_snapshot(store)
    for batch_id, rows in enumerate(_batches(spark, sf_dir, "decisions")):
        store.append("decisions", rows, batch_id)
        snapshot.advance()
    return snapshot.read().select("ticket_id", "route_path", "confidence_score", F.col("created_at").alias("latest_routed_at"))


# --- aggregates from stored states --------------------------------------------------------------


def ticket_states(store: FactStore) -> Rollup:
    return Rollup(store, "tickets", ("category", "assignment_group", "source"))


def decision_states(store: FactStore) -> Rollup:
    one: dict[str, Column] = {"escalations": F.col("escalation_required") == 1, "cache_hits": F.col("semantic_cache_hit") == 1}
    sums = {c: F.col(c) for c in ("confidence_score", "classification_confidence", "retrieval_similarity", "verifier_score", "latency_ms")}
    sums["privacy_score"] = F.greatest(F.lit(0.0), 1 - F.col("privacy_risk"))
    return Rollup(store, "decisions", ("route_path", "model_name"), one, sums, {"slowest_ms": F.col("latency_ms")})


def audit_states(store: FactStore) -> Rollup:
    return Rollup(store, "audit", ("policy_version", "detector_version", "entity_type"), {"high_confidence": F.col("confidence") > 0.9})


def states(spark: SparkSession, sf_dir: str, table: str, make) -> Rollup:
    rollup = make(fixture_store(spark, sf_dir, table))
    rollup.advance()
    return rollup


@register("rollup_totals", ORACLES["dashboard_totals"])
def q_rollup_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-1 from states: no fact is read and no detector run."""
    parts = [states(spark, sf_dir, t, make).merged().select(F.coalesce("n", F.lit(0)).alias(name)) for t, make, name in (
        ("tickets", ticket_states, "tickets_total"), ("decisions", decision_states, "routing_decisions_total"),
        ("audit", audit_states, "privacy_findings_total"))]
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2])  # 1 x 1 x 1 rows


@register("rollup_categories", ORACLES["category_distribution"])
def q_rollup_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-2."""
    rollup = states(spark, sf_dir, "tickets", ticket_states)
    total = rollup.merged().select(F.col("n").alias("total"))
    return rollup.merged("category").crossJoin(F.broadcast(total)).select(  # one row
        "category", F.col("n").alias("count"), safe_ratio(F.col("n"), F.col("total")).alias("percentage"))


@register("rollup_groups", ORACLES["top_groups"])
def q_rollup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-3."""
    rollup = states(spark, sf_dir, "tickets", ticket_states)
    return rollup.merged("assignment_group").select("assignment_group", F.col("n").alias("count")).orderBy(F.col("count").desc(), "assignment_group").limit(8)


@register("rollup_decision_kpis", ORACLES["decision_kpis"])
def q_rollup_decision_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-4, AGG-10."""
    d = states(spark, sf_dir, "decisions", decision_states).merged()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    d = d.withColumns({c: zero(c) for c in ("n", "escalations", "cache_hits")})
    return d.select(
        F.col("n").alias("decisions"), r4(average("confidence_score")).alias("avg_confidence"),
        r4(average("retrieval_similarity")).alias("avg_retrieval_similarity"), r4(average("verifier_score")).alias("avg_verifier_score"),
        "escalations", F.col("cache_hits").alias("semantic_cache_hits"), r1(average("latency_ms")).alias("avg_latency_ms"),
        safe_ratio(F.col("cache_hits"), F.col("n")).alias("cache_hit_rate"), safe_ratio(F.col("escalations"), F.col("n")).alias("escalation_rate"))


@register("rollup_route_counts", ORACLES["route_counts"])
def q_rollup_route_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-5."""
    return states(spark, sf_dir, "decisions", decision_states).merged("route_path").select("route_path", F.col("n").alias("count"))


@register("rollup_route_latency", ORACLES["route_latency"])
def q_rollup_route_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-7."""
    d = states(spark, sf_dir, "decisions", decision_states).merged("route_path")
    return d.select("route_path", r1(average("latency_ms")).alias("avg_latency_ms"))


@register("rollup_confidence", ORACLES["confidence_components"])
def q_rollup_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-8."""
    d = states(spark, sf_dir, "decisions", decision_states).merged()
    return d.select(*[r4(average(c)).alias(c) for c in ("classification_confidence", "retrieval_similarity", "verifier_score", "privacy_score")])


@register("rollup_days", with_views("""
select cast(created_at as date) as day, route_path, count(*) as decisions, max(latency_ms) as slowest_ms from routing_decisions group by 1, 2""",
                                    "routing_decisions"))
def q_rollup_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily states themselves, merged over the batches."""
    d = states(spark, sf_dir, "decisions", decision_states).merged("day", "route_path")
    return d.select("day", "route_path", F.col("n").alias("decisions"), "slowest_ms")


@register("rollup_privacy", ORACLES["audit_analytics"])
def q_rollup_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-9, AGG-22: findings by entity type, detector and policy version."""
    from pyspark.sql import Window

    dims = ("entity_type", "detector_version", "policy_version")
    few = states(spark, sf_dir, "audit", audit_states).merged(*dims)
    pairs = few.select("n", F.inline(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dims])))
    c = pairs.where(F.col("value") != "").groupBy("dimension", "value").agg(F.sum("n").alias("count"))
    w = Window.partitionBy("dimension")  # a handful of merged rows
    return c.select("dimension", "value", "count", pyround(F.col("count") / F.max("count").over(w), 4).alias("share_of_max"))


@register("rollup_audit_kpis", ORACLES["audit_kpis"])
def q_rollup_audit_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-8."""
    few = states(spark, sf_dir, "audit", audit_states).merged("entity_type")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return few.agg(zero("n").alias("findings"), zero("high_confidence").alias("high_confidence"),
                   F.count_if(F.col("entity_type") != "").alias("entity_types"))


# --- free text through postings ------------------------------------------------------------------

TEXT_COLUMNS = ("ticket_id", "number", "short_description", "sanitized_text")


def indexed_search(store: FactStore, q: str, **filters) -> DataFrame:
    """FLT-1/2 like :func:`search_tickets`, over the tickets that the index leaves."""
    index = TextIndex(store, "tickets", TEXT_COLUMNS)
    index.advance()
    return search_tickets(index.restrict(store.read("tickets"), q.strip()), store.read("decisions"), q=q, **filters)


def _contains_sql(literal: str) -> str:
    return "(" + " or ".join(f"contains(lower({c}), '{literal}')" for c in TEXT_COLUMNS) + ")"


@register("indexed_search", _search_sql(_contains_sql("oc-0001"), 300))
def q_indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-2: a literal that few tickets hold; their ids reach the scan."""
    return indexed_search(fixture_store(spark, sf_dir, "tickets", "decisions"), " OC-0001", limit=300)


@register("indexed_search_common", _search_sql(f"{_contains_sql('the')} and assignment_group = 'Network Ops'", 300))
def q_indexed_search_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-2: a literal that very many tickets hold."""
    return indexed_search(fixture_store(spark, sf_dir, "tickets", "decisions"), "THE", assignment_group="Network Ops", limit=300)


@register("indexed_search_short", _search_sql(f"{_contains_sql('qu')}", 300))
def q_indexed_search_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-2: too short for a trigram, so all texts are scanned."""
    return indexed_search(fixture_store(spark, sf_dir, "tickets", "decisions"), "qu", limit=300)


# --- exact top-k through the stored metric index ---------------------------------------------------


@register("indexed_topk", ORACLES["topk_similar"])
def q_indexed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SIM-3, WIN-1: the 5 nearest other vectors of each, from cells of stored vectors."""
    store = fixture_store(spark, sf_dir, "vectors")
    index = MetricIndex(store, "vectors", "neighbor_id", "embedding", rows=256)
    index.advance()
    queries = store.read("vectors").select(F.col("neighbor_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    r = index.nearest(queries, 5, "query_id", "query_embedding", exclude_self=True)
    return r.select("query_id", "rank", "neighbor_id", pyround("similarity", 6).alias("similarity"), "fast_candidate")


def indexed_evidence(store: FactStore, queries: DataFrame, k: int, query_id: str, query_vec: str) -> DataFrame:
    """JOIN-5: query id -> retrieved array. Only ids and order columns are searched; the winners' fields are fetched by id."""
    index = MetricIndex(store, "knowledge", "ticket_id", "embedding", ("created_at",), rows=256)
    index.advance()
    hits = index.nearest(queries, k, query_id, query_vec)
    fields = store.read("knowledge").select("ticket_id", "category", "assignment_group", "resolution", "source")
    row = F.struct("rank", "ticket_id", "similarity", "category", "assignment_group", "resolution", "source", "created_at")
    return hits.join(fields, "ticket_id").groupBy(query_id).agg(F.array_sort(F.collect_list(row)).alias("retrieved"))


@register("indexed_evidence", ORACLES["evidence_items"])
def q_indexed_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCR-3 over the index."""
    store = fixture_store(spark, sf_dir, "knowledge")
    e = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    return evidence_rows(indexed_evidence(store, e, FIXTURE.rag_top_k, "query_id", "query_embedding"))
