"""Ticket search, facets and the recent list (JOIN-1, FLT-1/2, AGG-15, PRJ-4/5).

Plan shape: latest tickets and latest decisions are each one partial+final
aggregation hash-partitioned on ``ticket_id``; the left join reuses that
partitioning (no extra exchange), filters on latest-version columns sit above the
aggregation (Q5) and the result is a per-partition top-n merged on the driver
(``TakeOrderedAndProject``), so nothing but the final ``limit`` rows leaves the
executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import fixtures
from ..sources.fixtures import with_views
from .common import STATUSES, check_bound, latest_decisions, latest_tickets, ticket_status
from .registry import register

# Only the columns a query reads travel through the shuffle: the latest-row struct is
# opaque to nested-column pruning, so long text columns are listed only when used.
SEARCH_TICKET_VALUES = (
    "number", "short_description", "sanitized_text", "category", "assignment_group", "urgency", "impact", "source",
)
SEARCH_DECISION_VALUES = (
    "assigned_category", "confidence_score", "retrieval_similarity", "verifier_score", "escalation_required",
    "route_path", "semantic_cache_hit", "matched_ticket_id", "latency_ms", "sla_risk_score", "sla_risk_level",
    "resolver_group", "resolver_confidence", "knowledge_gap", "knowledge_gap_reason",
)


def text_match(q: str, cols: tuple[str, ...]) -> Column:
    """FLT-2: case-insensitive literal substring in any column (no wildcards)."""
    needle = F.lit(q.strip().lower())
    return reduce(lambda a, b: a | b, [F.lower(F.col(c)).contains(needle) for c in cols])


def ticket_decision_join(
    tickets: DataFrame, decisions: DataFrame, ticket_values=SEARCH_TICKET_VALUES
) -> DataFrame:
    """Latest ticket ⟕ latest decision with the reference's NULL defaults (Q1)."""
    t = latest_tickets(tickets, ticket_values)
    d = latest_decisions(decisions, SEARCH_DECISION_VALUES).withColumnRenamed("ticket_id", "d_ticket_id")
    j = t.join(d, t.ticket_id == d.d_ticket_id, "left")
    return j.select(
        "ticket_id", *ticket_values,
        F.col("latest_created_at").alias("created_at"),
        ticket_status(F.col("d_ticket_id"), F.col("escalation_required"), F.col("semantic_cache_hit")).alias("status"),
        F.coalesce("route_path", F.lit("unrouted")).alias("route_path"),
        F.coalesce("confidence_score", F.lit(0.0)).alias("confidence_score"),
        F.coalesce("retrieval_similarity", F.lit(0.0)).alias("retrieval_similarity"),
        F.coalesce("verifier_score", F.lit(0.0)).alias("verifier_score"),
        F.coalesce("escalation_required", F.lit(0)).alias("escalation_required"),
        F.coalesce("semantic_cache_hit", F.lit(0)).alias("semantic_cache_hit"),
        F.coalesce("matched_ticket_id", F.lit("")).alias("matched_ticket_id"),
        F.coalesce("latency_ms", F.lit(0).cast("bigint")).alias("latency_ms"),
        F.coalesce("sla_risk_score", F.lit(0.0)).alias("sla_risk_score"),
        F.coalesce("sla_risk_level", F.lit("")).alias("sla_risk_level"),
        F.coalesce("resolver_group", F.lit("")).alias("resolver_group"),
        F.coalesce("resolver_confidence", F.lit(0.0)).alias("resolver_confidence"),
        F.coalesce("knowledge_gap", F.lit(0)).alias("knowledge_gap"),
        F.coalesce("knowledge_gap_reason", F.lit("")).alias("knowledge_gap_reason"),
    )


SEARCH_COLUMNS = (
    "ticket_id", "number", "short_description", "category", "assignment_group", "urgency", "impact", "source",
    "created_at", "status", "route_path", "confidence_score", "retrieval_similarity", "verifier_score",
    "escalation_required", "semantic_cache_hit", "matched_ticket_id", "latency_ms", "sla_risk_score",
    "sla_risk_level", "resolver_group", "resolver_confidence", "knowledge_gap", "knowledge_gap_reason",
)


def search_tickets(
    tickets: DataFrame,
    decisions: DataFrame,
    q: str = "",
    category: str = "",
    assignment_group: str = "",
    source: str = "",
    route_path: str = "",
    status: str = "",
    urgency: int | None = None,
    impact: int | None = None,
    limit: int = 80,
) -> DataFrame:
    """FLT-1 + FLT-2 over JOIN-1, newest first."""
    check_bound("urgency", urgency, 1, 3)
    check_bound("impact", impact, 1, 3)
    check_bound("limit", limit, 1, 300)
    values = SEARCH_TICKET_VALUES if q.strip() else tuple(c for c in SEARCH_TICKET_VALUES if c != "sanitized_text")
    j = ticket_decision_join(tickets, decisions, values)
    preds: list[Column] = []
    if q.strip():
        preds.append(text_match(q, ("ticket_id", "number", "short_description", "sanitized_text")))
    for name, value in (("category", category), ("assignment_group", assignment_group), ("source", source),
                        ("route_path", route_path), ("status", status)):
        if value:
            preds.append(F.col(name) == value)
    for name, value in (("urgency", urgency), ("impact", impact)):
        if value is not None:
            preds.append(F.col(name) == value)
    if preds:
        j = j.where(reduce(lambda a, b: a & b, preds))
    return j.select(*SEARCH_COLUMNS).orderBy(F.col("created_at").desc(), F.col("ticket_id").desc()).limit(limit)


def facets(tickets: DataFrame, decisions: DataFrame) -> DataFrame:
    """AGG-15 as (facet, value, position): distinct sorted values, first 100, blanks dropped
    after the limit (Q6: all versions, not the filtered result)."""
    parts = []
    for col in ("category", "assignment_group", "source"):
        vals = tickets.select(F.col(col).alias("value")).distinct().orderBy("value").limit(100)
        parts.append(vals.where(F.col("value") != "").withColumn("facet", F.lit(col)))
    parts.append(decisions.select(F.col("route_path").alias("value")).distinct().withColumn("facet", F.lit("route_path")))
    spark = tickets.sparkSession
    parts.append(
        spark.createDataFrame([(s,) for s in STATUSES], "value string").withColumn("facet", F.lit("status"))
    )
    return reduce(DataFrame.unionByName, parts).select("facet", "value")


# ---------------------------------------------------------------------------
# Registered queries and oracles
# ---------------------------------------------------------------------------

_LATEST_SQL = """
lt as (
  select ticket_id, number, short_description, sanitized_text, category, assignment_group, urgency, impact,
         source, resolution, created_at as latest_created_at
  from tickets qualify row_number() over (partition by ticket_id order by created_at desc) = 1),
ld as (
  select * from routing_decisions
  qualify row_number() over (partition by ticket_id order by created_at desc, event_id desc) = 1),
j as (
  select t.ticket_id, t.number, t.short_description, t.sanitized_text, t.category, t.assignment_group, t.urgency,
    t.impact, t.source, t.latest_created_at as created_at,
    case when d.ticket_id is null then 'unrouted' when d.escalation_required = 1 then 'human_review_required'
         when d.semantic_cache_hit = 1 then 'semantic_cache_resolved' else 'resolved' end as status,
    coalesce(d.route_path, 'unrouted') as route_path,
    coalesce(d.confidence_score, 0.0) as confidence_score,
    coalesce(d.retrieval_similarity, 0.0) as retrieval_similarity,
    coalesce(d.verifier_score, 0.0) as verifier_score,
    coalesce(d.escalation_required, 0) as escalation_required,
    coalesce(d.semantic_cache_hit, 0) as semantic_cache_hit,
    coalesce(d.matched_ticket_id, '') as matched_ticket_id,
    coalesce(d.latency_ms, 0) as latency_ms,
    coalesce(d.sla_risk_score, 0.0) as sla_risk_score,
    coalesce(d.sla_risk_level, '') as sla_risk_level,
    coalesce(d.resolver_group, '') as resolver_group,
    coalesce(d.resolver_confidence, 0.0) as resolver_confidence,
    coalesce(d.knowledge_gap, 0) as knowledge_gap,
    coalesce(d.knowledge_gap_reason, '') as knowledge_gap_reason
  from lt t left join ld d on t.ticket_id = d.ticket_id)
"""
_SEARCH_SELECT = ", ".join(SEARCH_COLUMNS)


def _search_sql(where: str, limit: int = 80) -> str:
    return with_views(
        f"with {_LATEST_SQL} select {_SEARCH_SELECT} from j where {where} "
        f"order by created_at desc, ticket_id desc limit {limit}",
        "tickets",
        "routing_decisions",
    )


@register("search_all", _search_sql("1 = 1"))
def q_search_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, d = fixtures.tickets(spark, sf_dir), fixtures.routing_decisions(spark, sf_dir)
    return search_tickets(t, d)


@register("search_filtered", _search_sql("status = 'resolved' and urgency = 2 and source = 'curated'", 300))
def q_search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, d = fixtures.tickets(spark, sf_dir), fixtures.routing_decisions(spark, sf_dir)
    return search_tickets(t, d, status="resolved", urgency=2, source="curated", limit=300)


@register("search_unrouted", _search_sql("route_path = 'unrouted' and category = 'Network' and impact = 1", 300))
def q_search_unrouted(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, d = fixtures.tickets(spark, sf_dir), fixtures.routing_decisions(spark, sf_dir)
    return search_tickets(t, d, route_path="unrouted", category="Network", impact=1, limit=300)


_TEXT_Q = "the"
_TEXT_WHERE = " or ".join(
    f"contains(lower({c}), '{_TEXT_Q}')" for c in ("ticket_id", "number", "short_description", "sanitized_text")
)


@register("search_text", _search_sql(f"({_TEXT_WHERE}) and assignment_group = 'Network Ops'", 300))
def q_search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, d = fixtures.tickets(spark, sf_dir), fixtures.routing_decisions(spark, sf_dir)
    return search_tickets(t, d, q="  THE ", assignment_group="Network Ops", limit=300)


_FACETS_SQL = """
select facet, value from (
  select 'category' as facet, value from (select distinct category as value from tickets order by value limit 100) where value <> ''
  union all
  select 'assignment_group', value from (select distinct assignment_group as value from tickets order by value limit 100) where value <> ''
  union all
  select 'source', value from (select distinct source as value from tickets order by value limit 100) where value <> ''
  union all
  select 'route_path', value from (select distinct route_path as value from routing_decisions)
  union all
  select 'status', value from (values ('unrouted'), ('resolved'), ('semantic_cache_resolved'), ('human_review_required')) s(value)
)
"""


@register("facets", with_views(_FACETS_SQL, "tickets", "routing_decisions"))
def q_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets(fixtures.tickets(spark, sf_dir), fixtures.routing_decisions(spark, sf_dir))
