"""Dashboard, evaluation KPIs, recency lists and review feedback
(AGG-1..8, AGG-10..12, AGG-20/21, SRT-1/2/5/8, FLT-5/6/12).

Every aggregate is a global or low-cardinality group-by: partial aggregation on each
map partition, one small exchange, one final row set. Ratios against a global total
join a one-row aggregate (broadcast by construction: it is exactly one row).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import fixtures
from ..sources.fixtures import with_views
from .common import check_bound, r1, r4, safe_ratio
from .registry import register

ROUTE_PATHS = ("semantic_cache", "generative_rag", "out_of_distribution", "human_review_required")


def _avg0(c: str) -> Column:
    """avg with 0 for an empty input (the reference's ``if(count() = 0, 0, avg(x))``)."""
    return F.coalesce(F.avg(c), F.lit(0.0))


@register("dashboard_totals", with_views("""
select (select count(*) from tickets) as tickets_total,
       (select count(*) from routing_decisions) as routing_decisions_total,
       (select count(*) from privacy_audit) as privacy_findings_total""",
                                         "tickets", "routing_decisions", "privacy_audit"))
def q_dashboard_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-1: three global counts, each a partial count + single-row final."""
    t = fixtures.tickets(spark, sf_dir).agg(F.count("*").alias("tickets_total"))
    d = fixtures.routing_decisions(spark, sf_dir).agg(F.count("*").alias("routing_decisions_total"))
    a = fixtures.privacy_audit(spark, sf_dir).agg(F.count("*").alias("privacy_findings_total"))
    return t.crossJoin(d).crossJoin(a)  # 1 × 1 × 1 rows


def category_distribution(tickets: DataFrame) -> DataFrame:
    """AGG-2: count per category and its share of all tickets."""
    counts = tickets.groupBy("category").agg(F.count("*").alias("count"))
    total = tickets.agg(F.count("*").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).select(
        "category", "count", safe_ratio(F.col("count"), F.col("_total")).alias("percentage"))


@register("category_distribution", with_views("""
select category, count(*) as count,
  case when (select count(*) from tickets) = 0 then 0.0 else round(count(*) / (select count(*) from tickets), 4) end as percentage
from tickets group by category""", "tickets"))
def q_category_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return category_distribution(fixtures.tickets(spark, sf_dir))


@register("top_groups", with_views("""
select assignment_group, count(*) as count from tickets group by assignment_group
order by count desc, assignment_group limit 8""", "tickets"))
def q_top_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-3."""
    return (fixtures.tickets(spark, sf_dir).groupBy("assignment_group").agg(F.count("*").alias("count"))
            .orderBy(F.col("count").desc(), "assignment_group").limit(8))


def decision_kpis(d: DataFrame) -> DataFrame:
    """AGG-4 + AGG-10: decision counts, averages, flags and rates."""
    n = F.count("*")
    agg = d.agg(
        n.alias("decisions"),
        _avg0("confidence_score").alias("_c"), _avg0("retrieval_similarity").alias("_r"),
        _avg0("verifier_score").alias("_v"), F.coalesce(F.sum("escalation_required"), F.lit(0)).alias("escalations"),
        F.coalesce(F.sum("semantic_cache_hit"), F.lit(0)).alias("semantic_cache_hits"),
        _avg0("latency_ms").alias("_l"),
    )
    return agg.select(
        "decisions", r4("_c").alias("avg_confidence"), r4("_r").alias("avg_retrieval_similarity"),
        r4("_v").alias("avg_verifier_score"), F.col("escalations").cast("bigint").alias("escalations"),
        F.col("semantic_cache_hits").cast("bigint").alias("semantic_cache_hits"), r1("_l").alias("avg_latency_ms"),
        safe_ratio(F.col("semantic_cache_hits"), F.col("decisions")).alias("cache_hit_rate"),
        safe_ratio(F.col("escalations"), F.col("decisions")).alias("escalation_rate"),
    )


@register("decision_kpis", with_views("""
select count(*) as decisions, round(coalesce(avg(confidence_score), 0), 4) as avg_confidence,
  round(coalesce(avg(retrieval_similarity), 0), 4) as avg_retrieval_similarity,
  round(coalesce(avg(verifier_score), 0), 4) as avg_verifier_score,
  cast(coalesce(sum(escalation_required), 0) as bigint) as escalations,
  cast(coalesce(sum(semantic_cache_hit), 0) as bigint) as semantic_cache_hits,
  round(coalesce(avg(latency_ms), 0), 1) as avg_latency_ms,
  case when count(*) = 0 then 0.0 else round(sum(semantic_cache_hit) / count(*), 4) end as cache_hit_rate,
  case when count(*) = 0 then 0.0 else round(sum(escalation_required) / count(*), 4) end as escalation_rate
from routing_decisions""", "routing_decisions"))
def q_decision_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision_kpis(fixtures.routing_decisions(spark, sf_dir))


@register("route_counts", with_views(
    "select route_path, count(*) as count from routing_decisions group by route_path", "routing_decisions"))
def q_route_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-5."""
    return fixtures.routing_decisions(spark, sf_dir).groupBy("route_path").agg(F.count("*").alias("count"))


def route_distribution(d: DataFrame) -> DataFrame:
    """AGG-6: fixed record with 0 for absent paths; human_review mirrors human_review_required."""
    return d.agg(
        *[F.count_if(F.col("route_path") == p).alias(p) for p in ROUTE_PATHS],
    ).withColumn("human_review", F.col("human_review_required"))


@register("route_distribution", with_views("""
select count(*) filter (where route_path = 'semantic_cache') as semantic_cache,
  count(*) filter (where route_path = 'generative_rag') as generative_rag,
  count(*) filter (where route_path = 'out_of_distribution') as out_of_distribution,
  count(*) filter (where route_path = 'human_review_required') as human_review_required,
  count(*) filter (where route_path = 'human_review_required') as human_review
from routing_decisions""", "routing_decisions"))
def q_route_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route_distribution(fixtures.routing_decisions(spark, sf_dir))


@register("route_latency", with_views(
    "select route_path, round(coalesce(avg(latency_ms), 0), 1) as avg_latency_ms from routing_decisions group by route_path",
    "routing_decisions"))
def q_route_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-7."""
    return fixtures.routing_decisions(spark, sf_dir).groupBy("route_path").agg(
        r1(_avg0("latency_ms")).alias("avg_latency_ms"))


@register("confidence_components", with_views("""
select round(coalesce(avg(classification_confidence), 0), 4) as classification_confidence,
  round(coalesce(avg(retrieval_similarity), 0), 4) as retrieval_similarity,
  round(coalesce(avg(verifier_score), 0), 4) as verifier_score,
  round(coalesce(avg(greatest(0, 1 - privacy_risk)), 0), 4) as privacy_score
from routing_decisions""", "routing_decisions"))
def q_confidence_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-8."""
    d = fixtures.routing_decisions(spark, sf_dir)
    return d.agg(
        r4(_avg0("classification_confidence")).alias("classification_confidence"),
        r4(_avg0("retrieval_similarity")).alias("retrieval_similarity"),
        r4(_avg0("verifier_score")).alias("verifier_score"),
        r4(F.coalesce(F.avg(F.greatest(F.lit(0.0), 1 - F.col("privacy_risk"))), F.lit(0.0))).alias("privacy_score"),
    )


@register("evaluation_kpis", with_views("""
select (select count(*) from tickets) as dataset_rows,
  (select count(distinct category) from tickets) as labeled_categories,
  count(*) as routed_tickets,
  round(coalesce(avg(confidence_score), 0), 4) as avg_confidence,
  round(coalesce(avg(retrieval_similarity), 0), 4) as avg_retrieval_similarity,
  round(coalesce(avg(verifier_score), 0), 4) as avg_verifier_score,
  case when count(*) = 0 then 0.0 else round(sum(escalation_required) / count(*), 4) end as escalation_rate,
  case when count(*) = 0 then 0.0 else round(sum(semantic_cache_hit) / count(*), 4) end as semantic_cache_hit_rate,
  round(coalesce(avg(latency_ms), 0), 1) as avg_latency_ms,
  (select count(*) from privacy_audit) as privacy_findings
from routing_decisions""", "tickets", "routing_decisions", "privacy_audit"))
def q_evaluation_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-10..12: one-row join of three aggregates."""
    t = fixtures.tickets(spark, sf_dir).agg(
        F.count("*").alias("dataset_rows"), F.count_distinct("category").alias("labeled_categories"))
    k = decision_kpis(fixtures.routing_decisions(spark, sf_dir)).select(
        F.col("decisions").alias("routed_tickets"), "avg_confidence", "avg_retrieval_similarity",
        "avg_verifier_score", "escalation_rate", F.col("cache_hit_rate").alias("semantic_cache_hit_rate"),
        "avg_latency_ms")
    a = fixtures.privacy_audit(spark, sf_dir).agg(F.count("*").alias("privacy_findings"))
    return t.crossJoin(k).crossJoin(a)  # 1 × 1 × 1 rows


@register("newest_tickets", with_views("""
select ticket_id, short_description, category, assignment_group, urgency, impact, created_at
from tickets order by created_at desc, ticket_id desc limit 8""", "tickets"))
def q_newest_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-1: per-partition top-n then a final merge (TakeOrderedAndProject)."""
    return (fixtures.tickets(spark, sf_dir)
            .select("ticket_id", "short_description", "category", "assignment_group", "urgency", "impact",
                    "created_at")
            .orderBy(F.col("created_at").desc(), F.col("ticket_id").desc()).limit(8))


@register("knowledge_list", with_views("""
select ticket_id, short_description, category, assignment_group, sanitized_text, resolution, source, created_at
from tickets order by created_at desc, ticket_id desc limit 80""", "tickets"))
def q_knowledge_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge_list(fixtures.tickets(spark, sf_dir))


def knowledge_list(tickets: DataFrame, limit: int = 80) -> DataFrame:
    """SRT-8, FLT-11: the newest knowledge documents."""
    check_bound("limit", limit, 1, 300)
    top = tickets.select("ticket_id", "short_description", "category", "assignment_group", "sanitized_text", "resolution", "source", "created_at")
    return top.orderBy(F.col("created_at").desc(), F.col("ticket_id").desc()).limit(limit)


def escalation_queue(d: DataFrame, limit: int = 50) -> DataFrame:
    """SRT-2 + FLT-5 + FLT-6: newest escalated decision rows (Q29: every row, not the
    latest per ticket) and the urgent flag, where a confidence of 0 counts as 1 (Q18)."""
    check_bound("limit", limit, 1, 200)
    conf = F.coalesce(F.when(F.col("confidence_score") != 0, F.col("confidence_score")), F.lit(1.0))
    urgent = ((conf < 0.65) | (F.coalesce("privacy_risk", F.lit(0.0)) > 0.15)).cast("int")
    return (d.where(F.col("escalation_required") == 1)
            .select("event_id", "ticket_id", "assigned_category", "confidence_score", "classification_confidence",
                    "retrieval_similarity", "verifier_score", "privacy_risk", "suggested_resolution", "latency_ms",
                    "route_path", "semantic_cache_hit", "matched_ticket_id", "created_at", urgent.alias("urgent"))
            .orderBy(F.col("created_at").desc(), F.col("event_id").desc()).limit(limit))


@register("escalation_queue", with_views("""
select event_id, ticket_id, assigned_category, confidence_score, classification_confidence, retrieval_similarity,
  verifier_score, privacy_risk, suggested_resolution, latency_ms, route_path, semantic_cache_hit, matched_ticket_id,
  created_at,
  case when coalesce(nullif(confidence_score, 0), 1) < 0.65 or coalesce(privacy_risk, 0) > 0.15 then 1 else 0 end as urgent
from routing_decisions where escalation_required = 1 order by created_at desc, event_id desc limit 50""",
                                         "routing_decisions"))
def q_escalation_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return escalation_queue(fixtures.routing_decisions(spark, sf_dir))


CORRECTIONS = ("corrected", "misrouted", "wrong_category", "wrong_resolution", "edit", "edited")
APPROVALS = ("accept", "accepted", "approve", "approved")


def review_feedback(reviews: DataFrame) -> DataFrame:
    """AGG-20: counts by decision, the total and the correction rate (one row per decision)."""
    by = reviews.groupBy("decision").agg(F.count("*").alias("count"))
    tot = reviews.agg(F.count("*").alias("total_events"),
                      F.count_if(F.col("decision").isin(*CORRECTIONS)).alias("_corr"))
    return by.crossJoin(F.broadcast(tot)).select(
        "decision", "count", "total_events",
        safe_ratio(F.col("_corr"), F.col("total_events")).alias("correction_rate"))


@register("review_feedback", with_views("""
with t as (select count(*) as total_events,
  count(*) filter (where decision in ('corrected','misrouted','wrong_category','wrong_resolution','edit','edited')) as corr
  from review_events)
select decision, count(*) as count, any_value(t.total_events) as total_events,
  case when any_value(t.total_events) = 0 then 0.0 else round(any_value(t.corr) / any_value(t.total_events), 4) end as correction_rate
from review_events cross join t group by decision""", "review_events"))
def q_review_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review_feedback(fixtures.review_events(spark, sf_dir))


@register("review_rollup", with_views("""
select count(*) filter (where decision in ('accept','accepted','approve','approved')) as approvals,
  count(*) filter (where decision in ('corrected','misrouted','wrong_category','wrong_resolution','edit','edited')) as corrections,
  count(*) as total_events
from review_events""", "review_events"))
def q_review_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-21: approvals / corrections from decision labels."""
    r = fixtures.review_events(spark, sf_dir)
    return r.agg(F.count_if(F.col("decision").isin(*APPROVALS)).alias("approvals"),
                 F.count_if(F.col("decision").isin(*CORRECTIONS)).alias("corrections"),
                 F.count("*").alias("total_events"))


@register("review_recent", with_views("""
select review_id, ticket_id, decision, reviewer, notes, corrected_category, corrected_assignment_group,
  corrected_resolution, created_at
from review_events order by created_at desc, review_id desc limit 30""", "review_events"))
def q_review_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review_recent(fixtures.review_events(spark, sf_dir), 30)


def review_recent(reviews: DataFrame, limit: int = 50) -> DataFrame:
    """SRT-5, FLT-11: the newest reviews."""
    check_bound("limit", limit, 1, 200)
    return reviews.orderBy(F.col("created_at").desc(), F.col("review_id").desc()).limit(limit)


# --- fixed values: review vocabulary (12 accepted decisions) ---
REVIEW_VOCABULARY = ("accept", "accepted", "approve", "approved", "reject", "rejected", "edit", "edited",
                     "corrected", "misrouted", "wrong_category", "wrong_resolution")


def normalize_review_decision(raw: Column) -> Column:
    """FLT-12: trim, lower, spaces → '_'; NULL when outside the vocabulary."""
    v = F.replace(F.lower(F.trim(raw)), F.lit(" "), F.lit("_"))
    return F.when(v.isin(*REVIEW_VOCABULARY), v)


@register("review_normalize", with_views("""
with raw as (
  select review_id, case (length(notes) % 4) when 0 then upper(decision) when 1 then concat('  ', decision, ' ')
    when 2 then replace(decision, '_', ' ') else concat(decision, 'x') end as raw_decision
  from review_events)
select review_id, raw_decision,
  case when replace(lower(trim(raw_decision)), ' ', '_') in
    ('accept','accepted','approve','approved','reject','rejected','edit','edited','corrected','misrouted','wrong_category','wrong_resolution')
  then replace(lower(trim(raw_decision)), ' ', '_') end as decision,
  case when replace(lower(trim(raw_decision)), ' ', '_') in
    ('accept','accepted','approve','approved','reject','rejected','edit','edited','corrected','misrouted','wrong_category','wrong_resolution')
  then 1 else 0 end as valid
from raw""", "review_events"))
def q_review_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-12 on review events whose decision text is perturbed (case, blanks, '_'→' ', junk)."""
    r = fixtures.review_events(spark, sf_dir)
    d = F.col("decision")
    raw = (F.when(F.length("notes") % 4 == 0, F.upper(d))
           .when(F.length("notes") % 4 == 1, F.concat(F.lit("  "), d, F.lit(" ")))
           .when(F.length("notes") % 4 == 2, F.replace(d, F.lit("_"), F.lit(" ")))
           .otherwise(F.concat(d, F.lit("x"))))
    n = r.select("review_id", raw.alias("raw_decision")).withColumn(
        "decision", normalize_review_decision(F.col("raw_decision")))
    return n.withColumn("valid", F.col("decision").isNotNull().cast("int"))
