"""Routing intelligence (JOIN-3, SCR-10..12, PRJ-6/7, AGG-16..19, SRT-4/7, WIN-4/7).

``decision_facts`` = latest decision ⟕ latest ticket (own) ⟕ latest ticket (matched),
then the read-time re-estimates. The latest-ticket frame is built once and joined
twice on different keys; the first join reuses the ``ticket_id`` partitioning of the
aggregation, the second re-shuffles only the (already reduced) fact rows on
``matched_ticket_id``. Six aggregates fan out from the facts, so callers that need
several of them persist the facts once.

The reference analyses the newest ``limit`` decisions (default 500). ``limit=None``
analyses all of them, which is what the registered queries do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scoring import clamp01, sla_pressure
from ..settings import DEFAULT, Settings
from ..sources import fixtures
from ..sources.fixtures import with_views
from .common import latest_decisions, latest_tickets, r1, r4, risk_level, safe_ratio, spread_key
from .registry import register

# --- fixed values: texts of stored decisions without their own ------------------------
GAP_TRUE = "stored RAG evidence or LLM decision confidence is below production threshold"
GAP_FALSE = "approved context and LLM decision confidence are sufficient"
RECOMMENDED_ACTION = "create or refresh a runbook for this category and review similar escalations"
# -------------------------------------------------------------------------------------


def exact_avg(c: str) -> Column:
    """Mean whose sum is exact (decimal), so the result does not depend on the order in
    which partial sums meet; the oracle computes it the same way."""
    return F.sum(F.col(c).cast("decimal(38,12)")).cast("double") / F.count(c)


FACT_DECISION_VALUES = (
    "assigned_category", "confidence_score", "classification_confidence", "retrieval_similarity", "verifier_score",
    "privacy_risk", "escalation_required", "route_path", "semantic_cache_hit", "matched_ticket_id", "model_name",
    "latency_ms", "sla_risk_score", "sla_risk_level", "resolver_group", "resolver_confidence", "knowledge_gap",
    "knowledge_gap_reason",
)


def decision_facts(tickets: DataFrame, decisions: DataFrame, limit: int | None = None,
                   settings: Settings = DEFAULT) -> DataFrame:
    if limit is not None and not 50 <= limit <= 2000:
        raise ValueError("limit must be in [50, 2000]")
    lt = latest_tickets(tickets, ("short_description", "category", "assignment_group", "urgency", "impact", "source"))
    d = latest_decisions(decisions, FACT_DECISION_VALUES, alias="latest_decision_at")
    t = lt.select(F.col("ticket_id").alias("t_id"), "short_description", "category", "assignment_group", "urgency",
                  "impact", "source")
    m = lt.select(F.col("ticket_id").alias("m_id"), F.col("assignment_group").alias("m_group"))
    j = d.join(t, d.ticket_id == t.t_id, "left").join(m, spread_key(d.matched_ticket_id, d.ticket_id) == m.m_id, "left")
    # SRT-7: the reference orders and limits *before* the aggregates.
    if limit is not None:
        j = j.orderBy(F.col("latest_decision_at").desc(), F.col("ticket_id").desc()).limit(limit)
    group_sql = F.when(F.col("resolver_group") != "", F.col("resolver_group")).otherwise(
        F.coalesce(F.col("m_group"), F.col("assignment_group"), F.lit("")))  # PRJ-6
    own_group = F.coalesce(F.col("assignment_group"), F.lit(""))
    urgency = F.coalesce(F.col("urgency"), F.lit(3))
    impact = F.coalesce(F.col("impact"), F.lit(3))
    stored = F.col("sla_risk_score")
    est = sla_pressure(urgency, impact, F.col("confidence_score"), F.col("retrieval_similarity"),
                            F.col("verifier_score"), F.col("privacy_risk"), F.col("escalation_required") == 1,
                            settings.rag_similarity_threshold)
    sla = F.when(stored <= 0, est).otherwise(stored)
    level = F.when(stored <= 0, risk_level(est)).otherwise(
        F.when(F.col("sla_risk_level") != "", F.col("sla_risk_level")).otherwise(risk_level(stored)))
    gap = ((F.col("knowledge_gap") == 1) | (F.col("retrieval_similarity") < settings.rag_similarity_threshold)
           | (F.col("verifier_score") < 0.70))  # SCR-12, intelligence variant (Q16)
    reason = F.when(F.col("knowledge_gap_reason") != "", F.col("knowledge_gap_reason")).otherwise(
        F.when(gap, GAP_TRUE).otherwise(GAP_FALSE))
    rc = F.col("resolver_confidence")
    resolver_conf = F.when((rc <= 0) & (group_sql != "") & (group_sql != own_group),
                           clamp01(F.col("retrieval_similarity"))).otherwise(rc)  # PRJ-7
    resolver = F.when(group_sql != "", group_sql).when(own_group != "", own_group).otherwise(F.lit("Unassigned"))
    return j.select(
        "ticket_id",
        F.coalesce("short_description", F.lit("")).alias("short_description"),
        F.coalesce("category", "assigned_category").alias("ticket_category"),
        own_group.alias("assignment_group"), urgency.alias("urgency"), impact.alias("impact"),
        F.coalesce("source", F.lit("")).alias("source"),
        "assigned_category", "confidence_score", "classification_confidence", "retrieval_similarity",
        "verifier_score", "privacy_risk", "escalation_required", "route_path", "semantic_cache_hit",
        F.when(F.col("matched_ticket_id") != "", F.col("matched_ticket_id")).alias("matched_ticket_id"),
        "model_name", "latency_ms", sla.alias("sla_risk_score"), level.alias("sla_risk_level"),
        resolver.alias("resolver_group"), resolver_conf.alias("resolver_confidence"),
        gap.cast("int").alias("knowledge_gap"), reason.alias("knowledge_gap_reason"),
        F.col("latest_decision_at").alias("created_at"),
    )


def route_quality(facts: DataFrame) -> DataFrame:
    """AGG-16."""
    n = F.count("*")
    return facts.groupBy("route_path").agg(
        n.alias("count"), r4(F.avg("confidence_score")).alias("avg_confidence"),
        r4(F.avg("retrieval_similarity")).alias("avg_retrieval_similarity"),
        r4(F.avg("verifier_score")).alias("avg_verifier_score"), r1(F.avg("latency_ms")).alias("avg_latency_ms"),
        safe_ratio(F.sum("escalation_required"), n).alias("escalation_rate"),
        safe_ratio(F.sum("semantic_cache_hit"), n).alias("semantic_cache_rate"),
    ).orderBy(F.col("count").desc(), "route_path")  # a row per route


def sla_risk_queue(facts: DataFrame, n: int = 15) -> DataFrame:
    """SRT-4: highest SLA scores; ties keep the newest-first order of the facts."""
    return facts.orderBy(F.col("sla_risk_score").desc(), F.col("created_at").desc(), F.col("ticket_id").desc()).limit(n)


def knowledge_gaps(facts: DataFrame, n: int = 12) -> DataFrame:
    """AGG-17 + WIN-4 + SRT-6: clusters of gap rows by (category, reason).

    Examples are the 3 highest SLA scores per cluster through ``row_number() <= 3``,
    which Spark plans as a partial WindowGroupLimit before the shuffle, so a hot
    cluster sends at most 3 rows per map partition. Clusters are ordered by count,
    then severity *as text* (Q8), then category and reason.
    """
    gaps = facts.where(F.col("knowledge_gap") == 1).withColumnRenamed("assigned_category", "category") \
        .withColumnRenamed("knowledge_gap_reason", "reason")
    agg = gaps.groupBy("category", "reason").agg(
        F.count("*").alias("count"), F.max("sla_risk_score").alias("_max"),
        r4(exact_avg("retrieval_similarity")).alias("avg_retrieval_similarity"),
        r4(exact_avg("verifier_score")).alias("avg_verifier_score"))
    w = Window.partitionBy("category", "reason").orderBy(
        F.col("sla_risk_score").desc(), F.col("created_at").desc(), F.col("ticket_id").desc())
    ex = (gaps.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= 3)
          .groupBy("category", "reason")
          .agg(F.array_sort(F.collect_list(F.struct("_rn", "ticket_id", "short_description", "sla_risk_score", "confidence_score")))
               .alias("_ex")))
    out = agg.join(ex, ["category", "reason"]).select(
        "category", "reason", risk_level(F.col("_max")).alias("severity"), "count", "avg_retrieval_similarity",
        "avg_verifier_score", F.lit(RECOMMENDED_ACTION).alias("recommended_action"),
        F.array_join(F.transform("_ex", lambda x: x["ticket_id"]), ",").alias("example_ticket_ids"),
        F.array_join(F.transform("_ex", lambda x: F.concat_ws(
            " / ", x["short_description"], F.format_string("%.4f", x["sla_risk_score"]),
            F.format_string("%.3f", x["confidence_score"]))), "\n").alias("examples"))
    return out.orderBy(F.col("count").desc(), F.col("severity").desc(), "category", "reason").limit(n)


def resolver_capacity(facts: DataFrame) -> DataFrame:
    """AGG-18 + SCR-18 + WIN-7: load per resolver group against the busiest group."""
    n = F.count("*")
    g = facts.groupBy(F.col("resolver_group").alias("group")).agg(
        n.alias("workload"), F.sum("escalation_required").cast("bigint").alias("open_escalations"),
        F.count_if(F.col("sla_risk_level") == "critical").alias("critical_sla"),
        F.avg("confidence_score").alias("_avg"))
    max_w = F.max("workload").over(Window.partitionBy())  # over the per-group rows only
    load = F.least(F.lit(1.0), 0.55 * (F.col("workload") / max_w)
                   + 0.25 * safe_ratio(F.col("open_escalations"), F.col("workload")) + 0.20 * (1.0 - F.col("_avg")))
    out = g.withColumn("_load", load)
    return out.select(
        "group", "workload", "open_escalations", "critical_sla", r4("_avg").alias("avg_confidence"),
        r4("_load").alias("load_index"),
        F.when(F.col("_load") >= 0.75, "saturated").when(F.col("_load") >= 0.50, "constrained")
        .otherwise("available").alias("recommendation"))


def intelligence_summary(facts: DataFrame) -> DataFrame:
    """AGG-19."""
    n = F.count("*")
    return facts.agg(
        n.alias("decisions_analyzed"),
        safe_ratio(F.count_if(F.col("escalation_required") != 1), n).alias("auto_resolution_rate"),
        safe_ratio(F.count_if(F.col("semantic_cache_hit") == 1), n).alias("semantic_cache_rate"),
        safe_ratio(F.count_if(F.col("escalation_required") == 1), n).alias("human_review_rate"),
        F.count_if(F.col("knowledge_gap") == 1).alias("knowledge_gap_count"),
        F.count_if(F.col("sla_risk_level") == "critical").alias("critical_sla_count"),
        r4(F.coalesce(F.avg("sla_risk_score"), F.lit(0.0))).alias("avg_sla_risk"),
        r4(F.coalesce(F.avg("confidence_score"), F.lit(0.0))).alias("avg_confidence"),
    )


# ---------------------------------------------------------------------------
# Oracles
# ---------------------------------------------------------------------------

_FACTS_SQL = f"""
lt as (select * from tickets qualify row_number() over (partition by ticket_id order by created_at desc) = 1),
ld as (select * from routing_decisions qualify row_number() over (partition by ticket_id order by created_at desc, event_id desc) = 1),
j as (
  select d.*, d.created_at as latest_decision_at, t.short_description as t_short, t.category as t_category,
    t.assignment_group as t_group, t.urgency as t_urgency, t.impact as t_impact, t.source as t_source,
    m.assignment_group as m_group
  from ld d left join lt t on d.ticket_id = t.ticket_id left join lt m on d.matched_ticket_id = m.ticket_id),
k as (
  select *,
    case when resolver_group <> '' then resolver_group else coalesce(m_group, t_group, '') end as group_sql,
    coalesce(t_group, '') as own_group, coalesce(t_urgency, 3) as u, coalesce(t_impact, 3) as i,
    round(greatest(0.0, least(1.0,
      0.45 * (cast((4 - coalesce(t_urgency, 3)) + (4 - coalesce(t_impact, 3)) as double) / 6.0)
      + 0.25 * (1.0 - greatest(0.0, least(1.0, confidence_score)))
      + 0.15 * (greatest(0.0, 0.7 - retrieval_similarity) / 0.7)
      + 0.10 * (greatest(0.0, 0.70 - verifier_score) / 0.70)
      + 0.05 * privacy_risk + case when escalation_required = 1 then 0.15 else 0.0 end)), 4) as est,
    (knowledge_gap = 1 or retrieval_similarity < 0.7 or verifier_score < 0.70) as gap
  from j),
facts as (
  select ticket_id, coalesce(t_short, '') as short_description, coalesce(t_category, assigned_category) as ticket_category,
    own_group as assignment_group, u as urgency, i as impact, coalesce(t_source, '') as source,
    assigned_category, confidence_score, classification_confidence, retrieval_similarity, verifier_score, privacy_risk,
    escalation_required, route_path, semantic_cache_hit, nullif(matched_ticket_id, '') as matched_ticket_id,
    model_name, latency_ms,
    case when sla_risk_score <= 0 then est else sla_risk_score end as sla_risk_score,
    case when sla_risk_score <= 0 then
           case when est >= 0.75 then 'critical' when est >= 0.55 then 'elevated' when est >= 0.35 then 'watch' else 'normal' end
         when sla_risk_level <> '' then sla_risk_level
         else case when sla_risk_score >= 0.75 then 'critical' when sla_risk_score >= 0.55 then 'elevated'
                   when sla_risk_score >= 0.35 then 'watch' else 'normal' end end as sla_risk_level,
    case when group_sql <> '' then group_sql when own_group <> '' then own_group else 'Unassigned' end as resolver_group,
    case when resolver_confidence <= 0 and group_sql <> '' and group_sql <> own_group
         then greatest(0.0, least(1.0, retrieval_similarity)) else resolver_confidence end as resolver_confidence,
    cast(gap as integer) as knowledge_gap,
    case when knowledge_gap_reason <> '' then knowledge_gap_reason when gap then '{GAP_TRUE}' else '{GAP_FALSE}' end
      as knowledge_gap_reason,
    latest_decision_at as created_at
  from k)
"""
_FACT_COLS = ("ticket_id, short_description, ticket_category, assignment_group, urgency, impact, source, "
              "assigned_category, confidence_score, classification_confidence, retrieval_similarity, verifier_score, "
              "privacy_risk, escalation_required, route_path, semantic_cache_hit, matched_ticket_id, model_name, "
              "latency_ms, sla_risk_score, sla_risk_level, resolver_group, resolver_confidence, knowledge_gap, "
              "knowledge_gap_reason, created_at")


def _facts_sql(body: str) -> str:
    return with_views(f"with {_FACTS_SQL} {body}", "tickets", "routing_decisions")


def _facts(spark: SparkSession, sf_dir: str, limit: int | None = None) -> DataFrame:
    return decision_facts(fixtures.tickets(spark, sf_dir), fixtures.routing_decisions(spark, sf_dir), limit)


@register("decision_facts", _facts_sql(f"select {_FACT_COLS} from facts"))
def q_decision_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir)


@register("decision_facts_newest", _facts_sql(
    f"select {_FACT_COLS} from facts order by created_at desc, ticket_id desc limit 50"))
def q_decision_facts_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-7: the newest-n window of the intelligence endpoint (n = 50, its lower bound)."""
    return _facts(spark, sf_dir, 50)


@register("route_quality", _facts_sql("""
select route_path, count(*) as count, round(avg(confidence_score), 4) as avg_confidence,
  round(avg(retrieval_similarity), 4) as avg_retrieval_similarity, round(avg(verifier_score), 4) as avg_verifier_score,
  round(avg(latency_ms), 1) as avg_latency_ms, round(sum(escalation_required) / count(*), 4) as escalation_rate,
  round(sum(semantic_cache_hit) / count(*), 4) as semantic_cache_rate
from facts group by route_path"""))
def q_route_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route_quality(_facts(spark, sf_dir))


@register("sla_risk_queue", _facts_sql(
    "select ticket_id, sla_risk_score, sla_risk_level, created_at from facts "
    "order by sla_risk_score desc, created_at desc, ticket_id desc limit 15"))
def q_sla_risk_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sla_risk_queue(_facts(spark, sf_dir)).select("ticket_id", "sla_risk_score", "sla_risk_level", "created_at")


@register("knowledge_gaps", _facts_sql(f"""
, g as (select assigned_category as category, knowledge_gap_reason as reason, * from facts where knowledge_gap = 1),
a as (select category, reason, count(*) as count, max(sla_risk_score) as mx,
        round(cast(sum(cast(retrieval_similarity as decimal(38,12))) as double) / count(retrieval_similarity), 4) as avg_retrieval_similarity,
        round(cast(sum(cast(verifier_score as decimal(38,12))) as double) / count(verifier_score), 4) as avg_verifier_score
      from g group by category, reason),
e as (select category, reason, string_agg(ticket_id, ',' order by rn) as example_ticket_ids,
        string_agg(concat_ws(' / ', short_description, printf('%.4f', sla_risk_score), printf('%.3f', confidence_score)), chr(10) order by rn) as examples
      from (
        select category, reason, ticket_id, short_description, sla_risk_score, confidence_score,
          row_number() over (partition by category, reason order by sla_risk_score desc, created_at desc, ticket_id desc) as rn
        from g) where rn <= 3 group by category, reason)
select a.category, a.reason,
  case when mx >= 0.75 then 'critical' when mx >= 0.55 then 'elevated' when mx >= 0.35 then 'watch' else 'normal' end as severity,
  count, avg_retrieval_similarity, avg_verifier_score, '{RECOMMENDED_ACTION}' as recommended_action, example_ticket_ids, examples
from a join e using (category, reason)
order by count desc, severity desc, category, reason limit 12"""))
def q_knowledge_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge_gaps(_facts(spark, sf_dir))


@register("resolver_capacity", _facts_sql("""
, g as (select resolver_group as "group", count(*) as workload, cast(sum(escalation_required) as bigint) as open_escalations,
          count(*) filter (where sla_risk_level = 'critical') as critical_sla, avg(confidence_score) as av
        from facts group by resolver_group),
l as (select *, least(1.0, 0.55 * (workload / max(workload) over ())
          + 0.25 * case when workload = 0 then 0.0 else round(open_escalations / workload, 4) end
          + 0.20 * (1.0 - av)) as ld from g)
select "group", workload, open_escalations, critical_sla, round(av, 4) as avg_confidence, round(ld, 4) as load_index,
  case when ld >= 0.75 then 'saturated' when ld >= 0.50 then 'constrained' else 'available' end as recommendation
from l"""))
def q_resolver_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolver_capacity(_facts(spark, sf_dir))


@register("intelligence_summary", _facts_sql("""
select count(*) as decisions_analyzed,
  case when count(*) = 0 then 0.0 else round(count(*) filter (where escalation_required <> 1) / count(*), 4) end as auto_resolution_rate,
  case when count(*) = 0 then 0.0 else round(count(*) filter (where semantic_cache_hit = 1) / count(*), 4) end as semantic_cache_rate,
  case when count(*) = 0 then 0.0 else round(count(*) filter (where escalation_required = 1) / count(*), 4) end as human_review_rate,
  count(*) filter (where knowledge_gap = 1) as knowledge_gap_count,
  count(*) filter (where sla_risk_level = 'critical') as critical_sla_count,
  round(coalesce(avg(sla_risk_score), 0), 4) as avg_sla_risk, round(coalesce(avg(confidence_score), 0), 4) as avg_confidence
from facts"""))
def q_intelligence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intelligence_summary(_facts(spark, sf_dir))
