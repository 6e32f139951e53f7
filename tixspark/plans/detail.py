"""Ticket detail in batch form (JOIN-4, PRJ-6/7 detail variants, SCR-10/12, TXT-10/11).

The reference assembles one ticket with up to four point queries. Here every
ticket's detail is one plan: latest ticket ⟕ latest decision (co-partitioned on
``ticket_id``) ⟕ matched ticket ⟕ the 20 newest audit rows per ticket (a
WindowGroupLimit, so a ticket with many findings sends at most 20 rows per map
partition). A stored explanation is parsed; when none is stored the six-row
fallback is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import pyround
from ..functions.scoring import sla_pressure
from ..functions.text import parse_explanation
from ..settings import DEFAULT, Settings
from ..sources import fixtures
from ..sources.fixtures import with_views
from .common import latest_decisions, latest_tickets, risk_level, spread_key, ticket_status
from .intelligence import GAP_FALSE, GAP_TRUE
from .registry import register

# --- fixed values: impacts of the six-row fallback explanation ----------------------
IMPACT_PRIVACY = "only sanitized text is available to retrieval and model calls"
IMPACT_NEAREST = "similarity only controls the >=0.95 semantic cache bypass; otherwise the LLM decides"
IMPACT_CACHE = "approved historical resolution returned without invoking the LLM"
IMPACT_ESCALATED = "LLM decision requires human review before remediation"
IMPACT_RESOLVED = "retrieved context was attached to the prompt and resolved by the LLM"
IMPACT_RESOLVER = "derived from stored decision metadata or matched-ticket fallback"
IMPACT_SLA = "priority, confidence, retrieval gap, LLM confidence gap, and privacy risk combined"
# -------------------------------------------------------------------------------------


def f2(c: Column) -> Column:
    """Python's ``f"{x:.2f}"``: exact half-even rounding, then two decimals."""
    return F.format_string("%.2f", pyround(c, 2))


def fallback_explanation(redactions: Column, matched: Column, similarity: Column, route_path: Column,
                         cache_hit: Column, escalated: Column, group: Column, group_conf: Column,
                         sla_score: Column, sla_level: Column, gap: Column, reason: Column) -> Column:
    """TXT-11 (read side): the six explanation rows built when none is stored."""
    def row(label, value, impact):
        return F.struct(F.lit(label).alias("label"), value.alias("value"), impact.alias("impact"))

    route_impact = F.when(cache_hit, IMPACT_CACHE).when(escalated, IMPACT_ESCALATED).otherwise(IMPACT_RESOLVED)
    return F.array(
        row("Privacy gate", F.concat(redactions.cast("string"), F.lit(" redactions")), F.lit(IMPACT_PRIVACY)),
        row("Nearest approved ticket", F.concat(F.coalesce(matched, F.lit("none")), F.lit(" at "), f2(similarity)),
            F.lit(IMPACT_NEAREST)),
        row("Route branch", route_path, route_impact),
        row("Resolver recommendation", F.concat(group, F.lit(" at "), f2(group_conf)), F.lit(IMPACT_RESOLVER)),
        row("SLA risk", F.concat(sla_level, F.lit(" at "), f2(sla_score)), F.lit(IMPACT_SLA)),
        row("Knowledge coverage", F.when(gap, "gap detected").otherwise("covered"), reason),
    )


def ticket_details(tickets: DataFrame, decisions: DataFrame, audit: DataFrame,
                   settings: Settings = DEFAULT) -> DataFrame:
    t = latest_tickets(tickets, ("number", "short_description", "description", "sanitized_text", "category", "assignment_group",
                                 "resolution", "urgency", "impact", "source"))
    d = latest_decisions(decisions, ("confidence_score", "retrieval_similarity", "verifier_score", "privacy_risk",
                                     "classification_confidence", "escalation_required", "route_path", "semantic_cache_hit",
                                     "matched_ticket_id", "sla_risk_score", "sla_risk_level", "resolver_group", "resolver_confidence",
                                     "knowledge_gap", "knowledge_gap_reason"))
    if "route_explanation" not in decisions.columns:
        d = d.withColumn("route_explanation", F.lit(""))
    m = t.select(F.col("ticket_id").alias("m_id"), F.col("assignment_group").alias("m_group"), F.col("category").alias("m_category"),
                 F.col("resolution").alias("m_resolution"))
    w = Window.partitionBy("ticket_id").orderBy(F.col("created_at").desc(), F.col("start_offset").desc())
    top20 = (audit.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= 20)
             .groupBy(F.col("ticket_id").alias("a_id")).agg(
                 F.count("*").alias("redactions"),
                 F.array_sort(F.collect_list(F.struct("_rn", "entity_type", "placeholder", "confidence"))).alias("audit")))
    j = (t.join(d.withColumnRenamed("ticket_id", "d_id"), F.col("ticket_id") == F.col("d_id"), "left")
         .join(m, spread_key(F.col("matched_ticket_id"), F.col("ticket_id")) == F.col("m_id"), "left")
         .join(top20, F.col("ticket_id") == F.col("a_id"), "left"))
    stored = F.col("sla_risk_score")
    est = sla_pressure(F.col("urgency"), F.col("impact"), F.col("confidence_score"),
                            F.col("retrieval_similarity"), F.col("verifier_score"), F.col("privacy_risk"),
                            F.col("escalation_required") == 1, settings.rag_similarity_threshold)
    sim = F.col("retrieval_similarity")
    gap = ((F.col("knowledge_gap") == 1) | (sim < settings.rag_similarity_threshold)
           | ((F.col("route_path") == "generative_rag") & (F.col("verifier_score") < 0.70)))  # Q16, detail
    j = (j.withColumn("sla_score", F.when(stored <= 0, est).otherwise(stored))
         .withColumn("sla_level", F.when(stored <= 0, risk_level(est)).otherwise(
             F.when(F.col("sla_risk_level") != "", F.col("sla_risk_level")).otherwise(risk_level(stored))))
         .withColumn("gap", gap)
         .withColumn("gap_reason", F.when(F.col("knowledge_gap_reason") != "", F.col("knowledge_gap_reason"))
                     .otherwise(F.when(gap, GAP_TRUE).otherwise(GAP_FALSE)))
         .withColumn("group", F.coalesce(F.when(F.col("resolver_group") != "", F.col("resolver_group")),
                                         F.when(F.col("m_group") != "", F.col("m_group")),
                                         F.when(F.col("assignment_group") != "", F.col("assignment_group")),
                                         F.lit("Unassigned")))
         .withColumn("group_conf", F.when(F.col("resolver_confidence") > 0, F.col("resolver_confidence"))
                     .when(F.col("m_id").isNotNull(), sim).otherwise(F.lit(0.0)))
         .withColumn("redactions", F.coalesce("redactions", F.lit(0).cast("bigint"))))
    parsed = parse_explanation(F.col("route_explanation"))
    built = fallback_explanation(
        F.col("redactions"), F.when(F.col("matched_ticket_id") != "", F.col("matched_ticket_id")), sim,
        F.col("route_path"), F.col("semantic_cache_hit") == 1, F.col("escalation_required") == 1, F.col("group"),
        F.col("group_conf"), F.col("sla_score"), F.col("sla_level"), F.col("gap"), F.col("gap_reason"))
    # Routing fields of a ticket without a decision are NULL.
    routed = F.col("d_id").isNotNull()
    explanation = F.array_join(F.transform(F.when(F.size(parsed) > 0, parsed).otherwise(built), lambda r: r["value"]), "|")
    return j.select(
        "ticket_id", "number", "short_description", "category", "assignment_group", "urgency", "impact", "source",
        F.col("resolution").alias("stored_resolution"),
        ticket_status(F.col("d_id"), F.col("escalation_required"), F.col("semantic_cache_hit")).alias("status"),
        *[F.when(routed, c).alias(n) for n, c in (
            ("classification", F.col("classification_confidence")), ("verifier_score", F.col("verifier_score")),
            ("sla_risk_score", F.col("sla_score")), ("sla_risk_level", F.col("sla_level")),
            ("knowledge_gap", F.col("gap").cast("int")), ("knowledge_gap_reason", F.col("gap_reason")),
            ("gap_severity", F.when(F.col("gap"), risk_level(F.col("sla_score"))).otherwise("normal")),
            ("resolver_group", F.col("group")), ("resolver_confidence", F.col("group_conf")),
            ("resolver_source", F.when(F.col("resolver_group") != "", "stored_decision").otherwise("detail_fallback")),
            ("explanation_values", explanation))],
        F.when(routed, F.col("m_id")).alias("matched_ticket_id"), "m_category", "m_group", "m_resolution",
        "redactions",
        F.coalesce(F.array_join(F.transform("audit", lambda a: a["placeholder"]), "|"), F.lit("")).alias("audit_placeholders"))


@register("ticket_detail", with_views("""
with lt as (select * from tickets qualify row_number() over (partition by ticket_id order by created_at desc) = 1),
ld as (select * from routing_decisions qualify row_number() over (partition by ticket_id order by created_at desc, event_id desc) = 1),
a20 as (select ticket_id, count(*) as redactions, string_agg(placeholder, '|' order by created_at desc, start_offset desc) as audit_placeholders
        from (select * from privacy_audit
        qualify row_number() over (partition by ticket_id order by created_at desc, start_offset desc) <= 20) group by ticket_id),
j as (select t.number, t.short_description, t.category, t.assignment_group, t.urgency, t.impact, t.source, t.resolution, t.ticket_id,
        d.* exclude (ticket_id), d.ticket_id as d_id, m.ticket_id as m_id, m.assignment_group as m_group, m.category as m_category,
        m.resolution as m_resolution, coalesce(a.audit_placeholders, '') as audit_placeholders,
        coalesce(a.redactions, 0) as redactions,
        round(greatest(0.0, least(1.0, 0.45 * (cast((4 - t.urgency) + (4 - t.impact) as double) / 6.0)
          + 0.25 * (1.0 - greatest(0.0, least(1.0, d.confidence_score)))
          + 0.15 * (greatest(0.0, 0.7 - d.retrieval_similarity) / 0.7)
          + 0.10 * (greatest(0.0, 0.70 - d.verifier_score) / 0.70)
          + 0.05 * d.privacy_risk + case when d.escalation_required = 1 then 0.15 else 0.0 end)), 4) as est
      from lt t left join ld d on d.ticket_id = t.ticket_id left join lt m on m.ticket_id = d.matched_ticket_id
      left join a20 a on a.ticket_id = t.ticket_id),
k as (select *, case when sla_risk_score <= 0 then est else sla_risk_score end as sla_score,
        (knowledge_gap = 1 or retrieval_similarity < 0.7 or (route_path = 'generative_rag' and verifier_score < 0.70)) as gap,
        coalesce(nullif(resolver_group, ''), nullif(m_group, ''), nullif(assignment_group, ''), 'Unassigned') as grp,
        case when resolver_confidence > 0 then resolver_confidence when m_id is not null then retrieval_similarity else 0.0 end as grp_conf
      from j),
l as (select *, case when sla_risk_score <= 0 then
          (case when est >= 0.75 then 'critical' when est >= 0.55 then 'elevated' when est >= 0.35 then 'watch' else 'normal' end)
        when sla_risk_level <> '' then sla_risk_level
        else (case when sla_risk_score >= 0.75 then 'critical' when sla_risk_score >= 0.55 then 'elevated'
                   when sla_risk_score >= 0.35 then 'watch' else 'normal' end) end as sla_level,
        case when knowledge_gap_reason <> '' then knowledge_gap_reason
             when gap then 'stored RAG evidence or LLM decision confidence is below production threshold'
             else 'approved context and LLM decision confidence are sufficient' end as gap_reason from k)
select ticket_id, number, short_description, category, assignment_group, urgency, impact, source, resolution as stored_resolution,
  case when d_id is null then 'unrouted' when escalation_required = 1 then 'human_review_required'
       when semantic_cache_hit = 1 then 'semantic_cache_resolved' else 'resolved' end as status,
  classification_confidence as classification, verifier_score,
  case when d_id is not null then sla_score end as sla_risk_score, case when d_id is not null then sla_level end as sla_risk_level,
  case when d_id is not null then cast(gap as integer) end as knowledge_gap,
  case when d_id is not null then gap_reason end as knowledge_gap_reason,
  case when d_id is null then null when gap then (case when sla_score >= 0.75 then 'critical' when sla_score >= 0.55 then 'elevated'
                           when sla_score >= 0.35 then 'watch' else 'normal' end) else 'normal' end as gap_severity,
  case when d_id is not null then grp end as resolver_group, case when d_id is not null then grp_conf end as resolver_confidence,
  case when d_id is null then null when resolver_group <> '' then 'stored_decision' else 'detail_fallback' end as resolver_source,
  m_id as matched_ticket_id, m_category, m_group, m_resolution, redactions, audit_placeholders,
  case when d_id is not null then concat_ws('|', cast(redactions as varchar) || ' redactions',
    coalesce(nullif(matched_ticket_id, ''), 'none') || ' at ' || printf('%.2f', round(retrieval_similarity, 2)),
    route_path, grp || ' at ' || printf('%.2f', round(grp_conf, 2)),
    sla_level || ' at ' || printf('%.2f', round(sla_score, 2)),
    case when gap then 'gap detected' else 'covered' end) end as explanation_values
from l""", "tickets", "routing_decisions", "privacy_audit"))
def q_ticket_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticket_details(fixtures.tickets(spark, sf_dir), fixtures.routing_decisions(spark, sf_dir),
                          fixtures.privacy_audit(spark, sf_dir))


STATUS_VALUES = ("assigned_category", "confidence_score", "escalation_required", "suggested_resolution", "route_path",
                 "semantic_cache_hit", "matched_ticket_id")


def routing_status(decisions: DataFrame, ticket_id: str | None = None) -> DataFrame:
    """WIN-3 / FLT-10: the latest decision of every ticket, or of one (an equality that reaches the scan)."""
    if ticket_id is not None:
        decisions = decisions.where(F.col("ticket_id") == ticket_id)
    d = latest_decisions(decisions, STATUS_VALUES, alias="created_at")
    return d.withColumn("escalation_required", F.col("escalation_required") == 1).withColumn(
        "semantic_cache_hit", F.col("semantic_cache_hit") == 1).withColumn(
        "matched_ticket_id", F.when(F.col("matched_ticket_id") != "", F.col("matched_ticket_id")))


_STATUS_SQL = """
select ticket_id, assigned_category, confidence_score, escalation_required = 1 as escalation_required, suggested_resolution,
  route_path, semantic_cache_hit = 1 as semantic_cache_hit, nullif(matched_ticket_id, '') as matched_ticket_id, created_at
from routing_decisions {}
qualify row_number() over (partition by ticket_id order by created_at desc, event_id desc) = 1"""


@register("ticket_status", with_views(_STATUS_SQL.format(""), "routing_decisions"))
def q_ticket_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing_status(fixtures.routing_decisions(spark, sf_dir))


@register("ticket_status_point", with_views(_STATUS_SQL.format("where ticket_id = 'DOC-000007'"), "routing_decisions"))
def q_ticket_status_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The point lookup over the whole decision table."""
    return routing_status(fixtures.routing_decisions(spark, sf_dir), "DOC-000007")


def knowledge_rows(tickets: DataFrame, category: str = "", source: str = "", group: str = "", missing_resolution: bool = False) -> DataFrame:
    """FLT-4: knowledge documents with their approval flag, filtered (blank = all)."""
    k = tickets.withColumn("approved", (F.col("source") != "api") & (F.coalesce("assignment_group", F.lit("")) != "Pending Review")
                           & (F.coalesce("resolution", F.lit("")) != ""))
    for name, value in (("category", category), ("source", source), ("assignment_group", group)):
        if value:
            k = k.where(F.col(name) == value)
    return k.where(F.coalesce("resolution", F.lit("")) == "") if missing_resolution else k


@register("knowledge_filtered", with_views("""
select ticket_id, category, source, assignment_group, resolution,
  source <> 'api' and assignment_group <> 'Pending Review' and resolution <> '' as approved
from tickets where category = 'Software'""", "tickets"))
def q_knowledge_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge_rows(fixtures.tickets(spark, sf_dir), category="Software").select(
        "ticket_id", "category", "source", "assignment_group", "resolution", "approved")


@register("knowledge_missing_resolution", with_views("""
select ticket_id, category, source, assignment_group, false as approved from tickets where resolution = ''""", "tickets"))
def q_knowledge_missing_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge_rows(fixtures.tickets(spark, sf_dir), missing_resolution=True).select(
        "ticket_id", "category", "source", "assignment_group", "approved")


@register("latest_tickets", with_views("""
select ticket_id, number, category, created_at as latest_created_at from tickets
qualify row_number() over (partition by ticket_id order by created_at desc) = 1""", "tickets"))
def q_latest_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-13 on tickets."""
    return latest_tickets(fixtures.tickets(spark, sf_dir), ("number", "category"))


@register("latest_decisions", with_views("""
select ticket_id, route_path, confidence_score, created_at as latest_routed_at from routing_decisions
qualify row_number() over (partition by ticket_id order by created_at desc, event_id desc) = 1""", "routing_decisions"))
def q_latest_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-13 on decisions."""
    return latest_decisions(fixtures.routing_decisions(spark, sf_dir), ("route_path", "confidence_score"))
