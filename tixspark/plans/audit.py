"""Privacy audit: redaction outputs and audit analytics (RED-*, AGG-9/14/22, FLT-7/8,
SRT-3, SNK-2/7, JOIN-2).

The redaction is a per-row projection over ``documents`` (narrow, no shuffle). The
analytics are partial+final aggregations; "share of max" uses a window over the
already-aggregated (small) result, never over raw rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import pyround
from ..functions.redact import DETECTORS, pii_hits
from ..sources import fixtures
from ..sources.fixtures import with_views
from ..sources.tables import read_table
from .common import check_bound, latest_decisions, latest_tickets, ticket_status
from .registry import register


@register("redact_text", with_views(
    "select doc_id, sanitized_text, raw_sha256, sanitized_sha256, redacted_count from redacted_docs",
    "redacted_docs"))
def q_redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.redacted_documents(spark, sf_dir).select(
        "doc_id", "sanitized_text", "raw_sha256", "sanitized_sha256", "redacted_count")


@register("redact_findings", with_views(
    "select doc_id, entity_type, placeholder, confidence, start_offset, end_offset from redaction where kind = 'finding'",
    "redaction"))
def q_redact_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    red = fixtures.redacted_documents(spark, sf_dir)
    # inline_outer + filter: keeps the optimizer from re-running the scan in an inferred filter.
    return red.select("doc_id", F.inline_outer("findings")).where(F.col("entity_type").isNotNull())


_HITS_VALUES = ",\n".join(
    f"('{t}', cast({c} as double), '{p.replace(chr(39), chr(39) * 2)}')" for t, c, p in DETECTORS)


@register("pii_hits", f"""
with det(entity_type, confidence, rx) as (values {_HITS_VALUES}),
m as (select d.doc_id, det.entity_type, det.confidence, regexp_extract_all(coalesce(d.text, ''), det.rx, 0) as ms
      from documents d cross join det)
select doc_id, entity_type, confidence, unnest(generate_series(0, len(ms) - 1)) as match_index, unnest(ms) as matched
from m where len(ms) > 0""")
def q_pii_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return pii_hits(docs, "text").select(
        "doc_id", "entity_type", "confidence", F.col("match_index").cast("bigint").alias("match_index"), "matched")


_AUDIT_COLS = ("stream_id", "ticket_id", "raw_sha256", "sanitized_sha256", "detector_version", "policy_version",
               "entity_type", "placeholder", "confidence", "start_offset", "end_offset", "created_at")


@register("audit_explode", with_views(f"select {', '.join(_AUDIT_COLS)} from privacy_audit", "privacy_audit"))
def q_audit_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.privacy_audit(spark, sf_dir).select(*_AUDIT_COLS)


@register("privacy_by_type", with_views("""
select entity_type, count(*) as count,
  case when row_number() over (order by count(*) desc, entity_type) <= 2 then 1 else 0 end as is_top_type
from privacy_audit group by entity_type""", "privacy_audit"))
def q_privacy_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-9: findings by entity type; the first two are the top types."""
    counts = fixtures.privacy_audit(spark, sf_dir).groupBy("entity_type").agg(F.count("*").alias("count"))
    # The window runs over the aggregated rows (one per entity type), not raw findings.
    w = Window.orderBy(F.col("count").desc(), F.col("entity_type"))
    return counts.withColumn("is_top_type", F.when(F.row_number().over(w) <= 2, 1).otherwise(0))


@register("redaction_counts", with_views(
    "select ticket_id, count(*) as redactions from privacy_audit group by ticket_id", "privacy_audit"))
def q_redaction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-14: redactions per ticket (all versions, Q28)."""
    return fixtures.privacy_audit(spark, sf_dir).groupBy("ticket_id").agg(F.count("*").alias("redactions"))


def audit_analytics(audit: DataFrame) -> DataFrame:
    """AGG-22: counts by entity type (with share of the largest), detector and policy
    version. One scan: each audit row is expanded into its three (dimension, value)
    pairs and a single partial+final aggregation counts them all."""
    dims = ("entity_type", "detector_version", "policy_version")
    pairs = audit.select(F.inline(F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dims])))
    c = pairs.where(F.col("value") != "").groupBy("dimension", "value").agg(F.count("*").alias("count"))
    # The window runs over the aggregated rows (a handful per dimension), not raw findings.
    w = Window.partitionBy("dimension")
    return c.select("dimension", "value", "count",
                    pyround(F.col("count") / F.max("count").over(w), 4).alias("share_of_max"))


@register("audit_analytics", with_views("""
select dimension, value, count, round(count / max(count) over (partition by dimension), 4) as share_of_max from (
  select 'entity_type' as dimension, entity_type as value, count(*) as count from privacy_audit where entity_type <> '' group by 1, 2
  union all
  select 'detector_version', detector_version, count(*) from privacy_audit where detector_version <> '' group by 1, 2
  union all
  select 'policy_version', policy_version, count(*) from privacy_audit where policy_version <> '' group by 1, 2)""",
    "privacy_audit"))
def q_audit_analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_analytics(fixtures.privacy_audit(spark, sf_dir))


@register("top_placeholders", with_views("""
select placeholder, count(*) as count from privacy_audit where placeholder <> ''
group by placeholder order by count desc, placeholder limit 8""", "privacy_audit"))
def q_top_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (fixtures.privacy_audit(spark, sf_dir).where(F.col("placeholder") != "")
            .groupBy("placeholder").agg(F.count("*").alias("count"))
            .orderBy(F.col("count").desc(), "placeholder").limit(8))


@register("audit_kpis", with_views("""
select count(*) as findings, count(*) filter (where confidence > 0.9) as high_confidence,
  count(distinct entity_type) filter (where entity_type <> '') as entity_types
from privacy_audit""", "privacy_audit"))
def q_audit_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-8 + distinct types."""
    a = fixtures.privacy_audit(spark, sf_dir)
    return a.agg(
        F.count("*").alias("findings"),
        F.count_if(F.col("confidence") > 0.9).alias("high_confidence"),
        F.count_distinct(F.when(F.col("entity_type") != "", F.col("entity_type"))).alias("entity_types"),
    )


def audit_filtered(audit: DataFrame, entity_type: str = "", min_confidence: float = 0.0) -> DataFrame:
    """FLT-7: entity type equality (blank = all) and minimum confidence."""
    pred = F.coalesce(F.col("confidence"), F.lit(0.0)) >= min_confidence
    if entity_type:
        pred = pred & (F.col("entity_type") == entity_type)
    return audit.where(pred)


CSV_COLUMNS = ("ticket_id", "stream_id", "entity_type", "placeholder", "confidence", "policy_version",
               "detector_version", "created_at")


@register("audit_filtered", with_views(f"""
select {', '.join(CSV_COLUMNS)}, start_offset from privacy_audit
where coalesce(confidence, 0) >= 0.85 and entity_type = 'PHONE_NUMBER'""", "privacy_audit"))
def q_audit_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filtered(fixtures.privacy_audit(spark, sf_dir), "PHONE_NUMBER", 0.85).select(
        *CSV_COLUMNS, "start_offset")


def write_audit_csv(audit: DataFrame, path: str) -> None:
    """SNK-7: the 8-column export with header, in the reference's column order."""
    audit.select(*CSV_COLUMNS).write.mode("overwrite").option("header", True).csv(path)


@register("audit_csv", with_views(f"select {', '.join(CSV_COLUMNS)} from privacy_audit where coalesce(confidence, 0) >= 0.9",
                                  "privacy_audit"))
def q_audit_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filtered(fixtures.privacy_audit(spark, sf_dir), "", 0.9).select(*CSV_COLUMNS)


@register("audit_recent", with_views("""
select ticket_id, stream_id, entity_type, placeholder, confidence, policy_version, detector_version, created_at, start_offset
from privacy_audit order by created_at desc, ticket_id desc, start_offset desc limit 50""", "privacy_audit"))
def q_audit_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_recent(fixtures.privacy_audit(spark, sf_dir))


def audit_recent(audit: DataFrame, limit: int = 50) -> DataFrame:
    """SRT-3, FLT-11: newest findings (total order: created_at, ticket, offset)."""
    check_bound("limit", limit, 1, 200)
    cols = ("ticket_id", "stream_id", "entity_type", "placeholder", "confidence", "policy_version", "detector_version", "created_at", "start_offset")
    return audit.select(*cols).orderBy(F.col("created_at").desc(), F.col("ticket_id").desc(), F.col("start_offset").desc()).limit(limit)


@register("audit_by_stream", with_views("""
select stream_id, entity_type, placeholder, start_offset,
  row_number() over (partition by stream_id order by created_at, start_offset) as position
from privacy_audit""", "privacy_audit"))
def q_audit_by_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-10/SRT-3 in batch form: every stream's findings oldest first."""
    w = Window.partitionBy("stream_id").orderBy("created_at", "start_offset")
    return fixtures.privacy_audit(spark, sf_dir).select(
        "stream_id", "entity_type", "placeholder", "start_offset", F.row_number().over(w).alias("position"))


@register("ticket_audit_top20", with_views("""
select ticket_id, entity_type, placeholder, start_offset from privacy_audit
qualify row_number() over (partition by ticket_id order by created_at desc, start_offset desc) <= 20""",
                                           "privacy_audit"))
def q_ticket_audit_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-4 part: the 20 newest audit rows of every ticket (WindowGroupLimit)."""
    w = Window.partitionBy("ticket_id").orderBy(F.col("created_at").desc(), F.col("start_offset").desc())
    return (fixtures.privacy_audit(spark, sf_dir)
            .withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= 20)
            .select("ticket_id", "entity_type", "placeholder", "start_offset"))


RECENT_TICKET_VALUES = ("short_description", "category", "assignment_group", "urgency", "impact", "sanitized_text",
                        "resolution", "source")
RECENT_DECISION_VALUES = ("assigned_category", "confidence_score", "retrieval_similarity", "verifier_score",
                          "escalation_required", "route_path", "semantic_cache_hit", "matched_ticket_id",
                          "latency_ms", "sla_risk_score", "sla_risk_level")


def recent_tickets(tickets: DataFrame, decisions: DataFrame, audit: DataFrame, limit: int = 30) -> DataFrame:
    """JOIN-2: latest ticket ⟕ latest decision ⟕ redactions per ticket, newest first."""
    check_bound("limit", limit, 1, 200)
    # The order needs the tickets only: the newest come first, and decisions and findings are
    # read for those. ``top`` has at most 200 rows, so it is broadcast.
    t = latest_tickets(tickets, RECENT_TICKET_VALUES)
    t = t.orderBy(F.col("latest_created_at").desc(), F.col("ticket_id").desc()).limit(limit)
    top = F.broadcast(t.select("ticket_id"))
    d = latest_decisions(decisions.join(top, "ticket_id", "left_semi"), RECENT_DECISION_VALUES)
    d = d.withColumnRenamed("ticket_id", "d_ticket_id")
    p = audit.join(top, "ticket_id", "left_semi")
    p = p.groupBy(F.col("ticket_id").alias("p_ticket_id")).agg(F.count("*").alias("redactions"))
    j = (t.join(d, t.ticket_id == d.d_ticket_id, "left")
         .join(p, t.ticket_id == p.p_ticket_id, "left"))
    return j.select(
        "ticket_id", "short_description", "category", "assignment_group", "urgency", "impact",
        F.col("latest_created_at").alias("created_at"), "sanitized_text", "resolution", "source",
        ticket_status(F.col("d_ticket_id"), F.col("escalation_required"), F.col("semantic_cache_hit")).alias("status"),
        F.coalesce("route_path", F.lit("unrouted")).alias("route_path"),
        F.coalesce("confidence_score", F.lit(0.0)).alias("confidence_score"),
        F.coalesce("escalation_required", F.lit(0)).alias("escalation_required"),
        F.coalesce("semantic_cache_hit", F.lit(0)).alias("semantic_cache_hit"),
        F.coalesce("matched_ticket_id", F.lit("")).alias("matched_ticket_id"),
        F.coalesce("latency_ms", F.lit(0).cast("bigint")).alias("latency_ms"),
        F.coalesce("sla_risk_level", F.lit("")).alias("sla_risk_level"),
        F.coalesce("redactions", F.lit(0).cast("bigint")).alias("redacted_pii_count"),
    ).orderBy(F.col("created_at").desc(), F.col("ticket_id").desc()).limit(limit)


@register("recent_tickets", with_views("""
with lt as (select * from tickets qualify row_number() over (partition by ticket_id order by created_at desc) = 1),
ld as (select * from routing_decisions qualify row_number() over (partition by ticket_id order by created_at desc, event_id desc) = 1),
pc as (select ticket_id, count(*) as redactions from privacy_audit group by ticket_id)
select t.ticket_id, t.short_description, t.category, t.assignment_group, t.urgency, t.impact, t.created_at,
  t.sanitized_text, t.resolution, t.source,
  case when d.ticket_id is null then 'unrouted' when d.escalation_required = 1 then 'human_review_required'
       when d.semantic_cache_hit = 1 then 'semantic_cache_resolved' else 'resolved' end as status,
  coalesce(d.route_path, 'unrouted') as route_path, coalesce(d.confidence_score, 0.0) as confidence_score,
  coalesce(d.escalation_required, 0) as escalation_required, coalesce(d.semantic_cache_hit, 0) as semantic_cache_hit,
  coalesce(d.matched_ticket_id, '') as matched_ticket_id, coalesce(d.latency_ms, 0) as latency_ms,
  coalesce(d.sla_risk_level, '') as sla_risk_level, coalesce(p.redactions, 0) as redacted_pii_count
from lt t left join ld d on t.ticket_id = d.ticket_id left join pc p on t.ticket_id = p.ticket_id
order by t.created_at desc, t.ticket_id desc limit 30""", "tickets", "routing_decisions", "privacy_audit"))
def q_recent_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recent_tickets(fixtures.tickets(spark, sf_dir), fixtures.routing_decisions(spark, sf_dir),
                          fixtures.privacy_audit(spark, sf_dir))


@register("text_hashes", """
select doc_id, sha256(coalesce(text, '')) as raw_sha256, concat('sync_', substring(sha256(coalesce(text, '')), 1, 16)) as stream_id
from documents""")
def q_text_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RED-15/17: SHA-256 of the raw text and the stream id derived from it."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    h = F.sha2(F.col("text"), 256)
    return d.select("doc_id", h.alias("raw_sha256"), F.concat(F.lit("sync_"), F.substring(h, 1, 16)).alias("stream_id"))
