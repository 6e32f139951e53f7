"""Ingest-side jobs: contracts, seed, schema alignment and event publication
(SRC-1..4, SNK-1/4/6/9, ST-2).

Messages and requests are derived from the driver's tables with deliberate defects
(unknown keys, malformed JSON, out-of-range priorities, blank or over-long fields) so
each rule is exercised; validation is a projection, publication a filter + projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import redact as RD
from ..functions import text as T
from ..functions.numeric import where_computed
from ..sources import contracts as C
from ..sources import fixtures
from ..sources.fixtures import EPOCH, with_views
from ..sources.tables import AFTER_FIRST_LINE_SQL, FIRST_LINE_SQL, after_first_line, first_line, padded, padded_sql, read_table, text_rows
from .registry import register
from .text_jobs import _strip

SEED_SOURCE = "6StringNinja/synthetic-servicenow-incidents"


# --- SRC-2: ingest messages ----------------------------------------------------------

def ingest_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = text_rows(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    k = F.col("doc_id") % 10
    body = F.struct(
        F.concat(F.lit("INC"), F.col("doc_id").cast("string")).alias("number"),
        F.when(k == 2, F.lit("   ")).otherwise(first_line(F.col("text"))).alias("short_description"),
        F.when(k == 2, F.lit("")).otherwise(after_first_line(F.col("text"))).alias("description"),
        F.when(k == 3, F.lit(7)).otherwise(1 + F.col("doc_id") % 3).alias("urgency"),
        (F.col("doc_id") % 4).alias("impact"),
        F.when(F.col("doc_id") % 4 == 0, F.col("text")).otherwise(F.lit("")).alias("raw_text"),
        F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")).alias("metadata"),
        F.when(F.col("doc_id") % 8 == 7, F.lit(True)).alias("bypass_redpanda"), F.col("lang").alias("category"),
    )
    text_urgency = F.struct(*[body[f].alias(f) for f in ("number", "short_description", "description")], F.lit("2").alias("urgency"))
    half_urgency = F.struct(*[body[f].alias(f) for f in ("number", "short_description", "description")], F.lit(2.5).alias("urgency"))
    extra = F.struct(*[body[f].alias(f) for f in ("number", "short_description", "description")],
                     F.lit("P1").alias("priority"))
    value = (F.when(k == 0, F.to_json(extra)).when(k == 1, F.concat(F.lit("not json {"), F.col("source")))
             .when(F.col("doc_id") % 20 == 4, F.to_json(text_urgency)).when(F.col("doc_id") % 20 == 5, F.to_json(half_urgency))
             .when(k == 6, F.replace(F.to_json(body), F.lit('"urgency":'), F.lit('"Urgency":')))
             .otherwise(F.to_json(body)))
    created = F.timestamp_add("MINUTE", F.col("doc_id"), F.lit(EPOCH).cast("timestamp_ntz"))
    return d.select("doc_id", value.alias("value"), created.alias("created_at"))


_MSG_SQL = f"""
m as (select doc_id, case when doc_id % 10 = 0 then 'extra' when doc_id % 10 = 1 then 'bad'
          when doc_id % 20 in (4, 5) then 'type' else 'ok' end as kind, coalesce(lang, '') as category, doc_id % 8 = 7 as bypass,
        concat('INC', cast(doc_id as varchar)) as number,
        case when doc_id % 10 = 2 then '   ' else {FIRST_LINE_SQL} end as short_description,
        case when doc_id % 10 = 2 then '' else {AFTER_FIRST_LINE_SQL} end as description,
        case when doc_id % 10 = 3 then 7 else 1 + doc_id % 3 end as urgency, doc_id % 4 as impact,
        case when doc_id % 4 = 0 then text else '' end as raw_text,
        timestamp '{EPOCH}' + to_minutes(cast(doc_id as bigint)) as created_at
      from documents),
v as (select *,
  case when kind = 'ok' and {_strip('raw_text')} <> '' then raw_text
       when kind = 'ok' then {_strip("concat(short_description, chr(10) || chr(10), description)")} end as composed,
  case when kind <> 'ok' then 'invalid JSON payload'
       when (urgency <> 0 and (urgency < 1 or urgency > 3)) or (impact <> 0 and (impact < 1 or impact > 3))
         then 'urgency and impact must be between 1 and 3 when provided'
       when {_strip("case when kind = 'ok' and " + _strip('raw_text') + " <> '' then raw_text else concat(short_description, chr(10) || chr(10), description) end")} = ''
         then 'ticket text is required' end as reject_reason
  from m)
"""


@register("ingest_validate", f"with {_MSG_SQL} select doc_id, reject_reason, composed as raw_text from v")
def q_ingest_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-2: strict decode and range/text checks; rejected rows keep their reason."""
    v = C.validate_ingest(ingest_messages(spark, sf_dir))
    return v.select("doc_id", "reject_reason",
                    F.when(F.col("reject_reason").isNull() | (F.col("reject_reason") != "invalid JSON payload"),
                           F.col("raw_text")).alias("raw_text"))


#: Request fields of the event, in the order of the reference's record.
EVENT_TEXTS = ("number", "short_description", "description")
EVENT_NUMBERS = ("urgency", "impact")
EVENT_MORE = ("category", "assignment_group", "resolution", "raw_text")


def publish_projection(valid: DataFrame) -> DataFrame:
    """SNK-6 + ST-2: (topic, key, value) rows — every valid message that does not bypass the
    broker to ``tickets.sanitized`` keyed by ticket id, and to ``privacy.audit`` keyed by
    stream id when it has at least one finding; values are the JSON envelope. Messages are
    redacted once; an array of the topics of each is exploded."""
    return topic_rows(RD.redact(where_computed(valid, F.expr(f"not {BYPASSED}")), "raw_text"))


#: Whether a message asks not to be published.
BYPASSED = "coalesce(msg.bypass_redpanda, false)"


def topic_rows(red: DataFrame) -> DataFrame:
    """The events of valid messages that are redacted already."""
    msg = F.col("msg")
    ticket_id = F.coalesce(F.when(msg["ticket_id"] != "", msg["ticket_id"]),
                           RD.stable_id("ticket", F.col("raw_text"), F.coalesce(msg["number"], F.lit(""))))
    stream_id = RD.stable_id("stream", F.col("raw_text"), F.col("created_at").cast("string"))
    text = lambda n: F.coalesce(msg[n], F.lit("")).alias(n)
    env = red.withColumn("ticket_id", ticket_id).withColumn("stream_id", stream_id)
    envelope = F.struct(
        F.col("ticket_id"), *[text(n) for n in EVENT_TEXTS],
        *[F.coalesce(msg[n], F.lit(0)).alias(n) for n in EVENT_NUMBERS], *[text(n) for n in EVENT_MORE],
        F.try_parse_json(msg["metadata"]).alias("metadata"),
        F.lit(False).alias("bypass_redpanda"), F.coalesce(msg["return_sanitized"], F.lit(False)).alias("return_sanitized"),
        text("source"), F.col("stream_id"), F.col("raw_sha256"), F.col("sanitized_sha256"), F.col("sanitized_text"),
        F.col("findings"), F.lit(RD.DETECTOR_VERSION).alias("detector_version"), F.lit(RD.POLICY_VERSION).alias("policy_version"),
        F.col("created_at"))
    topics = F.array_compact(F.array(
        F.struct(F.lit("tickets.sanitized").alias("topic"), F.col("ticket_id").alias("key")),
        F.when(F.col("redacted_count") > 0, F.struct(F.lit("privacy.audit").alias("topic"), F.col("stream_id").alias("key")))))
    env = env.select("redacted_count", F.to_json(envelope).alias("value"), topics.alias("topics"))
    # The outer form with a filter: for inline() a filter on the array's size would be inferred
    # below it, which would run the redaction a second time.
    out = env.select("value", "redacted_count", F.inline_outer("topics")).where(F.col("topic").isNotNull())
    return out.select("topic", "key", "value", "redacted_count")


@register("publish_events", f"""
with {_MSG_SQL.strip()},
red as ({fixtures._redaction_sql("select doc_id, composed as text from v where reject_reason is null")}),
ok as (select v.*, r.redacted_count, r.sanitized_sha256, r.raw_sha256 from v
       join red r on r.doc_id = v.doc_id and r.kind = 'doc' where v.reject_reason is null and not v.bypass),
parts as (select *, concat_ws('|', number, short_description, cast(urgency as varchar), cast(impact as varchar), category, raw_text,
            raw_sha256, sanitized_sha256, 'privacy-shield-regex-v1', cast(redacted_count as varchar)) as event from ok)
select 'tickets.sanitized' as topic,
  concat('ticket_', substring(sha256(concat(composed, chr(0), number, chr(0))), 1, 16)) as key, redacted_count, event
from parts
union all
select 'privacy.audit', concat('stream_', substring(sha256(concat(composed, chr(0), cast(created_at as varchar), chr(0))), 1, 16)),
  redacted_count, event
from parts where redacted_count > 0""")
def q_publish_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-6 batch form: the events of the two topics, their values read back from the JSON."""
    valid = C.valid_rows(C.validate_ingest(ingest_messages(spark, sf_dir)))
    got = F.from_json("value", "number string, short_description string, urgency int, impact int, category string, raw_text string, "
                      "raw_sha256 string, sanitized_sha256 string, detector_version string, findings array<struct<placeholder:string>>")
    out = publish_projection(valid).select("topic", "key", "redacted_count", got.alias("e"))
    event = F.concat_ws("|", "e.number", "e.short_description", F.col("e.urgency").cast("string"), F.col("e.impact").cast("string"),
                        "e.category", "e.raw_text", "e.raw_sha256", "e.sanitized_sha256", "e.detector_version",
                        F.size("e.findings").cast("string"))
    return out.select("topic", "key", "redacted_count", event.alias("event"))


# --- SRC-3 / SRC-4: request contracts -------------------------------------------------

def ticket_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fixtures.tickets(spark, sf_dir)
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    t = t.join(d, "doc_id")
    i = F.col("doc_id")
    return t.select(
        "doc_id",
        F.when(i % 9 == 0, F.repeat(F.lit("x"), 130)).otherwise(F.col("ticket_id")).alias("ticket_id"),
        "number",
        F.when(i % 7 == 0, F.lit("   ")).otherwise(
            F.concat(F.lit(" "), first_line(F.col("text")), F.lit(" ")))
        .alias("short_description"),
        F.when(i % 11 == 0, F.col("text")).otherwise(F.col("description")).alias("description"),
        F.when(i % 5 == 4, F.lit(None)).otherwise(i % 5).cast("int").alias("urgency"),
        F.col("impact"), "category", "assignment_group", "resolution",
        F.when(i % 6 == 0, F.lit(None)).when(i % 6 == 1, F.lit("  ")).otherwise(F.col("source")).alias("source"))


def _viol_sql(limits, extra: list[tuple[str, str]] = ()) -> str:
    parts = []
    for name, lo, hi in limits:
        s = _strip(name)
        if lo > 0:
            parts.append(f"case when {name} is null or length({s}) < {lo} then '{name}: at least {lo} characters' end")
            parts.append(f"case when {name} is not null and {s} = '' then '{name}: must not be blank' end")
        parts.append(f"case when {name} is not null and length({s}) > {hi} then '{name}: at most {hi} characters' end")
    parts += [f"case when {cond} then '{msg}' end" for cond, msg in extra]
    return "concat_ws('; ', " + ", ".join(parts) + ")"


_REQ_SQL = """
req as (select t.doc_id, case when t.doc_id % 9 = 0 then repeat('x', 130) else t.ticket_id end as ticket_id, t.number,
  case when t.doc_id % 7 = 0 then '   ' else concat(' ', split_part(d.text, chr(10), 1), ' ') end as short_description,
  case when t.doc_id % 11 = 0 then d.text else t.description end as description,
  cast(case when t.doc_id % 5 = 4 then null else t.doc_id % 5 end as integer) as urgency0, t.impact, t.category,
  t.assignment_group, t.resolution,
  case when t.doc_id % 6 = 0 then null when t.doc_id % 6 = 1 then '  ' else t.source end as source0
  from tickets t join documents d on d.doc_id = t.doc_id),
r2 as (select *, coalesce(urgency0, 3) as urgency, coalesce(source0, 'api') as source from req)
"""


@register("ticket_validate", with_views(f"""
with {_REQ_SQL.strip()}
select doc_id, {_viol_sql(C.TICKET_LIMITS, [('urgency < 1 or urgency > 3', 'urgency: between 1 and 3'),
                                            ('impact < 1 or impact > 3', 'impact: between 1 and 3')])} as violations,
  urgency, impact, {_strip('source')} as source
from r2""", "tickets"))
def q_ticket_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-3 on requests derived from the fixture tickets."""
    v = C.validate_ticket_request(ticket_requests(spark, sf_dir))
    return v.select("doc_id", F.array_join("violations", "; ").alias("violations"), "urgency", "impact", "source")


@register("review_validate", f"""
with rv as (select conv_id, turn,
  case when conv_id % 9 = 0 then '' else concat('DOC-', {padded_sql('conv_id', 6)}) end as ticket_id,
  case when turn % 4 = 0 then '  ' else role end as decision, concat('rev-', cast(conv_id as varchar)) as reviewer,
  text as notes, case when turn % 5 = 0 then repeat('c', 130) else '' end as corrected_category,
  '' as corrected_assignment_group, '' as corrected_resolution from conversations)
select conv_id, turn, {_viol_sql(C.REVIEW_LIMITS)} as violations from rv""")
def q_review_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-4 on review submissions derived from conversation turns."""
    c = read_table(spark, sf_dir, "conversations")
    r = c.select(
        "conv_id", "turn",
        F.when(F.col("conv_id") % 9 == 0, F.lit("")).otherwise(
            F.concat(F.lit("DOC-"), padded(F.col("conv_id"), 6))).alias("ticket_id"),
        F.when(F.col("turn") % 4 == 0, F.lit("  ")).otherwise(F.col("role")).alias("decision"),
        F.concat(F.lit("rev-"), F.col("conv_id").cast("string")).alias("reviewer"), F.col("text").alias("notes"),
        F.when(F.col("turn") % 5 == 0, F.repeat(F.lit("c"), 130)).otherwise(F.lit("")).alias("corrected_category"),
        F.lit("").alias("corrected_assignment_group"), F.lit("").alias("corrected_resolution"))
    return C.validate_review(r).select("conv_id", "turn", F.array_join("violations", "; ").alias("violations"))


@register("request_extra_fields", """
select conv_id, turn, case when turn % 3 = 0 then 'priority' when turn % 3 = 1 then 'Notes,zone' else '' end as extra from conversations""")
def q_request_extra_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-3/4: request fields outside the contract, which reject a request."""
    c = read_table(spark, sf_dir, "conversations").withColumn("m", F.col("turn") % 3)
    none = F.lit(None).cast("string")
    value = F.to_json(F.struct(
        F.col("conv_id").cast("string").alias("ticket_id"), F.col("role").alias("decision"), F.coalesce("text", F.lit("")).alias("notes"),
        F.when(F.col("m") == 0, "P1").otherwise(none).alias("priority"), F.when(F.col("m") == 1, "n").otherwise(none).alias("Notes"),
        F.when(F.col("m") == 1, "z").otherwise(none).alias("zone")))
    return c.select("conv_id", "turn", F.array_join(C.extra_fields(value, C.REVIEW_LIMITS), ",").alias("extra"))


# --- SNK-9: schema alignment -----------------------------------------------------------

@register("schema_align", with_views("""
select ticket_id, assigned_category, suggested_resolution, confidence_score, classification_confidence,
  retrieval_similarity, verifier_score, privacy_risk, escalation_required, route_path, semantic_cache_hit,
  matched_ticket_id, 0.0::double as sla_risk_score, '' as sla_risk_level, '' as resolver_group,
  0.0::double as resolver_confidence, 0 as knowledge_gap, '' as knowledge_gap_reason,
  coalesce(case when event_id % 3 = 0 then route_path end, '') as route_explanation, model_name,
  latency_ms, created_at
from routing_decisions""", "routing_decisions"))
def q_schema_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-9: decision rows written before the 7 operational columns existed (one of them
    present but NULL) aligned to the current schema with its defaults."""
    d = fixtures.routing_decisions(spark, sf_dir).drop(*[c for c in C.DECISION_DEFAULTS if c != "route_explanation"])
    d = d.withColumn("route_explanation", F.when(F.col("event_id") % 3 == 0, F.col("route_path")))
    return C.align_schema(d)


# --- SRC-1: seed job --------------------------------------------------------------------

def seed_records(rows: DataFrame, source: str = SEED_SOURCE, limit: int | None = None) -> DataFrame:
    """SRC-1: incident rows → redacted ticket records (ticket id = number; display fields
    from the sanitized text, Q23). ``limit`` keeps the first rows as the reference's
    paging does."""
    if limit is not None:
        rows = rows.limit(limit)
    r = rows.withColumn("raw_text", F.concat(F.col("short_description"), F.lit("\n\n"), F.col("description")))
    r = RD.redact(r, "raw_text")
    sp = T.split_display(F.col("sanitized_text"))
    return r.select(
        F.col("number").alias("ticket_id"), "number", sp["short_description"].alias("short_description"),
        sp["description"].alias("description"), "sanitized_text", "category", "assignment_group", "resolution",
        F.col("urgency").cast("int").alias("urgency"), F.col("impact").cast("int").alias("impact"),
        F.lit(source).alias("source"))


@register("seed_tickets", with_views(f"""
with red as ({fixtures._redaction_sql("select doc_id, concat(short_description, chr(10) || chr(10), description) as text from tickets")}),
s as (select t.*, r.sanitized_text as san, {_strip('r.sanitized_text')} as st from tickets t join red r on r.doc_id = t.doc_id and r.kind = 'doc')
select number as ticket_id, number,
  case when st <> '' and strpos(st, chr(10) || chr(10)) > 0 then {_strip("substring(st, 1, strpos(st, chr(10) || chr(10)) - 1)")} end as short_description,
  case when st <> '' and strpos(st, chr(10) || chr(10)) > 0 then {_strip("substring(st, strpos(st, chr(10) || chr(10)) + 2)")} end as description,
  san as sanitized_text, category, assignment_group, resolution, urgency, impact, '{SEED_SOURCE}' as source
from s""", "tickets"))
def q_seed_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fixtures.tickets(spark, sf_dir).select("number", "short_description", "description", "category",
                                                "assignment_group", "resolution", "urgency", "impact")
    return seed_records(t)


def append(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """SNK-1/SNK-4: append-only write in one pass (an empty batch adds no rows). Sorted within
    partitions by the reference's sort key prefix so row groups prune point lookups."""
    w = df.sortWithinPartitions(*[c for c in ("ticket_id", "created_at") if c in df.columns]).write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def review_rows(df: DataFrame) -> DataFrame:
    """SNK-4: a review event with a fresh id and '' for missing optional fields."""
    opt = ("notes", "corrected_category", "corrected_assignment_group", "corrected_resolution")
    return df.select(F.expr("uuid()").alias("review_id"), "ticket_id", "decision", "reviewer",
                     *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in opt],
                     F.coalesce(F.col("created_at"), F.current_timestamp()).alias("created_at")
                     if "created_at" in df.columns else F.current_timestamp().alias("created_at"))


@register("pipeline_metrics", f"""
with {_MSG_SQL.strip()},
red as ({fixtures._redaction_sql("select doc_id, composed as text from v where reject_reason is null")})
select count(*) filter (where reject_reason is null) as processed,
  coalesce(sum(r.redacted_count) filter (where reject_reason is null), 0) as redacted_entities,
  count(*) filter (where reject_reason is not null) as errors
from v left join red r on r.doc_id = v.doc_id and r.kind = 'doc'""")
def q_pipeline_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-29 / ST-6: the ingest service's counters for a batch of messages."""
    v = RD.redact(C.validate_ingest(ingest_messages(spark, sf_dir)).withColumn(
        "raw_text", F.when(F.col("reject_reason").isNull(), F.col("raw_text"))), "raw_text")
    ok = F.col("reject_reason").isNull()
    return v.agg(F.count_if(ok).alias("processed"),
                 F.coalesce(F.sum(F.when(ok, F.col("redacted_count"))), F.lit(0)).cast("bigint").alias("redacted_entities"),
                 F.count_if(~ok).alias("errors"))
