"""The four fact tables of the ticket pipeline, derived from the driver's tables.

``tickets`` ← documents, ``routing_decisions`` ← events, ``review_events`` ←
conversations; ``privacy_audit`` is the exploded output of the redaction job over
``documents`` (see :mod:`tixspark.functions.redact`). Every derivation is a narrow
projection (no shuffle), so a query's cost grows with the driver tables.

``FIXTURE_SQL`` holds the same views in ANSI SQL for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import risk_level
from .tables import FIRST_LINE_SQL, first_line, padded, padded_sql, read_table, text_rows

EPOCH = "2024-01-01 00:00:00"


def _ticket_key(col: Column) -> Column:
    return F.concat(F.lit("DOC-"), padded(col, 6))


def _ratio(col: Column, mult: int, mod: int, div: float) -> Column:
    return ((col * mult) % mod).cast("double") / F.lit(div)


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    m11 = F.col("doc_id") % 11
    m10 = F.col("doc_id") % 10
    return d.select(
        _ticket_key(F.col("doc_id")).alias("ticket_id"),
        F.col("doc_id"),
        F.concat(F.lit("INC"), padded(F.col("doc_id"), 7)).alias("number"),
        first_line(F.col("text")).alias("short_description"),
        F.col("text").alias("description"),
        F.col("text").alias("sanitized_text"),
        F.when(F.col("lang") == "en", "Software")
        .when(F.col("lang") == "fr", "Network")
        .when(F.col("lang") == "de", "Database")
        .otherwise("Access")
        .alias("category"),
        F.when(m11 == 0, "Pending Review")
        .when(m11 < 5, "Network Ops")
        .when(m11 < 8, "DBA Team")
        .otherwise("IT Support")
        .alias("assignment_group"),
        F.when(F.col("doc_id") % 13 == 0, "")
        .otherwise(F.concat(F.lit("Apply runbook "), (F.col("doc_id") % 17).cast("string")))
        .alias("resolution"),
        (1 + F.col("doc_id") % 3).cast("int").alias("urgency"),
        (1 + (F.col("doc_id") % 7) % 3).cast("int").alias("impact"),
        F.when(m10 < 6, "curated").when(m10 < 8, "historical").otherwise("api").alias("source"),
        F.timestamp_add("MINUTE", F.col("doc_id"), F.lit(EPOCH).cast("timestamp_ntz")).alias("created_at"),
    )


def tickets_with_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tickets ⟕ embeddings on vec_id = doc_id; a missing vector is an empty array."""
    e = read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("embedding").alias("_emb")
    )
    return (
        tickets(spark, sf_dir)
        .join(e, "doc_id", "left")
        .withColumn("embedding", F.coalesce(F.col("_emb"), F.array().cast("array<float>")))
        .drop("_emb")
    )


GAP_REASON = "stored RAG evidence is weak for this category"
RESOLVERS = ("", "Network Ops", "DBA Team", "Payments Engineering", "Security Operations", "Application Operations")
CATEGORIES = ("Application", "Network", "Database", "Access Management", "Security")


def routing_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    eid = F.col("event_id")
    sla = F.when(eid % 4 == 0, F.lit(0.0)).otherwise(_ratio(eid, 61, 1000, 1000.0))
    resolver = F.element_at(F.array(*[F.lit(x) for x in RESOLVERS]), (eid % 6 + 1).cast("int"))
    category = F.element_at(F.array(*[F.lit(x) for x in CATEGORIES]), (eid % 5 + 1).cast("int"))
    return e.select(
        eid.alias("event_id"),
        _ticket_key(F.col("user_id")).alias("ticket_id"),
        category.alias("assigned_category"),
        F.when(F.col("event_type") == "purchase", "semantic_cache")
        .when(F.col("event_type") == "error", "human_review_required")
        .otherwise("generative_rag")
        .alias("route_path"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("escalation_required"),
        F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("semantic_cache_hit"),
        _ratio(eid, 37, 1000, 1000.0).alias("confidence_score"),
        _ratio(eid, 43, 1000, 1000.0).alias("classification_confidence"),
        _ratio(eid, 53, 1000, 1000.0).alias("retrieval_similarity"),
        _ratio(eid, 71, 1000, 1000.0).alias("verifier_score"),
        _ratio(eid, 29, 96, 100.0).alias("privacy_risk"),
        F.floor(F.col("value") * 10).cast("bigint").alias("latency_ms"),
        F.when(eid % 4 == 0, "").otherwise(_ticket_key(eid % 2000)).alias("matched_ticket_id"),
        sla.alias("sla_risk_score"),
        F.when(sla == 0, "").otherwise(risk_level(sla)).alias("sla_risk_level"),
        resolver.alias("resolver_group"),
        F.when(eid % 5 == 0, F.lit(0.0)).otherwise(_ratio(eid, 17, 1000, 1000.0)).alias("resolver_confidence"),
        F.when(eid % 9 == 0, 1).otherwise(0).alias("knowledge_gap"),
        F.when(eid % 9 == 0, GAP_REASON).otherwise("").alias("knowledge_gap_reason"),
        F.concat(
            F.lit("Check service health for "), F.col("event_type"), F.lit("\n"),
            F.lit("Apply runbook "), (eid % 17).cast("string"),
        ).alias("suggested_resolution"),
        F.lit("deterministic-fallback").alias("model_name"),
        F.col("ts").alias("created_at"),
    )


REVIEW_DECISIONS = ("approve", "corrected", "reject", "misrouted", "accepted", "wrong_category")


def review_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "conversations")
    idx = ((F.col("conv_id") + F.col("turn")) % len(REVIEW_DECISIONS) + 1).cast("int")
    return c.select(
        F.concat(F.lit("REV-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias(
            "review_id"
        ),
        _ticket_key(F.col("conv_id")).alias("ticket_id"),
        F.element_at(F.array(*[F.lit(x) for x in REVIEW_DECISIONS]), idx).alias("decision"),
        F.col("role").alias("reviewer"),
        F.col("text").alias("notes"),
        F.when(F.col("role") == "assistant", "Network").otherwise("").alias("corrected_category"),
        F.lit("").alias("corrected_assignment_group"),
        F.lit("").alias("corrected_resolution"),
        F.timestamp_add(
            "MINUTE", F.col("conv_id") * 60 + F.col("turn"), F.lit(EPOCH).cast("timestamp_ntz")
        ).alias("created_at"),
    )


# ---------------------------------------------------------------------------
# The same views for the DuckDB oracle (ANSI SQL; DuckDB list/regex functions).
# ---------------------------------------------------------------------------

_KEY = f"concat('DOC-', {padded_sql('{c}', 6)})"

FIXTURE_SQL = {
    "tickets": f"""
select {_KEY.format(c='doc_id')} as ticket_id, doc_id,
  concat('INC', {padded_sql('doc_id', 7)}) as number,
  {FIRST_LINE_SQL} as short_description,
  text as description,
  text as sanitized_text,
  case lang when 'en' then 'Software' when 'fr' then 'Network' when 'de' then 'Database' else 'Access' end as category,
  case when doc_id % 11 = 0 then 'Pending Review' when doc_id % 11 < 5 then 'Network Ops'
       when doc_id % 11 < 8 then 'DBA Team' else 'IT Support' end as assignment_group,
  case when doc_id % 13 = 0 then '' else concat('Apply runbook ', cast(doc_id % 17 as varchar)) end as resolution,
  cast(1 + doc_id % 3 as integer) as urgency,
  cast(1 + (doc_id % 7) % 3 as integer) as impact,
  case when doc_id % 10 < 6 then 'curated' when doc_id % 10 < 8 then 'historical' else 'api' end as source,
  timestamp '{EPOCH}' + to_minutes(cast(doc_id as bigint)) as created_at
from documents""",
    "routing_decisions": f"""
select event_id, {_KEY.format(c='user_id')} as ticket_id,
  ['Application','Network','Database','Access Management','Security'][cast(event_id % 5 + 1 as integer)] as assigned_category,
  case event_type when 'purchase' then 'semantic_cache' when 'error' then 'human_review_required' else 'generative_rag' end as route_path,
  case when event_type = 'error' then 1 else 0 end as escalation_required,
  case when event_type = 'purchase' then 1 else 0 end as semantic_cache_hit,
  cast(event_id * 37 % 1000 as double) / 1000.0 as confidence_score,
  cast(event_id * 43 % 1000 as double) / 1000.0 as classification_confidence,
  cast(event_id * 53 % 1000 as double) / 1000.0 as retrieval_similarity,
  cast(event_id * 71 % 1000 as double) / 1000.0 as verifier_score,
  cast(event_id * 29 % 96 as double) / 100.0 as privacy_risk,
  cast(floor(value * 10) as bigint) as latency_ms,
  case when event_id % 4 = 0 then '' else {_KEY.format(c='event_id % 2000')} end as matched_ticket_id,
  case when event_id % 4 = 0 then 0.0 else cast(event_id * 61 % 1000 as double) / 1000.0 end as sla_risk_score,
  case when event_id % 4 = 0 then ''
       when cast(event_id * 61 % 1000 as double) / 1000.0 >= 0.75 then 'critical'
       when cast(event_id * 61 % 1000 as double) / 1000.0 >= 0.55 then 'elevated'
       when cast(event_id * 61 % 1000 as double) / 1000.0 >= 0.35 then 'watch' else 'normal' end as sla_risk_level,
  ['','Network Ops','DBA Team','Payments Engineering','Security Operations','Application Operations'][cast(event_id % 6 + 1 as integer)] as resolver_group,
  case when event_id % 5 = 0 then 0.0 else cast(event_id * 17 % 1000 as double) / 1000.0 end as resolver_confidence,
  case when event_id % 9 = 0 then 1 else 0 end as knowledge_gap,
  case when event_id % 9 = 0 then '{GAP_REASON}' else '' end as knowledge_gap_reason,
  concat('Check service health for ', event_type, chr(10), 'Apply runbook ', cast(event_id % 17 as varchar)) as suggested_resolution,
  'deterministic-fallback' as model_name,
  ts as created_at
from events""",
    "review_events": f"""
select concat('REV-', cast(conv_id as varchar), '-', cast(turn as varchar)) as review_id,
  {_KEY.format(c='conv_id')} as ticket_id,
  ['approve','corrected','reject','misrouted','accepted','wrong_category'][cast((conv_id + turn) % 6 + 1 as integer)] as decision,
  role as reviewer,
  text as notes,
  case when role = 'assistant' then 'Network' else '' end as corrected_category,
  '' as corrected_assignment_group,
  '' as corrected_resolution,
  timestamp '{EPOCH}' + to_minutes(cast(conv_id * 60 + turn as bigint)) as created_at
from conversations""",
}


VIEW_DEPS = {"redacted_docs": ("redaction",), "privacy_audit": ("redaction", "redacted_docs")}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the named fixture views (and their dependencies) as CTEs."""
    ordered: list[str] = []
    for n in names:
        for dep in (*VIEW_DEPS.get(n, ()), n):
            if dep not in ordered:
                ordered.append(dep)
    ctes = ",\n".join(f"{n} as ({FIXTURE_SQL[n]}\n)" for n in ordered)
    body = sql.strip()
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"


def _redaction_sql(docs_sql: str) -> str:
    """DuckDB rendering of the redaction rules over ``docs(doc_id, text)``: one row per
    kept finding plus, per document, the sanitized text (recursive greedy fold)."""
    from ..functions.redact import DETECTORS

    vals = ",\n".join(
        f"({i}, '{t}', cast({c} as double), '{p.replace(chr(39), chr(39) * 2)}')"
        for i, (t, c, p) in enumerate(DETECTORS, 1)
    )
    return f"""
with recursive det(o, t, c, rx) as (values {vals}),
docs as ({docs_sql}),
m as (select d.doc_id, det.o, det.t, det.c, regexp_extract_all(d.text, det.rx, 0) as ms, d.text, det.rx
      from docs d cross join det),
u as (select doc_id, o, t, c, unnest(ms) as mt, unnest(regexp_split_to_array(text, rx)[1:len(ms)]) as g,
             unnest(generate_series(1, len(ms))) as j
      from m where len(ms) > 0),
p as (select doc_id, o, t, c,
        cast(sum(length(g) + length(mt)) over (partition by doc_id, o order by j rows between unbounded preceding and current row) - length(mt) as integer) as s,
        cast(sum(length(g) + length(mt)) over (partition by doc_id, o order by j rows between unbounded preceding and current row) as integer) as e
      from u),
q as (select *, row_number() over (partition by doc_id order by s, e desc, o) as rn from p),
kept(doc_id, rn, e) as (
  select doc_id, rn, e from q where rn = 1
  union all
  select k.doc_id, n.rn, n.e from kept k,
    lateral (select q.rn, q.e from q where q.doc_id = k.doc_id and q.rn > k.rn and q.s >= k.e order by q.rn limit 1) n
),
f as (
  select q.doc_id, q.t as entity_type,
    concat('[', q.t, '_', cast(row_number() over (partition by q.doc_id, q.t order by q.s) as varchar), ']') as placeholder,
    q.c as confidence, cast(q.s as bigint) as start_offset, cast(q.e as bigint) as end_offset
  from q join kept using (doc_id, rn)
),
fs as (
  select f.*, coalesce(lag(end_offset) over (partition by doc_id order by start_offset), 0) as prev_end from f
),
san as (
  select d.doc_id, d.text,
    coalesce(string_agg(concat(substring(d.text, cast(fs.prev_end as integer) + 1, cast(fs.start_offset - fs.prev_end as integer)), fs.placeholder), '' order by fs.start_offset), '')
    || substring(d.text, cast(coalesce(max(fs.end_offset), 0) as integer) + 1) as sanitized_text,
    count(fs.doc_id) as redacted_count
  from docs d left join fs on d.doc_id = fs.doc_id
  group by d.doc_id, d.text
)
select 'finding' as kind, f.doc_id, f.entity_type, f.placeholder, f.confidence, f.start_offset, f.end_offset,
       cast(null as varchar) as sanitized_text, cast(null as varchar) as raw_sha256,
       cast(null as varchar) as sanitized_sha256, cast(null as bigint) as redacted_count
from f
union all
select 'doc', doc_id, cast(null as varchar), cast(null as varchar), cast(null as double), cast(null as bigint),
       cast(null as bigint), sanitized_text, sha256(text), sha256(sanitized_text), redacted_count
from san
"""


DOCS_SQL = "select doc_id, coalesce(text, '') as text from documents"
FIXTURE_SQL["redaction"] = _redaction_sql(DOCS_SQL)
FIXTURE_SQL["redacted_docs"] = """
select doc_id, sanitized_text, raw_sha256, sanitized_sha256, redacted_count from redaction where kind = 'doc'"""
FIXTURE_SQL["privacy_audit"] = f"""
select concat('sync_', substring(r.raw_sha256, 1, 16)) as stream_id, {_KEY.format(c='f.doc_id')} as ticket_id,
  r.raw_sha256, r.sanitized_sha256, 'privacy-shield-regex-v1' as detector_version,
  'enterprise-ticket-policy-v1' as policy_version, f.entity_type, f.placeholder, f.confidence,
  f.start_offset, f.end_offset, timestamp '{EPOCH}' + to_minutes(cast(f.doc_id as bigint)) as created_at
from redaction f join redacted_docs r on f.doc_id = r.doc_id
where f.kind = 'finding'"""


def redacted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents → redaction columns (sanitized text, findings, hashes, count)."""
    from ..functions.redact import redact

    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return redact(text_rows(docs), "text")


def audit_rows(redacted: DataFrame, ticket_id: Column, stream_id: Column, created_at: Column,
               detector_version: str | None = None, policy_version: str | None = None,
               with_id: bool = False) -> DataFrame:
    """SNK-2: one audit row per finding (documents without findings yield none)."""
    from ..functions import redact as R

    cols = [
        stream_id.alias("stream_id"), ticket_id.alias("ticket_id"), F.col("raw_sha256"), F.col("sanitized_sha256"),
        F.lit(detector_version or R.DETECTOR_VERSION).alias("detector_version"),
        F.lit(policy_version or R.POLICY_VERSION).alias("policy_version"),
        F.col("_f.entity_type").alias("entity_type"), F.col("_f.placeholder").alias("placeholder"),
        F.col("_f.confidence").alias("confidence"), F.col("_f.start_offset").alias("start_offset"),
        F.col("_f.end_offset").alias("end_offset"), created_at.alias("created_at"),
    ]
    if with_id:
        cols.insert(0, F.expr("uuid()").alias("audit_id"))
    # explode_outer + a filter on the generated column: a plain explode would make the
    # optimizer infer size(findings) > 0 below the generator and re-run the regex scan.
    exploded = redacted.select("*", F.explode_outer("findings").alias("_f")).where(F.col("_f").isNotNull())
    return exploded.select(*cols)


def privacy_audit(spark: SparkSession, sf_dir: str, with_id: bool = False) -> DataFrame:
    red = redacted_documents(spark, sf_dir)
    return audit_rows(
        red,
        ticket_id=_ticket_key(F.col("doc_id")),
        stream_id=F.concat(F.lit("sync_"), F.substring("raw_sha256", 1, 16)),
        created_at=F.timestamp_add("MINUTE", F.col("doc_id"), F.lit(EPOCH).cast("timestamp_ntz")),
        with_id=with_id,
    )
