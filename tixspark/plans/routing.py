"""Batch routing over the fixture tickets (SCR-20 and its stages).

Incoming requests are the fixture tickets whose source is 'api' (never approved
knowledge); the approved corpus is every other eligible ticket with the hashed
embedding of its sanitized text. Exact duplicate documents produce semantic-cache hits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import pyround
from ..functions.vectors import embed_text, embed_text_md5
from ..operators.route import decision_records, prepare_corpus, route_tickets, ticket_records
from ..settings import DEFAULT
from ..sources import fixtures
from .registry import register


def incoming_requests(tickets: DataFrame) -> DataFrame:
    return tickets.where(F.col("source") == "api").select(
        "ticket_id", "number", "short_description", "description", "urgency", "impact",
        F.lit("").alias("assignment_group"))


def routed_fixture(spark: SparkSession, sf_dir: str, embed_fn=embed_text) -> DataFrame:
    t = fixtures.tickets(spark, sf_dir)
    corpus = prepare_corpus(t, DEFAULT, embed_fn=embed_fn)
    return route_tickets(incoming_requests(t), corpus, DEFAULT, routed_at="2024-02-01 00:00:00", embed_fn=embed_fn)


@register("route_tickets")
def q_route_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCR-20 end to end: the stored decision rows of a routed batch."""
    return decision_records(routed_fixture(spark, sf_dir))


@register("store_routed")
def q_store_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-5: the ticket rows a routed batch appends."""
    return ticket_records(routed_fixture(spark, sf_dir)).drop("embedding")


# ---------------------------------------------------------------------------
# Stage keys with SQL oracles: retrieval of the driver's vectors against the
# approved fixture tickets (dim 64), then the in-row scoring of each stage.
# ---------------------------------------------------------------------------

from ..functions import rules as R  # noqa: E402
from ..functions import scoring as S  # noqa: E402
from ..operators.topk import topk_similar  # noqa: E402
from ..settings import FIXTURE  # noqa: E402
from ..sources.fixtures import with_views  # noqa: E402
from ..sources.tables import read_table  # noqa: E402
from .common import latest_tickets  # noqa: E402
from .text_jobs import _CAT_MAP_SQL, _strip, _title_sql  # noqa: E402
from .vectors import approved_knowledge  # noqa: E402


def retrieved_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id (= vec_id) → retrieved array (k = 5) over the approved fixture corpus."""
    e = read_table(spark, sf_dir, "embeddings")
    corpus = approved_knowledge(fixtures.tickets_with_embedding(spark, sf_dir), FIXTURE).select(
        "ticket_id", "embedding", "created_at", "category", "assignment_group", "resolution", "source")
    hits = topk_similar(e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding")),
                        corpus, FIXTURE.rag_top_k, carry=("category", "assignment_group", "resolution", "source"),
                        fast_threshold=FIXTURE.fast_path_similarity_threshold)
    return hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(
        "rank", "ticket_id", "similarity", "category", "assignment_group", "resolution", "source", "created_at"
    ))).alias("retrieved"))


def _norm_cat_sql(c: str) -> str:
    k = _strip(c)
    return f"coalesce({_CAT_MAP_SQL.replace('lower(k)', f'lower({k})')}, case when {k} <> '' then {_title_sql(k)} end, 'Application')"


_RETRIEVAL_SQL = f"""
c as (select t.ticket_id, t.created_at, t.category, t.assignment_group, t.resolution, t.source, e.embedding
      from tickets t join embeddings e on e.vec_id = t.doc_id
      where len(e.embedding) = 64 and t.source in ('6StringNinja/synthetic-servicenow-incidents', 'curated', 'historical', 'seed')
        and t.assignment_group <> 'Pending Review' and {_strip('t.resolution')} <> ''),
p as (select q.vec_id as query_id, c.ticket_id, c.created_at, c.category, c.assignment_group, c.resolution, c.source,
        list_cosine_similarity(cast(q.embedding as double[]), cast(c.embedding as double[])) as s
      from embeddings q cross join c),
r as (select *, row_number() over (partition by query_id order by (s >= 0.95) desc, s desc, created_at, ticket_id) as rank
      from p qualify rank <= 5),
rn as (select *, {_norm_cat_sql('category')} as ncat, greatest(s, 0.0) as w, greatest(0.0, least(1.0, s)) as cs from r),
stats as (select query_id, max(cs) filter (where rank = 1) as top, avg(cs) as av, avg(cs) filter (where rank <= 3) as top3,
            avg(case when {_strip('resolution')} <> '' then 1.0 else 0.0 end) as cov, count(*) as n,
            bool_or(s >= 0.95) as has_fast from rn group by query_id),
cv as (select query_id, ncat, sum(w) as wt, min(rank) as first_rank from rn group by query_id, ncat),
cw as (select query_id, ncat as dominant_category, wt / case when sum(wt) over (partition by query_id) = 0 then 1.0
            else sum(wt) over (partition by query_id) end as consensus
       from cv qualify row_number() over (partition by query_id order by wt desc, first_rank) = 1),
ev as (select s.query_id, s.top, s.av, s.top3, s.cov, s.n, s.has_fast, cw.dominant_category, cw.consensus,
         round(greatest(0.0, least(1.0, 0.45 * s.top + 0.20 * s.top3 + 0.20 * cw.consensus + 0.15 * s.cov)), 4) as quality,
         case when s.has_fast and s.top >= 0.95 then 'cache_ready'
              when s.top >= 0.7 and cw.consensus >= 0.45 and s.cov >= 0.80 then 'strong'
              when s.top >= 0.50 and s.cov >= 0.50 then 'usable' else 'weak' end as band
       from stats s join cw using (query_id))
"""


def _stage_sql(body: str) -> str:
    return with_views(f"with {_RETRIEVAL_SQL} {body}", "tickets")


@register("evidence_quality", _stage_sql("""
select query_id, round(top, 4) as top_similarity, round(av, 4) as average_similarity, round(top3, 4) as top3_average,
  round(cov, 4) as resolution_coverage, cast(n as integer) as evidence_count, dominant_category,
  round(consensus, 4) as category_consensus, quality as quality_score, band as quality_band from ev"""))
def q_evidence_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-24/26 + SCR-1/2: evidence statistics, category consensus, quality and band."""
    r = retrieved_lists(spark, sf_dir)
    ev = S.rag_evidence(F.col("retrieved"), S.fast_path_match(F.col("retrieved"), FIXTURE), FIXTURE)
    return r.select("query_id", ev["top_similarity"].alias("top_similarity"),
                    ev["average_similarity"].alias("average_similarity"), ev["top3_average"].alias("top3_average"),
                    ev["resolution_coverage"].alias("resolution_coverage"), ev["evidence_count"].alias("evidence_count"),
                    ev["dominant_category"].alias("dominant_category"),
                    ev["category_consensus"].alias("category_consensus"), ev["quality_score"].alias("quality_score"),
                    ev["quality_band"].alias("quality_band"))


@register("evidence_items", _stage_sql("""
select query_id, cast(rank as integer) as rank, ticket_id, ncat as category, assignment_group, source,
  round(s, 4) as similarity,
  case when s >= 0.95 and ticket_id = first_value(ticket_id) over (partition by query_id order by (s >= 0.95) desc, rank)
       and s >= 0.95 then 'cache_candidate' else 'supporting_context' end as evidence_role,
  {res} <> '' as resolution_present
from rn""".replace("{res}", _strip("resolution"))))
def q_evidence_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCR-3: per-item roles (the fast-path match is the cache candidate)."""
    return evidence_rows(retrieved_lists(spark, sf_dir))


def evidence_rows(r: DataFrame) -> DataFrame:
    """A row per item of ``retrieved``."""
    ev = S.rag_evidence(F.col("retrieved"), S.fast_path_match(F.col("retrieved"), FIXTURE), FIXTURE)
    x = r.select("query_id", F.posexplode(ev["items"]).alias("pos", "it"))
    return x.select("query_id", (F.col("pos") + 1).alias("rank"), "it.ticket_id", "it.category", "it.assignment_group",
                    "it.source", "it.similarity", "it.evidence_role", "it.resolution_present")


@register("triage", _stage_sql(f"""
, tv as (select query_id, category, sum(w) as wt, min(rank) as first_rank from rn group by query_id, category),
tw as (select query_id, category, wt / case when sum(wt) over (partition by query_id) = 0 then 1.0
         else sum(wt) over (partition by query_id) end as share
       from tv qualify row_number() over (partition by query_id order by wt desc, first_rank) = 1)
select query_id, {_norm_cat_sql('category')} as category, round(greatest(0.35, least(0.98, share)), 4) as confidence from tw"""))
def q_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCR-4: vote on the raw retrieved categories, winner normalised, share clamped."""
    r = retrieved_lists(spark, sf_dir)
    t = S.triage(F.col("retrieved"), R.keyword_category(F.lit("")))
    return r.select("query_id", t["category"].alias("category"), t["confidence"].alias("confidence"))


@register("resolver_vote", _stage_sql("""
, gv as (select query_id, assignment_group as g, sum(w) as wt, min(rank) as first_rank from rn
         where assignment_group <> '' and assignment_group not in ('Pending Review', 'IT Support') group by query_id, assignment_group),
gr as (select *, row_number() over (partition by query_id order by wt desc, first_rank) as pos,
         sum(wt) over (partition by query_id) as total from gv)
select query_id, max(g) filter (where pos = 1) as "group",
  round(greatest(0.0, least(1.0, max(wt) filter (where pos = 1) / case when max(total) = 0 then 1.0 else max(total) end)), 4) as confidence,
  coalesce(string_agg(g, ',' order by pos) filter (where pos between 2 and 4), '') as alternates
from gr group by query_id"""))
def q_resolver_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-25 + WIN-8 + SCR-7 (consensus branch): winner, confidence, 3 alternates."""
    r = retrieved_lists(spark, sf_dir)
    rec = S.resolver_recommendation(F.col("retrieved"), F.lit(""), F.lit(""), F.lit(""), F.lit(0.0))
    return r.where(rec["source"] == "retrieval_consensus").select(
        "query_id", rec["group"].alias("group"), rec["confidence"].alias("confidence"),
        F.array_join(rec["alternates"], ",").alias("alternates"))


@register("fast_path_match", _stage_sql("""
select query_id, ticket_id as matched_ticket_id, round(s, 6) as similarity from rn
where s >= 0.95 qualify row_number() over (partition by query_id order by rank) = 1"""))
def q_fast_path_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-2: first eligible retrieved row at/above the cache threshold."""
    r = retrieved_lists(spark, sf_dir)
    m = S.fast_path_match(F.col("retrieved"), FIXTURE)
    return r.where(m.isNotNull()).select("query_id", m["ticket_id"].alias("matched_ticket_id"),
                                         pyround(m["similarity"], 6).alias("similarity"))


@register("fast_path_decisions", _stage_sql(f"""
select query_id, ticket_id as matched_ticket_id, {_norm_cat_sql('category')} as assigned_category, resolution as suggested_resolution,
  1.0::double as classification_confidence, round(s, 4) as retrieval_similarity, 1.0::double as verifier_score,
  round(greatest(0.0, least(1.0, 0.99 - (query_id % 20) / 20.0 * 0.15)), 4) as confidence_score, 0 as escalation_required,
  'semantic_cache' as route_path, 1 as semantic_cache_hit from rn
where s >= 0.95 qualify row_number() over (partition by query_id order by rank) = 1"""))
def q_fast_path_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCR-14: the decision of tickets that the semantic cache answers (privacy risks are taken from the ids)."""
    r = retrieved_lists(spark, sf_dir).withColumn("privacy_risk", (F.col("query_id") % 20) / 20.0)
    r = r.withColumn("m", S.fast_path_match(F.col("retrieved"), FIXTURE)).where(F.col("m").isNotNull())
    return fast_path_decisions(r).drop("privacy_risk")


def fast_path_decisions(matched: DataFrame) -> DataFrame:
    """SCR-14: ``matched`` has the cache hit ``m`` and privacy_risk."""
    one = F.lit(1.0)
    return matched.select(
        "query_id", F.col("m.ticket_id").alias("matched_ticket_id"), R.normalize_category(F.col("m.category")).alias("assigned_category"),
        F.col("m.resolution").alias("suggested_resolution"), one.alias("classification_confidence"),
        pyround(F.col("m.similarity"), 4).alias("retrieval_similarity"), one.alias("verifier_score"),
        pyround(S.clamp01(0.99 - F.col("privacy_risk") * 0.15), 4).alias("confidence_score"), F.lit(0).alias("escalation_required"),
        F.lit("semantic_cache").alias("route_path"), F.lit(1).alias("semantic_cache_hit"), "privacy_risk")


def _ev_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence per query joined with the query's own fixture ticket (doc_id = vec_id)."""
    r = retrieved_lists(spark, sf_dir)
    fast = S.fast_path_match(F.col("retrieved"), FIXTURE)
    r = r.withColumn("fast_match", fast).withColumn("ev", S.rag_evidence(F.col("retrieved"), fast, FIXTURE))
    t = fixtures.tickets(spark, sf_dir).select(F.col("doc_id").alias("query_id"), "sanitized_text", "description",
                                               "urgency", "impact")
    return r.join(t, "query_id")


_EV_TICKET_SQL = """
, tk as (select doc_id as query_id, sanitized_text, description, urgency, impact from tickets),
e2 as (select ev.*, tk.sanitized_text, tk.description, tk.urgency, tk.impact,
         round(coalesce((select max(s) filter (where rank = 1) from r where r.query_id = ev.query_id), 0), 4) as sim
       from ev join tk using (query_id))
"""


def _review_reason_sql(san: str, raw: str) -> str:
    from .text_jobs import _any, _q, _security_sql
    return (f"case when urgency = 1 or impact = 1 then {_q(R.REASON_CRITICAL)} "
            f"when {_security_sql('lower(' + raw + ')')} <> '' then {_q(R.REASON_CREDENTIAL)} "
            f"when {_any('lower(' + san + ')', R.OUT_OF_SCOPE_TERMS)} then {_q(R.REASON_SCOPE)} "
            f"when {_any('lower(' + san + ')', R.HIGH_RISK_TERMS)} then {_q(R.REASON_RISK)} end")


@register("decision_fallback", _stage_sql(_EV_TICKET_SQL + f"""
, d as (select e2.*, {_review_reason_sql('sanitized_text', 'description')} as reason,
          (select ticket_id from r where r.query_id = e2.query_id and rank = 1) as top_id,
          (select resolution from r where r.query_id = e2.query_id and rank = 1) as top_res
        from e2)
select query_id, reason is not null as escalation_required,
  case when reason is not null then cast(0.42 as double) when top_id is not null and {_strip("top_res")} <> '' then cast(0.62 as double) else cast(0.58 as double) end as confidence,
  case when reason is not null then ['Route this ticket to human support triage: ' || reason,
        '{S.ESCALATION_STEP_2}', '{S.ESCALATION_STEP_3}']
       else ['Classify as ' || dominant_category || ' and compare with similar incident ' || top_id || '.', top_res,
             '{S.VALIDATE_STEP}'] end as steps
from d"""))
def q_decision_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCR-15 + CLS-3: the deterministic decision for each query ticket (category = the
    evidence's dominant category; every query here has retrieved evidence)."""
    f = _ev_frame(spark, sf_dir)
    sec = R.security_findings(F.col("description"))
    reason = R.review_reason(F.col("sanitized_text"), F.col("urgency"), F.col("impact"), sec)
    d = S.fallback_decision(F.col("ev.dominant_category"), F.col("retrieved"), reason)
    return f.select("query_id", d["escalation_required"].alias("escalation_required"),
                    d["confidence"].alias("confidence"), d["steps"].alias("steps"))


@register("knowledge_gap_signal", _stage_sql(_EV_TICKET_SQL + f"""
, d as (select e2.*, {_review_reason_sql('sanitized_text', 'description')} as reason from e2),
v as (select *, case when reason is not null then 0.42 else 0.62 end as verifier,
        case when reason is not null then 'human_review_required' else 'generative_rag' end as route from d)
select query_id,
  case when band in ('none', 'weak') then 1 when verifier < 0.70 and route = 'generative_rag' then 1 else 0 end as is_gap,
  case when band in ('none', 'weak') then 'RAG evidence quality is ' || band || '; LLM must treat retrieved context as low-confidence support'
       when verifier < 0.70 and route = 'generative_rag' then '{S.GAP_VERIFIER}' else '{S.GAP_NONE}' end as reason,
  case when band in ('none', 'weak') then (case when band = 'none' or sim < 0.50 then 'critical' else 'elevated' end)
       when verifier < 0.70 and route = 'generative_rag' then 'elevated' else 'normal' end as severity
from v"""))
def q_knowledge_gap_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCR-8 with the fallback decision's verifier and route."""
    f = _ev_frame(spark, sf_dir)
    sec = R.security_findings(F.col("description"))
    reason = R.review_reason(F.col("sanitized_text"), F.col("urgency"), F.col("impact"), sec)
    verifier = F.when(reason.isNotNull(), 0.42).otherwise(0.62)
    route = F.when(reason.isNotNull(), "human_review_required").otherwise("generative_rag")
    sim = F.coalesce(pyround(F.get("retrieved", 0)["similarity"], 4), F.lit(0.0))
    g = S.knowledge_gap_signal(F.col("ev.quality_band"), sim, verifier, route)
    return f.select("query_id", g["is_gap"].cast("int").alias("is_gap"), g["reason"].alias("reason"),
                    g["severity"].alias("severity"))


@register("sla_risk_routing", with_views("""
select event_id, cast(1 + event_id % 3 as integer) as urgency, cast(1 + event_id % 2 as integer) as impact,
  round(greatest(0.0, least(1.0,
    0.45 * (cast((4 - (1 + event_id % 3)) + (4 - (1 + event_id % 2)) as double) / 6.0)
    + 0.25 * (1.0 - greatest(0.0, least(1.0, confidence_score)))
    + 0.15 * (greatest(0.0, 0.7 - retrieval_similarity) / 0.7)
    + 0.10 * (greatest(0.0, 0.70 - case when verifier_score = 0 then 0.70 else verifier_score end) / 0.70)
    + 0.05 * privacy_risk + case when escalation_required = 1 then 0.15 else 0.0 end)), 4) as sla_risk_score
from routing_decisions""", "routing_decisions"))
def q_sla_risk_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCR-9 on stored decision scores with priorities derived from the event id."""
    d = fixtures.routing_decisions(spark, sf_dir)
    u = (1 + F.col("event_id") % 3).cast("int")
    i = (1 + F.col("event_id") % 2).cast("int")
    s = S.sla_risk_routing(u, i, F.col("confidence_score"), F.col("retrieval_similarity"), F.col("verifier_score"),
                           F.col("privacy_risk"), F.col("escalation_required") == 1)
    return d.select("event_id", u.alias("urgency"), i.alias("impact"), s["score"].alias("sla_risk_score"))


@register("sla_risk_estimate", with_views("""
select event_id, s as sla_risk_score,
  case when s >= 0.75 then 'critical' when s >= 0.55 then 'elevated' when s >= 0.35 then 'watch' else 'normal' end as sla_risk_level
from (select event_id, round(greatest(0.0, least(1.0,
    0.45 * (cast((4 - (1 + event_id % 3)) + (4 - (1 + event_id % 2)) as double) / 6.0)
    + 0.25 * (1.0 - greatest(0.0, least(1.0, confidence_score)))
    + 0.15 * (greatest(0.0, 0.7 - retrieval_similarity) / 0.7)
    + 0.10 * (greatest(0.0, 0.70 - verifier_score) / 0.70)
    + 0.05 * privacy_risk + case when escalation_required = 1 then 0.15 else 0.0 end)), 4) as s from routing_decisions)""",
                                           "routing_decisions"))
def q_sla_risk_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCR-10/11: the read-time estimate (a verifier of 0 stays 0, Q15) and its level."""
    from .common import risk_level

    d = fixtures.routing_decisions(spark, sf_dir)
    s = S.sla_pressure((1 + F.col("event_id") % 3), (1 + F.col("event_id") % 2), F.col("confidence_score"),
                          F.col("retrieval_similarity"), F.col("verifier_score"), F.col("privacy_risk"),
                          F.col("escalation_required") == 1, 0.70)
    return d.select("event_id", s.alias("sla_risk_score"), risk_level(s).alias("sla_risk_level"))


@register("final_confidence", with_views("""
select event_id, round(greatest(0.0, least(1.0, 0.35 * classification_confidence + 0.35 * greatest(0.0, least(1.0, verifier_score))
  + 0.20 * greatest(0.0, retrieval_similarity)
  + 0.10 * case when privacy_risk >= 0.35 then 0.40 when privacy_risk > 0.15 then 0.70 else 1.0 end)), 4) as confidence_score,
  round(greatest(0.0, least(1.0, 0.99 - privacy_risk * 0.15)), 4) as cache_confidence
from routing_decisions""", "routing_decisions"))
def q_final_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCR-13 (decision path; the verifier column stands in for evidence quality) and the
    SCR-14 cache-path confidence, over stored decision components."""
    d = fixtures.routing_decisions(spark, sf_dir)
    c = S.final_confidence(F.col("classification_confidence"), F.col("verifier_score"),
                           F.col("retrieval_similarity"), R.risk_modifier(F.col("privacy_risk")))
    cache = pyround(S.clamp01(0.99 - F.col("privacy_risk") * 0.15), 4)
    return d.select("event_id", c.alias("confidence_score"), cache.alias("cache_confidence"))


@register("grounding_score", _stage_sql("""
select query_id, cast(case when top >= 0.35 then 0.72 else 0.45 end as double) as verifier_score,
  cast(case when top >= 0.50 then 0.70 else 0.42 end as double) as verifier_fallback_score from ev"""))
def q_grounding_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCR-19 (steps are always present after a decision)."""
    r = retrieved_lists(spark, sf_dir)
    top = F.get("retrieved", 0)["similarity"]
    return r.select("query_id", S.grounding_score(top, F.lit(True)).alias("verifier_score"),
                    S.grounding_score(top, F.lit(True), failure=True).alias("verifier_fallback_score"))


def _with_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieved lists with each item's sanitized text (joined by ticket id after the
    top-k, so only k rows per query travel)."""
    r = retrieved_lists(spark, sf_dir)
    items = r.select("query_id", F.posexplode("retrieved").alias("pos", "it"))
    texts = latest_tickets(fixtures.tickets(spark, sf_dir), ("sanitized_text",)).select(
        F.col("ticket_id").alias("tid"), "sanitized_text")
    j = items.join(texts, F.col("it.ticket_id") == F.col("tid"), "left")
    return j.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col("it.rank").alias("rank"), F.col("it.ticket_id").alias("ticket_id"),
        F.col("it.similarity").alias("similarity"), F.col("it.category").alias("category"),
        F.col("it.resolution").alias("resolution"), F.coalesce("sanitized_text", F.lit("")).alias("sanitized_text"))))
        .alias("retrieved"))


@register("context_pack")
def q_context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-7 + WIN-6 (rows): the model context of each query's ranked tickets within
    the item (5) and character (12,000 / 8,000) budgets."""
    r = _with_context(spark, sf_dir)
    return r.select("query_id",
                    S.context_pack(F.col("retrieved"), DEFAULT.llm_max_context_items,
                                   DEFAULT.llm_max_context_chars).alias("context"),
                    S.context_pack(F.col("retrieved"), DEFAULT.llm_max_context_items, 8000,
                                   resolutions_only=True).alias("resolution_context"))


@register("evidence_summary")
def q_evidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-6 (rows): compact JSON of each evidence pack."""
    r = retrieved_lists(spark, sf_dir)
    ev = S.rag_evidence(F.col("retrieved"), S.fast_path_match(F.col("retrieved"), FIXTURE), FIXTURE)
    return r.select("query_id", S.evidence_summary(ev).alias("summary"))


@register("auto_resolve")
def q_auto_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCR-16 (rows): the auto-resolve override for model decisions parsed from
    conversation turns (policy signal, priorities and risk from the turn's text)."""
    from ..functions import text as TX
    from .text_jobs import _model_payloads

    p = _model_payloads(spark, sf_dir)
    c = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    j = p.join(c, ["conv_id", "turn"])
    d = TX.model_decision(F.col("payload"))
    sec = R.security_findings(F.col("text"))
    urgency = (1 + F.col("conv_id") % 3).cast("int")
    impact = (1 + F.col("turn") % 3).cast("int")
    reason = R.review_reason(F.col("text"), urgency, impact, sec)
    risk = R.privacy_risk(F.array().cast("array<struct<entity_type:string>>"), F.lit(0), sec)
    auto = S.should_auto_resolve(d, reason, urgency, impact, risk, sec)
    return j.select("conv_id", "turn", auto.alias("auto_resolved"))


# ---------------------------------------------------------------------------
# The whole workflow with the MD5 embedding, which SQL can follow.
# ---------------------------------------------------------------------------


def _routed_sql(select: str) -> str:
    from ..sources.fixtures import _redaction_sql
    from .text_jobs import _any, _q, _security_sql

    weight = (f"case when upper(entity_type) in ({', '.join(map(_q, R.SENSITIVE_ENTITIES))}) then 0.35 "
              f"when upper(entity_type) in ({', '.join(map(_q, R.PERSONAL_ENTITIES))}) then 0.10 else 0.05 end")
    vectors = """
  select {id} as id, unnest(regexp_extract_all(lower(sanitized_text), '[a-z0-9_./:-]+', 0)) as tok from {rows}"""
    tail = _RETRIEVAL_SQL[_RETRIEVAL_SQL.index("rn as (") :]
    defaults = " ".join(f"when {_q(c)} then {_q(g)}" for c, g in S.RESOLVER_DEFAULTS)
    excluded = ", ".join(map(_q, S.VOTE_EXCLUDED_GROUPS))
    return with_views(f"""
with req as (select doc_id, ticket_id, number, short_description, description, urgency, impact,
    concat(short_description, chr(10) || chr(10), description) as raw from tickets where source = 'api'),
red as ({_redaction_sql("select doc_id, raw as text from req")}),
rq0 as (select q.*, d.sanitized_text, d.redacted_count, {_security_sql("lower(q.raw)")} as sec,
    coalesce((select max({weight}) from red f where f.kind = 'finding' and f.doc_id = q.doc_id), 0.0) as entity
  from req q join red d on d.doc_id = q.doc_id and d.kind = 'doc'),
rq as (select *, round(least(0.95::double, greatest(entity::double, case when sec <> '' then 0.35 else 0.0 end::double) + least(0.20::double, redacted_count * 0.04::double)), 4) as pr,
    {_review_reason_sql("sanitized_text", "raw")} as reason from rq0),
c as (select ticket_id, created_at, category, assignment_group, resolution, source, sanitized_text from tickets
  where source in ('6StringNinja/synthetic-servicenow-incidents', 'curated', 'historical', 'seed')
    and assignment_group <> 'Pending Review' and {_strip('resolution')} <> ''),
tok as ({vectors.format(id="'q' || cast(doc_id as varchar)", rows="rq")} union all {vectors.format(id="ticket_id", rows="c")}),
slot as (select id, cast(('0x' || substring(md5(tok), 1, 8))::bigint % 384 as integer) as idx,
    case when ('0x' || substring(md5(tok), 9, 2))::integer % 2 = 1 then 1 else -1 end as sgn from tok),
v as (select id, idx, sum(sgn) as x from slot group by id, idx having sum(sgn) <> 0),
nv as (select id, sum(x * x) as n from v group by id),
dots as (select a.id as qid, b.id as tid, sum(a.x * b.x) as d from v a join v b on a.idx = b.idx where a.id like 'q%' and b.id not like 'q%' group by 1, 2),
p as (select q.doc_id as query_id, c.ticket_id, c.created_at, c.category, c.assignment_group, c.resolution, c.source,
    case when nq.n is not null and nc.n is not null then coalesce(d.d, 0) / (sqrt(nq.n) * sqrt(nc.n)) end as s
  from rq q cross join c left join nv nq on nq.id = 'q' || cast(q.doc_id as varchar) left join nv nc on nc.id = c.ticket_id
    left join dots d on d.qid = nq.id and d.tid = c.ticket_id),
r as (select *, row_number() over (partition by query_id order by coalesce(s >= 0.95, false) desc, round(s, 12) desc nulls last, created_at, ticket_id) as rank
  from p qualify rank <= 5),
{tail},
tv as (select query_id, category, sum(w) as wt, min(rank) as first_rank from rn group by query_id, category),
tw as (select query_id, category, wt / case when sum(wt) over (partition by query_id) = 0 then 1.0 else sum(wt) over (partition by query_id) end as share
  from tv qualify row_number() over (partition by query_id order by wt desc, first_rank) = 1),
gv as (select query_id, assignment_group as g, sum(w) as wt, min(rank) as first_rank from rn where assignment_group <> '' and assignment_group not in ({excluded})
  group by query_id, assignment_group),
gw as (select query_id, g, wt, sum(wt) over (partition by query_id) as total from gv qualify row_number() over (partition by query_id order by wt desc, first_rank) = 1),
a as (select rq.*, ev.quality, ev.band, coalesce(round(t.s, 4), 0.0) as sim, t.ticket_id as top_id, t.resolution as top_res, coalesce(t.s >= 0.95, false) as cache,
    case when coalesce(t.s >= 0.95, false) then t.ncat else {_norm_cat_sql('tw.category')} end as assigned,
    case when coalesce(t.s >= 0.95, false) then 1.0::double else round(greatest(0.35, least(0.98, tw.share)), 4) end as classification, gw.g as vote, gw.wt, gw.total
  from rq join ev on ev.query_id = rq.doc_id join rn t on t.query_id = rq.doc_id and t.rank = 1 join tw on tw.query_id = rq.doc_id left join gw on gw.query_id = rq.doc_id),
b as (select *, not cache and reason is not null as esc, cast(case when cache then 1.0 when reason is not null then 0.42 when {_strip('top_res')} <> '' then 0.62 else 0.58 end as double) as verifier,
    case when cache then top_res when reason is not null then 'Route this ticket to human support triage: ' || reason || chr(10) || {_q(S.ESCALATION_STEP_2)} || chr(10) || {_q(S.ESCALATION_STEP_3)}
      else 'Classify as ' || assigned || ' and compare with similar incident ' || top_id || '.' || chr(10) || top_res || chr(10) || {_q(S.VALIDATE_STEP)} end as steps,
    case when cache then round(greatest(0.0, least(1.0, 0.99 - pr * 0.15)), 4)
      else round(greatest(0.0, least(1.0, 0.35 * classification + 0.35 * greatest(0.0, least(1.0, quality)) + 0.20 * greatest(0.0, sim)
        + 0.10 * case when pr >= 0.35 then 0.40 when pr > 0.15 then 0.70 else 1.0 end)), 4) end as conf,
    case when cache then 'semantic_cache' when reason is not null then 'human_review_required' else 'generative_rag' end as route,
    case when cache then 'Application' else assigned end as rcat, lower(raw) || chr(10) || lower(sanitized_text) as both_texts from a),
d as (select *, round(greatest(0.0, least(1.0, 0.45 * ((8 - urgency - impact) / 6.0) + 0.25 * (1.0 - greatest(0.0, least(1.0, conf)))
      + 0.15 * (greatest(0.0, 0.7 - sim) / 0.7) + 0.10 * (greatest(0.0, 0.70 - verifier) / 0.70) + 0.05 * pr + case when esc then 0.15 else 0.0 end)), 4) as sla,
    coalesce(vote, case when rcat = 'Application' and {_any('both_texts', S.PAYMENT_TERMS)} then 'Payments Engineering'
      when pr >= 0.35 and rcat = 'Security' then 'Security Operations' else coalesce(case rcat {defaults} end, 'Application Operations') end) as rgroup,
    case when band in ('none', 'weak') then 1 when not cache and verifier < 0.70 and route = 'generative_rag' then 1 else 0 end as gap from b)
{select}""", "tickets")


@register("route_tickets_md5", _routed_sql(f"""
select ticket_id, assigned as assigned_category, steps as suggested_resolution, conf as confidence_score, classification as classification_confidence,
  sim as retrieval_similarity, verifier as verifier_score, pr as privacy_risk, cast(esc as integer) as escalation_required, route as route_path,
  cast(cache as integer) as semantic_cache_hit, top_id as matched_ticket_id, sla as sla_risk_score,
  case when sla >= 0.75 then 'critical' when sla >= 0.55 then 'elevated' when sla >= 0.35 then 'watch' else 'normal' end as sla_risk_level,
  rgroup as resolver_group, case when vote is not null then round(greatest(0.0, least(1.0, wt / case when total = 0 then 1.0 else total end)), 4)
    when rgroup <> 'IT Support' then 0.62::double else 0.45::double end as resolver_confidence, gap as knowledge_gap,
  case when band in ('none', 'weak') then 'RAG evidence quality is ' || band || '; LLM must treat retrieved context as low-confidence support'
    when gap = 1 then '{S.GAP_VERIFIER}' else '{S.GAP_NONE}' end as knowledge_gap_reason from d"""))
def q_route_tickets_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCR-20, SNK-3: the stored decisions of a routed batch, without the nine explanation rows and constants."""
    routed = decision_records(routed_fixture(spark, sf_dir, embed_text_md5))
    return routed.drop("route_explanation", "model_name", "latency_ms", "created_at")


def _display_sql() -> str:
    """The routed rows with their display fields: split at the first blank line, else each field redacted on its own."""
    from ..sources.fixtures import _redaction_sql

    return f"""
, rs as (select doc_id, sanitized_text as t from ({_redaction_sql("select doc_id, short_description as text from req")}) where kind = 'doc'),
rd as (select doc_id, sanitized_text as t from ({_redaction_sql("select doc_id, description as text from req")}) where kind = 'doc'),
z as (select d.*, rs.t as short_alone, rd.t as description_alone, {_strip('d.sanitized_text')} as st from d join rs using (doc_id) join rd using (doc_id))
select ticket_id, coalesce(nullif(number, ''), ticket_id) as number,
  case when st <> '' and strpos(st, chr(10) || chr(10)) > 0 then {_strip("substring(st, 1, strpos(st, chr(10) || chr(10)) - 1)")} else short_alone end as short_description,
  case when st <> '' and strpos(st, chr(10) || chr(10)) > 0 then {_strip("substring(st, strpos(st, chr(10) || chr(10)) + 2)")} else description_alone end as description,
  sanitized_text, assigned as category, 'Pending Review' as assignment_group, steps as resolution, urgency, impact, 'api' as source,
  timestamp '2024-02-01 00:00:00' as created_at from z"""


@register("store_routed_md5", _routed_sql(_display_sql()))
def q_store_routed_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-5: the ticket rows that a routed batch appends, without their embedding."""
    return ticket_records(routed_fixture(spark, sf_dir, embed_text_md5), embed_fn=embed_text_md5).drop("embedding")


# --- TXT-7, WIN-6: the context pack in SQL -------------------------------------------------


def _pack_sql(chunk: str, budget: int) -> str:
    from .text_jobs import _clip

    return f"""
  select query_id, cast(0 as bigint) as rank, cast({budget} as bigint) as remaining, false as done, cast([] as varchar[]) as chunks from (select distinct query_id from it)
  union all
  select k.query_id, i.rank, case when k.done or x.c = '' then k.remaining else k.remaining - length(x.c) end, k.done or x.c = '',
    case when k.done or x.c = '' then k.chunks else list_append(k.chunks, x.c) end
  from {{name}} k join it i on i.query_id = k.query_id and i.rank = k.rank + 1,
    lateral (select {_clip(chunk, 'greatest(k.remaining, 0)')} as c) x"""


_PAST = ("concat('Past ticket ', i.ticket_id, ' (', i.category, ', score=', printf('%.2f', round(i.s, 2)), '):', chr(10), 'Symptoms: ', i.body, chr(10), 'Resolution: ', i.resolution)")


@register("context_pack_budget", _stage_sql(f"""
, it as (select rn.query_id, rn.rank, rn.ticket_id, rn.category, rn.s, rn.resolution, coalesce(t.sanitized_text, '') as body from rn left join tickets t on t.ticket_id = rn.ticket_id),
k1 as ({_pack_sql(_PAST, DEFAULT.llm_max_context_chars).format(name='k1')}),
k2 as ({_pack_sql("concat(i.ticket_id, ': ', i.resolution)", 8000).format(name='k2')}),
z1 as (select query_id, chunks from k1 qualify row_number() over (partition by query_id order by rank desc) = 1),
z2 as (select query_id, chunks from k2 qualify row_number() over (partition by query_id order by rank desc) = 1)
select query_id, array_to_string(z1.chunks, chr(10) || chr(10)) as context, array_to_string(z2.chunks, chr(10) || chr(10)) as resolution_context
from z1 join z2 using (query_id)""").replace("with ", "with recursive ", 1))
def q_context_pack_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-7 + WIN-6: both context packs of every query within their budgets."""
    return q_context_pack(spark, sf_dir)
