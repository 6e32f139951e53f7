"""Evaluation jobs (JOIN-7/8/9, AGG-27/28, SCR-21, SET-1..3, FLT-13, SRC-5, SNK-8).

The reference evaluates generated ticket sets against a live service. Here the cases
come from the given tables (re-aimed, see README): expected labels from ``labels``
(toxic → policy case, low quality → out-of-scope case), difficulty from document
length, and the actual outcome is the latest stored decision per ticket. Every job is
a join of the cases with the latest decisions (one shuffle on ``ticket_id``) and a
small grouped aggregate; ``rollup`` adds the overall row.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import pyround
from ..sources import fixtures
from ..sources.fixtures import with_views
from ..sources.tables import first_line, padded, padded_sql, read_table
from .common import latest_decisions, latest_tickets, spread_key
from .registry import register

def _key(number: Column | None = None) -> Column:
    return F.concat(F.lit("DOC-"), padded(F.col("doc_id") if number is None else number, 6))


def eval_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One labelled case per ``labels`` row, with difficulty and cohort expectations."""
    lab = read_table(spark, sf_dir, "labels")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "n_chars", first_line(F.col("text"))
                                                         .alias("short_description"))
    c = lab.join(docs, "doc_id")
    cohort = (F.when(F.col("toxic") == 1, "policy_human").when(F.col("quality") == 0, "ood_human")
              .when(F.col("doc_id") % 5 == 0, "similar_cache").otherwise("unique_in_domain"))
    difficulty = F.when(F.col("n_chars") < 1000, "easy").when(F.col("n_chars") < 5000, "medium").otherwise("hard")
    even = F.col("doc_id") % 10 == 0
    return c.select(
        "doc_id", _key().alias("ticket_id"), difficulty.alias("difficulty"), cohort.alias("cohort"), "short_description",
        ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("expected_escalation_required"),
    ).withColumn("expected_route_path", F.when(F.col("cohort").isin("policy_human", "ood_human"),
                                               "human_review_required")
                 .when(F.col("cohort") == "similar_cache", "semantic_cache")) \
        .withColumn("expected_semantic_cache_hit", F.col("cohort") == "similar_cache") \
        .withColumn("expected_matched_ticket_id", F.when((F.col("cohort") == "similar_cache") & even, _key((F.col("doc_id") * 7) % 2000))) \
        .drop("doc_id").withColumn("decision_label", F.when(F.col("cohort") == "unique_in_domain", F.lit(None).cast("boolean"))
                    .otherwise(F.col("expected_escalation_required")))


_KEY_SQL = f"concat('DOC-', {padded_sql('{c}', 6)})"

_CASES_SQL = """
cases as (
  select """ + _KEY_SQL.format(c="l.doc_id") + """ as ticket_id,
    case when d.n_chars < 1000 then 'easy' when d.n_chars < 5000 then 'medium' else 'hard' end as difficulty,
    case when l.toxic = 1 then 'policy_human' when l.quality = 0 then 'ood_human'
         when l.doc_id % 5 = 0 then 'similar_cache' else 'unique_in_domain' end as cohort,
    split_part(d.text, chr(10), 1) as short_description,
    (l.toxic = 1 or l.quality = 0) as expected_escalation_required,
    case when l.toxic = 0 and l.quality <> 0 and l.doc_id % 10 = 0 then """ + _KEY_SQL.format(c="(l.doc_id * 7) % 2000") + """ end as expected_matched_ticket_id
  from labels l join documents d on d.doc_id = l.doc_id),
ld as (select * from routing_decisions qualify row_number() over (partition by ticket_id order by created_at desc, event_id desc) = 1),
lt as (select ticket_id from tickets group by ticket_id),
joined as (
  select c.*, coalesce(d.escalation_required = 1, true) as actual_escalation_required,
    coalesce(d.route_path, 'error') as route_path, coalesce(d.latency_ms, 0) as latency_ms,
    coalesce(d.semantic_cache_hit = 1, false) as semantic_cache_hit, nullif(d.matched_ticket_id, '') as matched_ticket_id,
    d.confidence_score, d.retrieval_similarity, d.verifier_score,
    (nullif(d.matched_ticket_id, '') is null or (o.ticket_id is not null and m.ticket_id is not distinct from d.matched_ticket_id)) as attachment_ok,
    (c.expected_matched_ticket_id is null or c.expected_matched_ticket_id is not distinct from d.matched_ticket_id) as match_ok
  from cases c left join ld d on d.ticket_id = c.ticket_id left join lt m on m.ticket_id = nullif(d.matched_ticket_id, '')
    left join lt o on o.ticket_id = c.ticket_id)
"""


def eval_joined(cases: DataFrame, decisions: DataFrame, tickets: DataFrame) -> DataFrame:
    """JOIN-7 + JOIN-8: expected ⟕ actual; a missing decision counts as route 'error',
    escalated, latency 0. The attachment check asks that the ticket's detail exists and that both
    its matched ticket and its routing record name the ticket matched; ``match_ok`` that it is the expected one."""
    d = latest_decisions(decisions, ("escalation_required", "route_path", "latency_ms", "semantic_cache_hit",
                                     "matched_ticket_id", "confidence_score", "retrieval_similarity",
                                     "verifier_score")).withColumnRenamed("ticket_id", "d_id")
    present = latest_tickets(tickets, ("number", "short_description")).select(F.col("ticket_id").alias("m_id"))
    cases = cases.join(present.withColumnRenamed("m_id", "o_id"), F.col("ticket_id") == F.col("o_id"), "left")
    j = cases.join(d, cases.ticket_id == d.d_id, "left")
    matched = F.when(F.col("matched_ticket_id") != "", F.col("matched_ticket_id"))
    j = j.withColumn("matched_ticket_id", matched).join(present, spread_key(F.col("matched_ticket_id"), F.col("ticket_id")) == F.col("m_id"), "left")
    return j.select(
        *[c for c in cases.columns if c != "o_id"],
        F.coalesce(F.col("escalation_required") == 1, F.lit(True)).alias("actual_escalation_required"),
        F.coalesce("route_path", F.lit("error")).alias("route_path"),
        F.coalesce("latency_ms", F.lit(0).cast("bigint")).alias("latency_ms"),
        F.coalesce(F.col("semantic_cache_hit") == 1, F.lit(False)).alias("semantic_cache_hit"),
        "matched_ticket_id", "confidence_score", "retrieval_similarity", "verifier_score",
        (F.col("matched_ticket_id").isNull() | (F.col("o_id").isNotNull() & F.col("m_id").eqNullSafe(F.col("matched_ticket_id")))).alias("attachment_ok"),
        (F.col("expected_matched_ticket_id").isNull() | F.col("expected_matched_ticket_id").eqNullSafe(F.col("matched_ticket_id"))).alias("match_ok"),
    )


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eval_joined(eval_cases(spark, sf_dir), fixtures.routing_decisions(spark, sf_dir),
                       fixtures.tickets(spark, sf_dir))


_JOINED_COLS = ("ticket_id, difficulty, cohort, expected_escalation_required, actual_escalation_required, route_path, "
                "latency_ms, semantic_cache_hit, matched_ticket_id, attachment_ok")


def _eval_sql(body: str) -> str:
    return with_views(f"with {_CASES_SQL} {body}", "tickets", "routing_decisions")


@register("eval_joined", _eval_sql(f"select {_JOINED_COLS} from joined"))
def q_eval_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(spark, sf_dir).select(*[c.strip() for c in _JOINED_COLS.split(",")])


def _ratio(num: Column, den: Column, nd: int = 4) -> Column:
    return F.when(den > 0, pyround(num.cast("double") / den, nd)).otherwise(F.lit(0.0))


def by_difficulty(joined: DataFrame) -> DataFrame:
    """AGG-27: per difficulty and overall ('all', via rollup): totals, accuracy,
    expected/actual escalations, mean latency."""
    correct = (F.col("actual_escalation_required") == F.col("expected_escalation_required")).cast("int")
    g = joined.rollup("difficulty").agg(
        F.count("*").alias("total"), F.sum(correct).alias("correct"),
        F.sum(F.col("expected_escalation_required").cast("int")).alias("expected_escalations"),
        F.sum(F.col("actual_escalation_required").cast("int")).alias("actual_escalations"),
        F.sum("latency_ms").alias("_lat"))
    return g.select(F.coalesce("difficulty", F.lit("all")).alias("difficulty"), "total", "correct",
                    _ratio(F.col("correct"), F.col("total")).alias("decision_accuracy"), "expected_escalations",
                    "actual_escalations", _ratio(F.col("_lat"), F.col("total"), 1).alias("average_latency_ms"))


@register("eval_by_difficulty", _eval_sql("""
select coalesce(difficulty, 'all') as difficulty, count(*) as total,
  sum(cast(actual_escalation_required = expected_escalation_required as integer)) as correct,
  case when count(*) > 0 then round(sum(cast(actual_escalation_required = expected_escalation_required as integer)) / count(*), 4) else 0.0 end as decision_accuracy,
  sum(cast(expected_escalation_required as integer)) as expected_escalations,
  sum(cast(actual_escalation_required as integer)) as actual_escalations,
  case when count(*) > 0 then round(sum(latency_ms) / count(*), 1) else 0.0 end as average_latency_ms
from joined group by rollup (difficulty)"""))
def q_eval_by_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_difficulty(_joined(spark, sf_dir))


@register("eval_route_counts", _eval_sql("select route_path, count(*) as count from joined group by route_path"))
def q_eval_route_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(spark, sf_dir).groupBy("route_path").agg(F.count("*").alias("count"))


@register("eval_failures", _eval_sql("""
select ticket_id, difficulty, expected_escalation_required, actual_escalation_required, route_path, short_description
from joined where actual_escalation_required <> expected_escalation_required"""))
def q_eval_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _joined(spark, sf_dir)
    return j.where(F.col("actual_escalation_required") != F.col("expected_escalation_required")).select(
        "ticket_id", "difficulty", "expected_escalation_required", "actual_escalation_required", "route_path",
        "short_description")


def case_flags(joined: DataFrame) -> DataFrame:
    """SCR-21: per-case decision, route, cache, attachment and strict flags."""
    required = F.col("decision_label").isNotNull()
    decision_ok = ~required | (F.col("actual_escalation_required") == F.col("decision_label"))
    route_ok = F.col("expected_route_path").isNull() | (F.col("route_path") == F.col("expected_route_path"))
    cache_ok = (F.col("semantic_cache_hit") == F.col("expected_semantic_cache_hit")) & F.col("match_ok")
    strict = F.col("cohort").isin("ood_human", "policy_human")
    return joined.select(
        "ticket_id", "cohort", required.alias("decision_required"), decision_ok.alias("decision_ok"),
        route_ok.alias("route_ok"), cache_ok.alias("cache_ok"), F.col("attachment_ok"),
        (decision_ok & route_ok & cache_ok & F.col("attachment_ok")).alias("case_ok"),
        (F.col("actual_escalation_required") == strict).alias("strict_ok"),
        F.col("expected_escalation_required"), F.col("actual_escalation_required"), "latency_ms", "route_path")


_FLAGS_SQL = """
, cj as (select *, case when cohort = 'unique_in_domain' then null else expected_escalation_required end as decision_label,
           case when cohort in ('policy_human', 'ood_human') then 'human_review_required'
                when cohort = 'similar_cache' then 'semantic_cache' end as expected_route_path,
           cohort = 'similar_cache' as expected_semantic_cache_hit from joined),
flags as (select ticket_id, cohort, decision_label is not null as decision_required,
  (decision_label is null or actual_escalation_required = decision_label) as decision_ok,
  (expected_route_path is null or route_path = expected_route_path) as route_ok,
  (semantic_cache_hit = expected_semantic_cache_hit and match_ok) as cache_ok, attachment_ok,
  (decision_label is null or actual_escalation_required = decision_label)
    and (expected_route_path is null or route_path = expected_route_path)
    and (semantic_cache_hit = expected_semantic_cache_hit and match_ok) and attachment_ok as case_ok,
  actual_escalation_required = (cohort in ('ood_human', 'policy_human')) as strict_ok,
  expected_escalation_required, actual_escalation_required, latency_ms, route_path from cj)
"""


@register("eval_case_flags", _eval_sql(_FLAGS_SQL + """
select ticket_id, cohort, decision_required, decision_ok, route_ok, cache_ok, attachment_ok, case_ok, strict_ok from flags"""))
def q_eval_case_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return case_flags(_joined(spark, sf_dir)).select(
        "ticket_id", "cohort", "decision_required", "decision_ok", "route_ok", "cache_ok", "attachment_ok", "case_ok",
        "strict_ok")


def by_cohort(flags: DataFrame) -> DataFrame:
    """AGG-28: counters and accuracies per cohort and overall ('all'); the decision
    accuracy is NULL when a cohort has no labelled case."""
    i = lambda c: F.sum(F.col(c).cast("int"))
    g = flags.rollup("cohort").agg(
        F.count("*").alias("total"), i("case_ok").alias("case_correct"),
        F.sum((F.col("decision_required") & F.col("decision_ok")).cast("int")).alias("decision_required_correct"),
        i("decision_required").alias("decision_required_cases"), i("route_ok").alias("route_correct"),
        i("cache_ok").alias("cache_correct"), i("attachment_ok").alias("attachment_correct"),
        i("strict_ok").alias("strict_correct"), i("expected_escalation_required").alias("expected_escalations"),
        i("actual_escalation_required").alias("actual_escalations"),
        F.sum((~F.col("actual_escalation_required")).cast("int")).alias("auto_resolutions"))
    t = F.col("total")
    return g.select(
        F.coalesce("cohort", F.lit("all")).alias("cohort"), "total",
        _ratio(F.col("case_correct"), t).alias("case_accuracy"),
        F.when(F.col("decision_required_cases") > 0,
               pyround(F.col("decision_required_correct") / F.col("decision_required_cases"), 4))
        .alias("decision_accuracy"),
        "decision_required_cases", (t - F.col("decision_required_cases")).alias("decision_unlabeled_cases"),
        _ratio(F.col("strict_correct"), t).alias("strict_auto_resolution_accuracy"),
        _ratio(F.col("route_correct"), t).alias("route_path_accuracy"),
        _ratio(F.col("cache_correct"), t).alias("semantic_cache_accuracy"),
        _ratio(F.col("attachment_correct"), t).alias("detail_attachment_accuracy"),
        "expected_escalations", "actual_escalations",
        _ratio(F.col("auto_resolutions"), t).alias("auto_resolution_rate"))


@register("eval_by_cohort", _eval_sql(_FLAGS_SQL + """
select coalesce(cohort, 'all') as cohort, count(*) as total,
  round(sum(cast(case_ok as integer)) / count(*), 4) as case_accuracy,
  case when sum(cast(decision_required as integer)) > 0
       then round(sum(cast(decision_required and decision_ok as integer)) / sum(cast(decision_required as integer)), 4) end as decision_accuracy,
  sum(cast(decision_required as integer)) as decision_required_cases,
  count(*) - sum(cast(decision_required as integer)) as decision_unlabeled_cases,
  round(sum(cast(strict_ok as integer)) / count(*), 4) as strict_auto_resolution_accuracy,
  round(sum(cast(route_ok as integer)) / count(*), 4) as route_path_accuracy,
  round(sum(cast(cache_ok as integer)) / count(*), 4) as semantic_cache_accuracy,
  round(sum(cast(attachment_ok as integer)) / count(*), 4) as detail_attachment_accuracy,
  sum(cast(expected_escalation_required as integer)) as expected_escalations,
  sum(cast(actual_escalation_required as integer)) as actual_escalations,
  round(sum(cast(not actual_escalation_required as integer)) / count(*), 4) as auto_resolution_rate
from flags group by rollup (cohort)"""))
def q_eval_by_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_cohort(case_flags(_joined(spark, sf_dir)))


# --- sets and membership over ids -------------------------------------------------

@register("base_tickets", with_views("""
select ticket_id, category, assignment_group from tickets
where source = 'curated' and ticket_id in (select matched_ticket_id from routing_decisions)""",
                                     "tickets", "routing_decisions"))
def q_base_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-13 + JOIN-10: tickets of a given source whose id is in the referenced set (semi join)."""
    ids = fixtures.routing_decisions(spark, sf_dir).where(F.col("matched_ticket_id") != "") \
        .select(F.col("matched_ticket_id").alias("ticket_id")).distinct()
    return (fixtures.tickets(spark, sf_dir).where(F.col("source") == "curated").join(ids, "ticket_id", "left_semi")
            .select("ticket_id", "category", "assignment_group"))


@register("missing_ids", with_views("""
select distinct matched_ticket_id as ticket_id from routing_decisions
where matched_ticket_id <> '' and matched_ticket_id not in (select ticket_id from tickets)""",
                                    "tickets", "routing_decisions"))
def q_missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-9 + SET-3: expected ids that are not present (distinct, anti join)."""
    ids = fixtures.routing_decisions(spark, sf_dir).where(F.col("matched_ticket_id") != "") \
        .select(F.col("matched_ticket_id").alias("ticket_id")).distinct()
    return ids.join(fixtures.tickets(spark, sf_dir).select("ticket_id"), "ticket_id", "left_anti")


@register("base_ids", with_views("""
select ticket_id from (select matched_ticket_id as ticket_id from routing_decisions where matched_ticket_id <> ''
  union select ticket_id from review_events) order by ticket_id""", "routing_decisions", "review_events"))
def q_base_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-2: union of two id lists, distinct, sorted."""
    a = fixtures.routing_decisions(spark, sf_dir).where(F.col("matched_ticket_id") != "").select(
        F.col("matched_ticket_id").alias("ticket_id"))
    b = fixtures.review_events(spark, sf_dir).select("ticket_id")
    return a.union(b).distinct().orderBy("ticket_id")


@register("eval_cohorts", with_views("""
select ticket_id, cohort, null::varchar as base_ticket_id, null::boolean as expected_semantic_cache_hit from (
  select """ + _KEY_SQL.format(c="doc_id") + """ as ticket_id,
    case when toxic = 1 then 'policy_human' else 'ood_human' end as cohort
  from labels where toxic = 1 or quality = 0)
union all
select t.ticket_id, 'similar_cache', d.matched_ticket_id, true
from (select distinct ticket_id from tickets) t join (select * from routing_decisions
  qualify row_number() over (partition by ticket_id order by created_at desc, event_id desc) = 1) d on d.ticket_id = t.ticket_id
where d.semantic_cache_hit = 1 and d.matched_ticket_id <> ''""", "tickets", "routing_decisions"))
def q_eval_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-1: cohorts with different optional fields concatenated by name."""
    lab = read_table(spark, sf_dir, "labels").where((F.col("toxic") == 1) | (F.col("quality") == 0))
    policy = lab.select(_key().alias("ticket_id"), F.when(F.col("toxic") == 1, "policy_human")
                        .otherwise("ood_human").alias("cohort"))
    d = latest_decisions(fixtures.routing_decisions(spark, sf_dir), ("semantic_cache_hit", "matched_ticket_id"))
    d = d.where((F.col("semantic_cache_hit") == 1) & (F.col("matched_ticket_id") != ""))
    cache = fixtures.tickets(spark, sf_dir).select("ticket_id").distinct().join(d, "ticket_id").select(
        "ticket_id", F.lit("similar_cache").alias("cohort"), F.col("matched_ticket_id").alias("base_ticket_id"),
        F.lit(True).alias("expected_semantic_cache_hit"))
    return policy.unionByName(cache, allowMissingColumns=True).select(
        "ticket_id", "cohort", "base_ticket_id", "expected_semantic_cache_hit")


# --- sources and sinks of the evaluation jobs ------------------------------------

def load_eval_set(spark: SparkSession, path: str, difficulty: str | None = None,
                  limit: int | None = None) -> DataFrame:
    """SRC-5: a JSON document ``{"tickets": [...]}``, optionally one difficulty and the
    first ``limit`` tickets in file order."""
    doc = spark.read.option("multiLine", True).json(path)
    t = doc.select(F.posexplode("tickets").alias("_pos", "t")).select("_pos", "t.*")
    if difficulty:
        t = t.where(F.col("difficulty") == difficulty)
    if limit is not None:
        t = t.orderBy("_pos").limit(limit)
    return t.drop("_pos")


def write_eval_report(summary: DataFrame, results: DataFrame, path: str) -> None:
    """SNK-8: summary and per-case results as JSON files under ``path``."""
    summary.coalesce(1).write.mode("overwrite").json(os.path.join(path, "summary"))
    results.write.mode("overwrite").json(os.path.join(path, "results"))


@register("eval_report")
def q_eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-8 payload (rows): one JSON summary line per difficulty group."""
    s = by_difficulty(_joined(spark, sf_dir))
    return s.select(F.to_json(F.struct(*s.columns)).alias("summary_json"))

