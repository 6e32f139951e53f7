"""Ticket feed (ST-3, ST-4, JOIN-6, AGG-23, FLT-9).

Batch forms are registered queries; the streaming forms wrap the same functions in
``foreachBatch`` so the static side (latest decisions, stored feed state) is re-read
per micro-batch.

* ST-3 replays the newest ``window`` tickets cyclically: tick ``seq`` shows row
  ``(seq - 1) mod n``; it does not tail the table.
* ST-4 keeps the latest event per ticket and the newest ``cap`` tickets (not
  ``dropDuplicates``, which would keep the first).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.latest import latest_by_key
from ..plans.common import latest_decisions, ticket_status
from ..plans.registry import register
from ..sources import fixtures
from ..plans.ingest import _MSG_SQL, ingest_messages
from ..sources.fixtures import _redaction_sql, with_views
from .redact_stream import run_available

FEED_COLUMNS = ("ticket_id", "short_description", "category", "assignment_group", "urgency", "impact", "created_at",
                "sanitized_text", "source")


def newest_window(tickets: DataFrame, window: int = 200) -> DataFrame:
    """The ``window`` newest tickets with their position (1 = newest)."""
    if not 1 <= window <= 1000:
        raise ValueError("window must be in [1, 1000]")
    top = tickets.select(*FEED_COLUMNS).orderBy(F.col("created_at").desc(), F.col("ticket_id").desc()).limit(window)
    # The window is bounded (≤ 1000 rows), so numbering it in one partition is safe.
    w = Window.orderBy(F.col("created_at").desc(), F.col("ticket_id").desc())
    return top.withColumn("pos", F.row_number().over(w))


def feed_replay(tickets: DataFrame, ticks: DataFrame, window: int = 200) -> DataFrame:
    """ST-3: ``ticks`` (column ``seq`` from 1) → the ticket shown at each tick."""
    top = newest_window(tickets, window)
    n = top.agg(F.count("*").alias("n"))
    t = ticks.crossJoin(F.broadcast(n)).where(F.col("n") > 0) \
        .withColumn("pos", ((F.col("seq") - 1) % F.col("n") + 1).cast("int"))  # one-row side
    return t.join(F.broadcast(top), "pos").select(F.col("seq").alias("stream_sequence"), *FEED_COLUMNS)


def feed_replay_stream(spark: SparkSession, tickets_loader, out_dir: str, checkpoint: str, window: int = 200,
                       rows_per_second: int = 1):
    """ST-3 streaming: a ``rate`` source drives the ticks; each micro-batch re-reads the
    newest window (``tickets_loader()``) and appends the shown rows."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load() \
        .select((F.col("value") + 1).alias("seq"))

    def emit(batch: DataFrame, batch_id: int) -> None:
        feed_replay(tickets_loader(), batch, window).write.mode("overwrite").parquet(
            os.path.join(out_dir, f"batch_id={batch_id}"))

    return ticks.writeStream.foreachBatch(emit).option("checkpointLocation", checkpoint) \
        .trigger(processingTime="1500 milliseconds").start()


def feed_state(events: DataFrame, cap: int = 200) -> DataFrame:
    """ST-4: latest event per ticket (by arrival, ties by event id), newest ``cap``."""
    latest = latest_by_key(events, "ticket_id", ["created_at", "event_id"],
                           [c for c in events.columns if c != "ticket_id"])
    return latest.orderBy(F.col("created_at").desc(), F.col("event_id").desc()).limit(cap)


def feed_state_stream(events: DataFrame, state_dir: str, checkpoint: str, cap: int = 200):
    """ST-4 streaming: each micro-batch unions the stored feed with its events, keeps the
    latest per ticket and the newest ``cap``, and writes a new state version."""
    spark = events.sparkSession

    def upsert(batch: DataFrame, batch_id: int) -> None:
        prev, cur = f"{state_dir}/v={batch_id - 1}", batch
        path = spark._jvm.org.apache.hadoop.fs.Path(prev)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):  # none before the first batch
            cur = spark.read.parquet(prev).unionByName(batch)
        feed_state(cur, cap).write.mode("overwrite").parquet(os.path.join(state_dir, f"v={batch_id}"))

    return events.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).start()


def feed_enriched(events: DataFrame, decisions: DataFrame) -> DataFrame:
    """JOIN-6: feed events ⟕ latest decision per ticket; decision fields overwrite."""
    d = latest_decisions(decisions, ("assigned_category", "route_path", "escalation_required", "semantic_cache_hit",
                                     "confidence_score")).withColumnRenamed("ticket_id", "d_id")
    j = events.join(d, events.ticket_id == d.d_id, "left")
    return j.select(
        *[c for c in events.columns],
        F.coalesce("assigned_category", "category").alias("display_category"),
        F.coalesce("route_path", F.lit("unrouted")).alias("route_path"),
        ticket_status(F.col("d_id"), F.col("escalation_required"), F.col("semantic_cache_hit")).alias("status"))


def feed_stats(feed: DataFrame) -> DataFrame:
    """AGG-23: total, routed (routed/resolved/cache-resolved) and escalated."""
    s = F.lower(F.coalesce("status", F.lit("")))
    return feed.agg(F.count("*").alias("total"),
                    F.count_if(s.isin("routed", "resolved", "semantic_cache_resolved")).alias("routed"),
                    F.count_if(s == "human_review_required").alias("escalated"))


def feed_filtered(feed: DataFrame, category: str = "", source: str = "", urgency: int | None = None,
                  status: str = "") -> DataFrame:
    """FLT-9: optional equality filters (category matches the displayed category)."""
    p = F.lit(True)
    if category:
        p = p & (F.col("display_category") == category)
    if source:
        p = p & (F.col("source") == source)
    if urgency is not None:
        p = p & (F.col("urgency").cast("string") == str(urgency))
    if status:
        p = p & (F.lower(F.coalesce("status", F.lit(""))) == status)
    return feed.where(p)


# ---------------------------------------------------------------------------
# Registered batch forms
# ---------------------------------------------------------------------------

_NEWEST_SQL = """
top as (select ticket_id, short_description, category, assignment_group, urgency, impact, created_at, sanitized_text,
          source, row_number() over (order by created_at desc, ticket_id desc) as pos
        from tickets order by created_at desc, ticket_id desc limit 200)
"""


@register("feed_replay", with_views(f"""
with {_NEWEST_SQL},
ticks as (select (doc_id + 1) as seq from documents)
select seq as stream_sequence, ticket_id, short_description, category, assignment_group, urgency, impact, created_at,
  sanitized_text, source
from ticks join top on top.pos = (seq - 1) % (select count(*) from top) + 1""", "tickets"))
def q_feed_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-3 batch form: a tick for every document over the newest 200 tickets (tick
    numbers are taken from the document ids)."""
    t = fixtures.tickets(spark, sf_dir)
    ticks = t.select((F.col("doc_id") + 1).alias("seq"))
    return feed_replay(t, ticks, 200)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed events: the decision stream keyed by ticket (arrival = decision time)."""
    d = fixtures.routing_decisions(spark, sf_dir)
    return d.select("event_id", "ticket_id", "route_path", "confidence_score", "created_at")


@register("feed_state", with_views("""
select event_id, ticket_id, route_path, confidence_score, created_at from routing_decisions
qualify row_number() over (partition by ticket_id order by created_at desc, event_id desc) = 1
order by created_at desc, event_id desc limit 200""", "routing_decisions"))
def q_feed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed_state(_events(spark, sf_dir)).select("event_id", "ticket_id", "route_path", "confidence_score",
                                                     "created_at")


_ENRICH_SQL = """
, ld as (select * from routing_decisions qualify row_number() over (partition by ticket_id order by created_at desc, event_id desc) = 1),
fe as (select top.ticket_id, top.category, top.source, top.urgency, coalesce(ld.assigned_category, top.category) as display_category,
  coalesce(ld.route_path, 'unrouted') as route_path,
  case when ld.ticket_id is null then 'unrouted' when ld.escalation_required = 1 then 'human_review_required'
       when ld.semantic_cache_hit = 1 then 'semantic_cache_resolved' else 'resolved' end as status
  from top left join ld on ld.ticket_id = top.ticket_id)
"""


def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fixtures.tickets(spark, sf_dir)
    ev = newest_window(t, 200).select("ticket_id", "category", "source", "urgency")
    return feed_enriched(ev, fixtures.routing_decisions(spark, sf_dir))


@register("feed_enriched", with_views(f"with {_NEWEST_SQL} {_ENRICH_SQL} select * from fe",
                                      "tickets", "routing_decisions"))
def q_feed_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-6 batch form over the newest 200 tickets."""
    return _enriched(spark, sf_dir).select("ticket_id", "category", "source", "urgency", "display_category",
                                           "route_path", "status")


@register("feed_stats", with_views(f"""with {_NEWEST_SQL} {_ENRICH_SQL}
select count(*) as total, count(*) filter (where lower(status) in ('routed', 'resolved', 'semantic_cache_resolved')) as routed,
  count(*) filter (where lower(status) = 'human_review_required') as escalated from fe""", "tickets", "routing_decisions"))
def q_feed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed_stats(_enriched(spark, sf_dir))


@register("feed_filtered", with_views(f"""with {_NEWEST_SQL} {_ENRICH_SQL}
select * from fe where display_category = 'Network' and source = 'curated'""", "tickets", "routing_decisions"))
def q_feed_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed_filtered(_enriched(spark, sf_dir), category="Network", source="curated").select(
        "ticket_id", "category", "source", "urgency", "display_category", "route_path", "status")


@register("stream_redact", f"""
with {_MSG_SQL.strip()},
red as ({_redaction_sql("select doc_id, composed as text from v where reject_reason is null")}),
ok as (select v.doc_id, v.number, v.composed, v.created_at, r.redacted_count from v
       join red r on r.doc_id = v.doc_id and r.kind = 'doc' where v.reject_reason is null and not v.bypass)
select 'tickets.sanitized' as topic,
  concat('ticket_', substring(sha256(concat(composed, chr(0), number, chr(0))), 1, 16)) as key, redacted_count
from ok
union all
select 'privacy.audit', concat('stream_', substring(sha256(concat(composed, chr(0), cast(created_at as varchar), chr(0))), 1, 16)),
  redacted_count
from ok where redacted_count > 0""")
def q_stream_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-1 end to end: a file stream of the ingest messages run with availableNow;
    returns what the two topics received."""
    out, _ = run_available(spark, ingest_messages(spark, sf_dir))
    return spark.read.parquet(os.path.join(out, "topics")).select("topic", "key", "redacted_count")

