"""The live feed as stateful streams (ST-3, ST-4, JOIN-6, SNK-10).

* ``Ticker`` is a streaming source of ticks whose offsets are sequence numbers, so a restart repeats the same ticks for
  the same offsets. :func:`replay_stream` shows a ticket of the newest window at each tick, or a heartbeat
  while there are none; heartbeats do not advance the sequence.
* :func:`enrich_stream` joins two change streams by ticket: each key keeps its latest ticket and its latest
  decision, and whichever arrives later sends the ticket out again. A timer can repeat it.
* :func:`view_stream` keeps a feed as a reader sees it: an event of a ticket that is shown changes it in
  place, another one comes first, and beyond ``cap`` the last one goes.

The stateful operators need the RocksDB state store; :func:`stateful` sets it for a session.
"""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.store import exists
from ..operators.latest import latest_by_key
from ..plans.registry import ORACLES, register
from ..sources import fixtures
from .feed import FEED_COLUMNS, newest_window
from .redact_stream import scratch

# Worker-side code is shipped by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


# --- ticks and replay ------------------------------------------------------------------


class Ticks(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class TickReader(DataSourceStreamReader):
    """Tick n falls ``interval_ms`` * n after ``started_at`` (ms); ``last_tick`` ends the stream."""

    def __init__(self, options: dict) -> None:
        self.interval = int(options.get("interval_ms", 1500))
        if not 400 <= self.interval <= 10_000:
            raise ValueError("interval_ms must be in [400, 10000]")
        self.started = int(options.get("started_at", time.time() * 1000))
        self.last = int(options["last_tick"]) if "last_tick" in options else None

    def initialOffset(self) -> dict:
        return {"tick": 0}

    def latestOffset(self) -> dict:
        now = max(0, int((time.time() * 1000 - self.started) // self.interval))
        return {"tick": now if self.last is None else min(now, self.last)}

    def partitions(self, start: dict, end: dict) -> list[Ticks]:
        return [Ticks(start["tick"] + 1, end["tick"])] if end["tick"] > start["tick"] else []

    def read(self, partition: Ticks) -> Iterator[tuple[int]]:
        for tick in range(partition.first, partition.last + 1):
            yield (tick,)


class Ticker(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tix_ticker"

    def schema(self) -> str:
        return "tick bigint"

    def streamReader(self, schema) -> TickReader:
        return TickReader(self.options)


def replay_stream(spark: SparkSession, tickets: Callable[[], DataFrame], out_dir: str, checkpoint: str, window: int = 200,
                  trigger: dict | None = None, **options):
    """Start the replay. Each micro-batch reads the newest ``window`` of ``tickets()`` and writes, per tick, event
    (``ticket`` or ``heartbeat``), stream_sequence and the ticket's columns to ``out_dir/batch_id=<n>``; a batch
    that is repeated writes the same rows. How many tickets were shown is kept beside the batches."""
    spark.dataSource.register(Ticker)
    ticks = spark.readStream.format("tix_ticker").options(**{k: str(v) for k, v in options.items()}).load()

    def shown_before(batch_id: int) -> int:
        path = f"{out_dir}/shown/batch_id={batch_id - 1}"
        return spark.read.schema("shown long").json(path).first()["shown"] if exists(spark, path) else 0

    def emit(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        top = newest_window(tickets(), window).persist()
        try:
            n = top.count()  # at most ``window``
            before = shown_before(batch_id)
            sizes = batch.agg(F.min("tick").alias("first"), F.count("*").alias("n")).first()
            if n:
                t = batch.select("tick", F.lit("ticket").alias("event"), (F.col("tick") - F.lit(sizes["first"] or 0) + 1 + before).alias("stream_sequence"))
                rows = t.withColumn("pos", ((F.col("stream_sequence") - 1) % n + 1).cast("int")).join(F.broadcast(top), "pos").drop("pos")
            else:
                rows = batch.select("tick", F.lit("heartbeat").alias("event"), F.lit(None).cast("long").alias("stream_sequence"),
                                    *[F.lit(None).cast(top.schema[c].dataType).alias(c) for c in FEED_COLUMNS])
            rows.write.mode("overwrite").parquet(f"{out_dir}/events/batch_id={batch_id}")
            shown = before + (sizes["n"] if n else 0)
            session.createDataFrame([(shown,)], "shown long").coalesce(1).write.mode("overwrite").json(f"{out_dir}/shown/batch_id={batch_id}")
        finally:
            top.unpersist()

    w = ticks.writeStream.foreachBatch(emit).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"processingTime": "1500 milliseconds"})).start()


# --- enrichment as a join of two change streams ---------------------------------------------

TICKET_FIELDS = ("category", "source", "urgency")
DECISION_FIELDS = ("assigned_category", "route_path", "escalation_required", "semantic_cache_hit")
CHANGES = ("ticket_id string, kind string, at string, event_id long, category string, source string, urgency int, "
           "assigned_category string, route_path string, escalation_required int, semantic_cache_hit int")
ENRICHED = ("ticket_id string, category string, source string, urgency int, display_category string, route_path string, status string, "
            "decided_at string, refreshed boolean")
#: The state of a ticket: its latest version (if it has been seen) and its latest decision (if there is one).
LATEST = ("seen boolean, at string, category string, source string, urgency int, decided boolean, decided_at string, event_id long, "
          "assigned_category string, route_path string, escalation_required int, semantic_cache_hit int")
_TICKET_WIDTH, _NOTHING = 5, (False, *[None] * 4, False, *[None] * 6)
_ENRICHED_ROW = Row(*[c.strip().split(" ")[0] for c in ENRICHED.split(",")])


def changes(tickets: DataFrame, decisions: DataFrame) -> DataFrame:
    """Tickets and decisions as rows of one change stream; ``at`` is the time as a text that sorts."""
    at = F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at")
    null = lambda c, t: F.lit(None).cast(t).alias(c)
    kinds = dict(c.strip().split(" ") for c in CHANGES.split(","))
    t = tickets.select("ticket_id", F.lit("ticket").alias("kind"), at, null("event_id", "long"), *TICKET_FIELDS, *[null(c, kinds[c]) for c in DECISION_FIELDS])
    d = decisions.select("ticket_id", F.lit("decision").alias("kind"), at, "event_id", *[null(c, kinds[c]) for c in TICKET_FIELDS], *DECISION_FIELDS)
    return t.unionByName(d)


class Enrich(StatefulProcessor):
    """Per ticket: its latest version and its latest decision, in one state that is read and written once for a key's rows."""

    def __init__(self, refresh_ms: int) -> None:
        self.refresh_ms = refresh_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", LATEST)

    def row(self, key, latest: tuple, refreshed: bool) -> Row:
        _, _, category, source, urgency, decided, at, _, assigned, path, escalated, cached = latest
        status = "unrouted" if not decided else "human_review_required" if escalated == 1 else "semantic_cache_resolved" if cached == 1 else "resolved"
        return _ENRICHED_ROW(key[0], category, source, urgency, assigned if assigned is not None else category, path if path is not None else "unrouted", status, at, refreshed)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        latest = self.latest.get() or _NOTHING
        ticket, decision, changed = latest[:_TICKET_WIDTH], latest[_TICKET_WIDTH:], False
        for r in rows:
            if r.kind == "ticket":
                if not ticket[0] or (r.at or "") >= (ticket[1] or ""):
                    ticket, changed = (True, r.at, r.category, r.source, r.urgency), True
            elif not decision[0] or (r.at or "", -1 if r.event_id is None else r.event_id) >= (decision[1] or "", -1 if decision[2] is None else decision[2]):
                decision, changed = (True, r.at, r.event_id, r.assigned_category, r.route_path, r.escalation_required, r.semantic_cache_hit), True
        if not changed:
            return
        self.latest.update((*ticket, *decision))
        if ticket[0]:
            if self.refresh_ms:
                for old in list(self.handle.listTimers()):
                    self.handle.deleteTimer(old)
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.refresh_ms)
            yield self.row(key, (*ticket, *decision), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        latest = self.latest.get() or _NOTHING
        if latest[0]:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.refresh_ms)
            yield self.row(key, latest, True)


def enrich_stream(change_stream: DataFrame, refresh_ms: int = 0) -> DataFrame:
    """The enriched ticket after each change of it or of its decision; with ``refresh_ms`` again that long after the last change."""
    stateful(change_stream.sparkSession)
    return change_stream.groupBy("ticket_id").transformWithState(
        Enrich(refresh_ms), outputStructType=ENRICHED, outputMode="Update", timeMode="processingTime" if refresh_ms else "none")


# --- the feed as it is read -------------------------------------------------------------------


class View(StatefulProcessor):
    """Per feed: the tickets shown, first one first, with their latest event."""

    def __init__(self, cap: int) -> None:
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.shown = handle.getValueState("shown", "feed string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        shown = json.loads(self.shown.get()[0]) if self.shown.exists() else []
        for r in pd.concat(rows).sort_values("sequence", kind="stable").itertuples(index=False):
            place = next((i for i, (t, _, _) in enumerate(shown) if t == r.ticket_id), None)
            event = [r.ticket_id, int(r.sequence), r.value]
            if place is not None:
                shown[place] = event
            else:
                shown.insert(0, event)
                del shown[self.cap :]
        self.shown.update((json.dumps(shown),))
        yield pd.DataFrame([(key[0], i + 1, *e) for i, e in enumerate(shown)], columns=["feed", "position", "ticket_id", "sequence", "value"])


def view_stream(events: DataFrame, cap: int = 200) -> DataFrame:
    """``events`` (feed, sequence, ticket_id, value) -> feed, position (1 = top), ticket_id, sequence, value of the whole
    feed after each micro-batch that changed it. Events of a feed are taken by their sequence; a micro-batch's events of
    one feed are held at once, so let the source bound them (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``)."""
    stateful(events.sparkSession)
    return events.groupBy("feed").transformWithStateInPandas(
        View(cap), outputStructType="feed string, position int, ticket_id string, sequence long, value string", outputMode="Update", timeMode="none")


def write_batches(stream: DataFrame, out_dir: str, checkpoint: str, trigger: dict | None = None):
    """Write each micro-batch to ``out_dir/batch_id=<n>``; a repeated one overwrites its own folder."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(out_dir, f"batch_id={batch_id}"))

    w = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()


@register("feed_enriched_stream", ORACLES["feed_enriched"])
def q_feed_enriched_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-6 as a stream: tickets and decisions arrive in three micro-batches, in no order of time; the last row that was
    sent for each ticket of the newest window."""
    tickets = fixtures.tickets(spark, sf_dir)
    rows = changes(tickets, fixtures.routing_decisions(spark, sf_dir))
    src, out, checkpoint = (scratch(spark, n) for n in ("changes", "enriched", "enriched-ckpt"))
    for b in range(3):
        rows.where(F.pmod(F.xxhash64("ticket_id", "kind", "event_id"), F.lit(3)) == b).write.parquet(f"{src}/part{b}")
        # All files of an arrival are one micro-batch, however many there are; the stream goes on from its checkpoint.
        stream = spark.readStream.schema(CHANGES).option("recursiveFileLookup", "true").parquet(src)
        write_batches(enrich_stream(stream), out, checkpoint).awaitTermination()
    sent = spark.read.parquet(out)
    last = latest_by_key(sent, "ticket_id", ["batch_id"], [c for c in sent.columns if c not in ("ticket_id", "batch_id")])
    return newest_window(tickets).select("ticket_id").join(last, "ticket_id").select(
        "ticket_id", "category", "source", "urgency", "display_category", "route_path", "status")
