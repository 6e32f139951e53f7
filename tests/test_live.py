import datetime as dt
import json
import random

from pyspark.sql import functions as F

from tixspark.sources import fixtures
from tixspark.streaming import feed, live

from conftest import SF001


def add_file(frame, folder, n):
    """One file of a file stream, a second apart by name and time."""
    frame.coalesce(1).write.mode("overwrite").parquet(f"{folder}/part{n}")


def run(spark, build, folder, schema, out, checkpoint):
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    q = live.write_batches(build(source), out, checkpoint)
    q.awaitTermination()


def test_replay_restart_heartbeat_and_bounds(spark, tmp_path):
    t = fixtures.tickets(spark, SF001)
    table = {"rows": t.limit(0)}
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "ckpt")

    def go(last):
        q = live.replay_stream(spark, lambda: table["rows"], out, checkpoint, 3, {"availableNow": True}, interval_ms=400, started_at=0, last_tick=last)
        q.awaitTermination()

    go(2)  # an empty table: heartbeats
    table["rows"] = t
    go(6)
    go(6)  # nothing new after a restart
    go(9)
    rows = spark.read.parquet(f"{out}/events").orderBy("tick").collect()
    assert [(r.tick, r.event, r.stream_sequence) for r in rows] == [(1, "heartbeat", None), (2, "heartbeat", None)] + [(k + 2, "ticket", k) for k in range(1, 8)]
    top = [r.ticket_id for r in feed.newest_window(t, 3).orderBy("pos").collect()]
    assert [r.ticket_id for r in rows[2:]] == [top[k % 3] for k in range(7)]
    reader = live.TickReader({"interval_ms": "400", "started_at": "0", "last_tick": "9"})
    assert [list(reader.read(p)) for p in reader.partitions({"tick": 3}, {"tick": 5})] == [[(4,), (5,)]] and reader.partitions({"tick": 5}, {"tick": 5}) == []
    for bad in (399, 10_001):
        try:
            live.TickReader({"interval_ms": str(bad)})
            raise AssertionError("out of bounds")
        except ValueError:
            pass


def test_late_decisions_send_their_ticket_again(spark, tmp_path):
    day = lambda h: dt.datetime(2024, 1, 1, h)
    tickets = spark.createDataFrame([("a", day(1), "Network", "api", 1), ("b", day(1), "Access", "api", None), ("c", day(1), None, None, 2)],
                                    "ticket_id string, created_at timestamp_ntz, category string, source string, urgency int")
    decide = lambda *rows: spark.createDataFrame(list(rows), "ticket_id string, created_at timestamp_ntz, event_id long, assigned_category string, route_path string, "  # noqa: E731
                                                 "escalation_required int, semantic_cache_hit int")
    batches = [
        live.changes(tickets, decide(("d", day(2), 1, "Security", "generative_rag", 0, 0), ("a", day(5), 2, "Database", "generative_rag", 0, 0))),
        live.changes(tickets.limit(0), decide(("b", day(3), 3, None, "human_review_required", 1, 0), ("a", day(4), 4, "Old", "semantic_cache", 0, 1))),
        live.changes(tickets.where("ticket_id = 'a'").withColumn("ticket_id", F.lit("d")), decide(("b", day(3), 5, "Security", "semantic_cache", 0, 1))),
    ]
    src, out, ckpt = (str(tmp_path / x) for x in ("src", "out", "ckpt"))
    for i, b in enumerate(batches):
        add_file(b, src, i)
        run(spark, live.enrich_stream, src, live.CHANGES, out, ckpt)  # a restart after each micro-batch
    got = {}
    for r in spark.read.parquet(out).collect():
        got.setdefault(r.batch_id, {})[r.ticket_id] = (r.display_category, r.route_path, r.status)
    order = sorted(got)
    assert got[order[0]] == {"a": ("Database", "generative_rag", "resolved"), "b": ("Access", "unrouted", "unrouted"), "c": (None, "unrouted", "unrouted")}
    assert got[order[1]] == {"b": ("Access", "human_review_required", "human_review_required")}  # a's older decision changes nothing
    assert got[order[2]] == {"d": ("Security", "generative_rag", "resolved"), "b": ("Security", "semantic_cache", "semantic_cache_resolved")}


def test_view_keeps_places_over_a_restart(spark, tmp_path):
    rng = random.Random(4)
    events = [("one" if rng.random() < 0.8 else "two", k, f"t{rng.randrange(9)}", f"v{k}") for k in range(120)]
    model = {"one": [], "two": []}
    expected = []
    for k, (f, seq, ticket, value) in enumerate(events):
        shown = model[f]
        at = next((i for i, e in enumerate(shown) if e[0] == ticket), None)
        if at is not None:
            shown[at] = (ticket, seq, value)
        else:
            shown.insert(0, (ticket, seq, value))
            del shown[5:]
        if k in (39, 79, 119):
            expected.append(json.loads(json.dumps(model)))
    src, out, ckpt = (str(tmp_path / x) for x in ("src", "out", "ckpt"))
    schema = "feed string, sequence long, ticket_id string, value string"
    for i in range(3):
        part = events[40 * i : 40 * i + 40]
        rng.shuffle(part)  # rows of a micro-batch come in any order
        add_file(spark.createDataFrame(part, schema), src, i)
        run(spark, lambda s: live.view_stream(s, cap=5), src, schema, out, ckpt)
    rows = spark.read.parquet(out).collect()
    for i, b in enumerate(sorted({r.batch_id for r in rows})):
        for f in ("one", "two"):
            got = [[r.ticket_id, r.sequence, r.value] for r in sorted(rows, key=lambda r: r.position) if r.batch_id == b and r.feed == f]
            assert got == expected[i][f]
