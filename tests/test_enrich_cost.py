import os

from pyspark.sql import Row

from tixspark.sources import fixtures
from tixspark.streaming import live

from conftest import SF001


class State:
    def __init__(self):
        self.value, self.calls = None, []

    def get(self):
        self.calls.append("get")
        return self.value

    def exists(self):
        self.calls.append("exists")
        return self.value is not None

    def update(self, value):
        self.calls.append("update")
        self.value = value


class Handle:
    def __init__(self):
        self.states = {}

    def getValueState(self, name, schema):
        return self.states.setdefault(name, State())


def change(kind, at, event=None, **more):
    names = [c.strip().split(" ")[0] for c in live.CHANGES.split(",")]
    return Row(*names)(*[{"ticket_id": "a", "kind": kind, "at": at, "event_id": event, **more}.get(n) for n in names])


def test_state_of_a_ticket_is_read_and_written_once_for_all_its_rows():
    handle, enrich = Handle(), live.Enrich(0)
    enrich.init(handle)
    rows = [change("decision", f"2024-01-01 {h:02d}", h, route_path=f"p{h}", escalation_required=0, semantic_cache_hit=0) for h in (3, 9, 5)]
    rows += [change("ticket", "2024-01-01 01", category="c", urgency=2)]
    (out,) = enrich.handleInputRows(("a",), iter(rows), None)
    assert (out.ticket_id, out.category, out.urgency, out.display_category, out.route_path, out.status) == ("a", "c", 2, "c", "p9", "resolved")
    calls = [c for s in handle.states.values() for c in s.calls]
    assert calls == ["get", "update"]
    assert list(enrich.handleInputRows(("a",), iter(rows[2:3]), None)) == []  # an older decision changes nothing


def test_each_arrival_is_one_micro_batch(spark, monkeypatch):
    """However many files a larger table makes of it."""
    folders, scratch, decisions = {}, live.scratch, fixtures.routing_decisions
    monkeypatch.setattr(live, "scratch", lambda s, name: folders.setdefault(name, scratch(s, name)))
    monkeypatch.setattr(fixtures, "routing_decisions", lambda *a: decisions(*a).repartition(20))
    got = live.q_feed_enriched_stream(spark, SF001).count()
    assert len([f for f in os.listdir(folders["enriched"]) if f.startswith("batch_id=")]) == 3 and got > 0
