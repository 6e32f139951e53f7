import json
import sys
import time

from pyspark import cloudpickle
from pyspark.sql import functions as F

from tixspark.functions.vectors import embed_text
from tixspark.operators import model_stage as M
from tixspark.operators.route import prepare_corpus, route_tickets
from tixspark.plans.routing import incoming_requests
from tixspark.settings import DEFAULT
from tixspark.sources import fixtures

from conftest import SF001

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the models below travel to the workers


def loader():
    """Fails on some texts, sleeps on others, gives vectors of a wrong length or not finite on others."""
    def model(texts):
        out = []
        for t in texts:
            if "fail" in t:
                raise RuntimeError("no")
            if "slow" in t:
                time.sleep(3)
            out.append([1.0] * 3 if "short" in t else [float("nan")] * 4 if "nan" in t else [3.0, 0.0, 4.0, 0.0])
        return out

    return model


def broken():
    raise ImportError("no model here")


def test_rows_that_the_model_fails_on_get_the_lexical_vector(spark):
    texts = ["one", "fail here", "two", "short", "nan", None, "three", "slow one", "four"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").coalesce(1)
    out = df.select("id", M.model_embedding(F.col("t"), 4, loader, 0.5, 4).alias("m"), M.embed_with(loader, 0.5, 4)(F.col("t"), 4).alias("e"),
                    embed_text(F.col("t"), 4).alias("lexical"), M.embed_with(broken)(F.col("t"), 4).alias("none"))
    got = {r.id: r for r in out.collect()}
    model = {0, 2, 5, 6, 8}
    assert {i for i, r in got.items() if r.m is not None} == model
    for i, r in got.items():
        assert [round(x, 5) for x in r.e] == ([0.6, 0.0, 0.8, 0.0] if i in model else [round(x, 5) for x in r.lexical])
        assert r.none == r.lexical


def test_a_worker_stops_asking_a_model_that_is_late():
    calls = []

    def slow():
        def model(texts):
            calls.append(len(texts))
            time.sleep(0.3)
            return texts

        return model

    asker = M.Asker(slow, 0.05)
    assert asker.answers(["a"]) == [None] and asker.answers(["b", "c", "d", "e"]) == [None] * 4
    assert asker.late == M.MAX_LATE and len(calls) == 3


def test_routing_with_a_model_that_answers_some(spark):
    t = fixtures.tickets(spark, SF001).where("doc_id < 80")

    def decider():
        def model(prompts):
            if any(len(p) % 3 == 0 for p in prompts):
                raise RuntimeError("overloaded")
            return [json.dumps({"resolution_steps": ["Do this now."], "confidence_score": 0.9, "escalation_required": False, "rationale": "fine"}) if len(p) % 3 == 1 else "no json"
                    for p in prompts]

        return model

    corpus = prepare_corpus(t, DEFAULT)
    requests = incoming_requests(t)
    routed = route_tickets(requests, corpus, DEFAULT, decision_fn=M.decide_with(decider, lambda df: F.col("sanitized_text"), 5.0, 4))
    usual = route_tickets(requests, corpus, DEFAULT)
    plain = {r.ticket_id: r.decision for r in usual.select("ticket_id", "decision").collect()}
    rows = routed.select("ticket_id", "sanitized_text", "needs_decision", "decided_by_model", "decision").collect()
    assert len(rows) == requests.count() and any(r.decided_by_model for r in rows)
    for r in rows:
        answered = r.needs_decision and len(r.sanitized_text) % 3 == 1
        assert r.decided_by_model == answered
        assert (r.decision.steps if answered else r.decision) == (["Do this now."] if answered else plain[r.ticket_id]), r
