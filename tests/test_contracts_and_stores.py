"""Literal cases for contracts, ids, model responses, stored tables and the feed streams."""

import json

from pyspark.sql import functions as F

from pyredact import redact_py
from tixspark.functions import redact as RD
from tixspark.functions import scoring as S
from tixspark.functions import text as T
from tixspark.operators.topk import topk_similar
from tixspark.plans import detail, evaluation, ingest
from tixspark.sources import contracts as C
from tixspark.sources.tables import after_first_line, first_line, padded
from tixspark.streaming import feed


def test_ids_keep_all_digits(spark):
    rows = spark.createDataFrame([(7,), (1234561,), (1234569,), (12345678901,)], "i long")
    got = [r[0] for r in rows.select(padded(F.col("i"), 6)).collect()]
    assert got == ["000007", "1234561", "1234569", "12345678901"]


def test_first_line_and_rest(spark):
    rows = spark.createDataFrame([("a b\nc\nd",), ("one",), ("",), (None,), ("\nx",)], "text string")
    got = [tuple(r) for r in rows.select(first_line(F.col("text")), after_first_line(F.col("text"))).collect()]
    assert got == [("a b", "c\nd"), ("one", ""), ("", ""), (None, None), ("", "x")]


def test_queries_without_similarity_get_k_rows(spark):
    q = spark.createDataFrame([("zero", [0.0, 0.0]), ("one", [1.0, 0.0])], "query_id string, query_embedding array<double>")
    c = spark.createDataFrame([(f"t{i}", [float(i), 1.0] if i else [0.0, 0.0], i) for i in range(5)], "ticket_id string, embedding array<double>, created_at int")
    got = topk_similar(q, c, 4, block_rows=2).orderBy("query_id", "rank").collect()
    assert [(r.ticket_id, r.similarity, r.fast_candidate) for r in got if r.query_id == "zero"] == [(f"t{i}", None, 0) for i in range(4)]
    assert [r.ticket_id for r in got if r.query_id == "one"] == ["t4", "t3", "t2", "t1"]


def test_ingest_types(spark):
    text = {"raw_text": "printer is broken"}
    cases = [
        (text, True), (text | {"urgency": 2}, True), (text | {"Urgency": 2}, True), (text | {"urgency": None, "metadata": None}, True),
        (text | {"metadata": {"a": {"b": 1}}}, True), (text | {"bypass_redpanda": True}, True), (text | {"urgency": "high"}, False),
        (text | {"urgency": 2.5}, False), (text | {"urgency": "2"}, False), ({"raw_text": 5}, False), (text | {"metadata": "s"}, False),
        (text | {"return_sanitized": 1}, False), (text | {"priority": "P1"}, False), (text | {"urgency": 4}, False), ({"raw_text": "  "}, False),
    ]
    rows = [(i, json.dumps(m)) for i, (m, _) in enumerate(cases)] + [(100, "[1]"), (101, "not json"), (102, None)]
    got = {r.i: r for r in C.validate_ingest(spark.createDataFrame(rows, "i int, value string")).collect()}
    assert [got[i].reject_reason is None for i in range(len(cases))] == [ok for _, ok in cases]
    assert all(got[i].reject_reason for i in (100, 101, 102))
    assert got[2].msg.urgency == 2 and json.loads(got[4].msg.metadata) == {"a": {"b": 1}}


def test_published_events(spark):
    rows = [(json.dumps({"raw_text": "mail a@b.com", "number": "N1", "category": "net", "metadata": {"k": [1]}}),),
            (json.dumps({"raw_text": "nothing here", "bypass_redpanda": True}),), (json.dumps({"raw_text": "nothing"}),)]
    msgs = spark.createDataFrame(rows, "value string").withColumn("created_at", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    got = ingest.publish_projection(C.validate_ingest(msgs)).collect()
    assert sorted(r.topic for r in got) == ["privacy.audit", "tickets.sanitized", "tickets.sanitized"]
    event = next(json.loads(r.value) for r in got if r.topic == "privacy.audit")
    assert event["category"] == "net" and event["metadata"] == {"k": [1]} and event["sanitized_text"] == "mail [EMAIL_1]"
    assert {"ticket_id", "short_description", "resolution", "source", "raw_text", "urgency", "return_sanitized"} <= set(event)


def test_model_decisions(spark):
    def one(payload):
        d = spark.createDataFrame([(json.dumps(payload),)], "p string").select(T.model_decision(F.col("p")).alias("d"))
        return d.first().d

    assert one({"escalation_required": "false"}).escalation_required is True  # a non-empty string is true
    assert one({"escalation_required": None}).escalation_required is False and one({}).escalation_required is True
    assert one({"escalation_required": []}).escalation_required is False and one({"escalation_required": 0}).escalation_required is False
    assert one({"confidence_score": "abc"}).parsed is False and one({"confidence_score": None}).parsed is False
    assert one({"confidence_score": " 0.5 "}).confidence == 0.5 and one({"confidence_score": True}).confidence == 1.0
    assert one({"resolution_steps": ["a", None, 3, True, " "]}).steps == ["a", "None", "3", "True"]
    assert one({"rationale": None}).rationale == "None" and one({"rationale": "x" * 1200}).rationale == "x" * 1000
    empty = spark.createDataFrame([(json.dumps({"escalation_required": True, "rationale": "why"}),)], "p string")
    retrieved = F.array().cast("array<struct<ticket_id:string,resolution:string>>")
    full = empty.select(S.complete_steps(T.model_decision(F.col("p")), F.lit("Network"), retrieved).alias("d")).first().d
    assert full.steps[0] == "Route this ticket to human support triage: why" and len(full.steps) == 3


def test_evidence_summary_without_evidence(spark):
    items = "array<struct<ticket_id:string,category:string,assignment_group:string,source:string,similarity:double,evidence_role:string,resolution_present:boolean>>"
    kind = ("struct<quality_score:double,quality_band:string,top_similarity:double,average_similarity:double,category_consensus:double,"
            f"resolution_coverage:double,evidence_count:int,dominant_category:string,policy:string,items:{items}>")  # fmt: skip
    none, some = spark.range(2).select(
        S.evidence_summary(F.when(F.col("id") == 1, F.from_json(F.lit('{"quality_score":0.5,"dominant_category":"é","items":[{"ticket_id":"a","source":"s"}]}'), kind))).alias("s")
    ).collect()
    assert none.s == "No RAG evidence pack was provided."
    assert some.s.isascii() and json.loads(some.s)["dominant_category"] == "é"
    assert set(json.loads(some.s)["items"][0]) == {"ticket_id", "category", "assignment_group", "similarity", "evidence_role", "resolution_present"}


def test_many_findings_in_one_text(spark):
    text = "".join(f"call 555-123-{i:04d} or a{i}@b.com, " if i % 3 else f"10.0.0.{i % 250} and " for i in range(400))
    row = RD.redact(spark.createDataFrame([(text,)], "t string"), "t").first()
    sanitized, findings = redact_py(text)[:2]
    assert row.sanitized_text == sanitized and row.redacted_count == len(findings) > 3 * RD.STRETCH
    assert [f.placeholder for f in row.findings] == [f[1] for f in findings]


def test_stored_tables_round_trip(spark, tmp_path):
    path = str(tmp_path / "decisions")
    cols = "ticket_id string, assigned_category string, confidence_score double, escalation_required int, suggested_resolution string, route_path string, semantic_cache_hit int, matched_ticket_id string, created_at timestamp_ntz, event_id long"
    rows = [(f"T{i % 40}", "Network", i / 100, i % 2, "s", "p", 0, "", None, i) for i in range(100)]
    df = spark.createDataFrame(rows, cols).withColumn("created_at", F.timestamp_add("MINUTE", "event_id", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")))
    ingest.append(df, path)
    ingest.append(df.limit(0), path)
    stored = spark.read.parquet(path)
    one = detail.routing_status(stored, "T7")
    assert [r.confidence_score for r in one.collect()] == [0.87] and stored.count() == 100
    assert "EqualTo(ticket_id,T7)" in one._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    reviews = ingest.review_rows(spark.createDataFrame([("T1", "approve", "me", None)], "ticket_id string, decision string, reviewer string, notes string").selectExpr(
        "*", "'' as corrected_category", "'' as corrected_assignment_group", "cast(null as string) as corrected_resolution"))
    ingest.append(reviews, str(tmp_path / "reviews"))
    got = spark.read.parquet(str(tmp_path / "reviews")).first()
    assert (got.notes, got.corrected_resolution, got.decision) == ("", "", "approve") and got.review_id and got.created_at


def test_evaluation_files_round_trip(spark, tmp_path):
    tickets = [{"ticket_id": f"E{i}", "difficulty": "easy" if i % 2 else "hard", "urgency": i} for i in range(9)]
    (tmp_path / "set.json").write_text(json.dumps({"tickets": tickets}, indent=1))
    got = evaluation.load_eval_set(spark, str(tmp_path / "set.json"), "hard", 3)
    assert sorted(r.ticket_id for r in got.collect()) == ["E0", "E2", "E4"]
    evaluation.write_eval_report(got.groupBy("difficulty").count(), got, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report" / "summary")).first()["count"] == 3


def test_feed_state_stream_keeps_its_state(spark, tmp_path):
    kind = "event_id long, ticket_id string, route_path string, created_at timestamp_ntz"
    src, state, ckpt = (str(tmp_path / n) for n in ("src", "state", "ckpt"))
    for batch in ([(1, "a", "x"), (2, "b", "x")], [(3, "a", "y")]):
        rows = spark.createDataFrame(batch, "event_id long, ticket_id string, route_path string").withColumn(
            "created_at", F.timestamp_add("MINUTE", "event_id", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")))
        rows.coalesce(1).write.mode("append").json(src)
        q = feed.feed_state_stream(spark.readStream.schema(kind).json(src), state, ckpt)
        q.processAllAvailable()
        q.stop()
    got = {r.ticket_id: r.route_path for r in spark.read.parquet(f"{state}/v=1").collect()}
    assert got == {"a": "y", "b": "x"}
