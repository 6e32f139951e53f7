"""Reference workflow expectations for the in-row scoring functions."""

from pyspark.sql import functions as F

from tixspark.functions import rules as R
from tixspark.functions import scoring as S

RET = ("array<struct<rank:int,ticket_id:string,similarity:double,category:string,assignment_group:string,"
       "resolution:string,source:string,sanitized_text:string>>")


def _ret(spark, items):
    rows = [(i + 1, *it) for i, it in enumerate(items)]
    return spark.createDataFrame([(rows,)], f"r {RET}")


def test_evidence_strong_supporting(spark):
    df = _ret(spark, [("T1", 0.82, "Application", "App Ops", "Restart the pod", "curated", "a"),
                      ("T2", 0.76, "Application", "App Ops", "Flush the cache", "historical", "b")])
    r = F.col("r")
    ev = df.select(S.rag_evidence(r, S.fast_path_match(r)).alias("e")).first().e
    assert ev.quality_band == "strong" and ev.dominant_category == "Application"
    assert [i.evidence_role for i in ev.items] == ["supporting_context", "supporting_context"]
    want = round(max(0.0, min(1.0, 0.45 * 0.82 + 0.20 * (0.82 + 0.76) / 2 + 0.20 * 1.0 + 0.15 * 1.0)), 4)
    assert ev.quality_score == want


def test_cache_candidate_and_none(spark):
    df = _ret(spark, [("T9", 0.97, "network", "Network Ops", "Reset VPN", "curated", "x")])
    r = F.col("r")
    ev = df.select(S.rag_evidence(r, S.fast_path_match(r)).alias("e")).first().e
    assert ev.quality_band == "cache_ready" and ev.items[0].evidence_role == "cache_candidate"
    empty = spark.createDataFrame([([],)], f"r {RET}")
    ev0 = empty.select(S.rag_evidence(r, S.fast_path_match(r)).alias("e")).first().e
    assert ev0.quality_band == "none" and ev0.evidence_count == 0


def test_final_confidence_formula(spark):
    got = spark.range(1).select(S.final_confidence(F.lit(0.90), F.lit(0.91), F.lit(0.94), F.lit(1.0)).alias("c")).first().c
    assert got == round(0.35 * 0.90 + 0.35 * 0.91 + 0.20 * 0.94 + 0.10, 4)


def test_resolver_payments_fallback(spark):
    df = spark.createDataFrame([([],)], f"r {RET}")
    rec = df.select(S.resolver_recommendation(F.col("r"), F.lit("Application"),
                                              F.lit("Checkout payment fails at merchant portal"), F.lit(""),
                                              F.lit(0.0)).alias("x")).first().x
    assert rec.group == "Payments Engineering" and rec.source == "category_default" and rec.confidence == 0.62


def test_resolver_vote_excludes_groups(spark):
    df = _ret(spark, [("A", 0.9, "Network", "IT Support", "r", "curated", ""),
                      ("B", 0.8, "Network", "Network Ops", "r", "curated", ""),
                      ("C", 0.7, "Network", "DBA Team", "r", "curated", ""),
                      ("D", 0.6, "Network", "Network Ops", "r", "curated", "")])
    rec = df.select(S.resolver_recommendation(F.col("r"), F.lit(""), F.lit(""), F.lit(""), F.lit(0.0)).alias("x")).first().x
    assert rec.group == "Network Ops" and rec.alternates == ["DBA Team"]
    assert rec.confidence == round(1.4 / 2.1, 4)


def test_auto_resolve_requested_review(spark):
    decision = F.struct(F.array(F.lit("Restart the VPN client"), F.lit("Verify the tunnel"), F.lit("Monitor")).alias("steps"),
                        F.lit(True).alias("escalation_required"), F.lit(0.20).alias("confidence"),
                        F.lit("evidence is sparse").alias("rationale"))
    auto = S.should_auto_resolve(decision, F.lit(None).cast("string"), F.lit(3), F.lit(3), F.lit(0.0),
                                 F.array().cast("array<string>"))
    assert spark.range(1).select(auto.alias("a")).first().a is True


def test_fallback_decisions(spark):
    df = _ret(spark, [("T1", 0.8, "Network", "Network Ops", "Reset the VPN profile", "curated", "")])
    r = F.col("r")
    esc = df.select(S.fallback_decision(F.lit("Network"), r, F.lit("outside supported IT incident scope")).alias("d")).first().d
    assert esc.escalation_required and esc.confidence == 0.42 and "outside supported" in esc.steps[0]
    grounded = df.select(S.fallback_decision(F.lit("Network"), r, F.lit(None).cast("string")).alias("d")).first().d
    assert grounded.confidence == 0.62 and grounded.steps[1] == "Reset the VPN profile"
    empty = spark.createDataFrame([([],)], f"r {RET}")
    play = empty.select(S.fallback_decision(F.lit("Storage"), r, F.lit(None).cast("string")).alias("d")).first().d
    assert play.confidence == 0.58 and play.steps[0].startswith("Classify as Storage")


def test_context_budget(spark):
    df = _ret(spark, [("T1", 0.8, "Network", "G", "fix one", "curated", "x" * 100),
                      ("T2", 0.7, "Network", "G", "fix two", "curated", "y" * 100)])
    ctx = df.select(S.context_pack(F.col("r"), 5, 150).alias("c")).first().c
    assert ctx.startswith("Past ticket T1 (Network, score=0.80):") and len(ctx) <= 150 + 2
    assert "T2" not in ctx


def test_privacy_review_reason_integration(spark):
    sec = R.security_findings(F.lit("VPN ticket includes password=TempPass123 in logs"))
    assert spark.range(1).select(R.risk_modifier(R.privacy_risk(
        F.array().cast("array<struct<entity_type:string>>"), F.lit(0), sec)).alias("m")).first().m == 0.40
