"""Reference unit expectations for the rule and text expressions."""

import json

from pyspark.sql import functions as F

from tixspark.functions import rules as R
from tixspark.functions import text as T


def _one(spark, col, **values):
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    df = spark.createDataFrame([tuple(values.values())], schema)
    return df.select(col.alias("x")).first().x


def test_keyword_category(spark):
    kc = R.keyword_category(F.col("t"))
    a = _one(spark, kc, t="Payment Gateway Timeout: checkout API returns 503 for card transactions")
    b = _one(spark, kc, t="VPN timeout and high latency through the office router")
    assert a.category == "Application" and a.confidence > 0.6
    assert b.category == "Network" and b.confidence > 0.6
    assert _one(spark, kc, t="nothing relevant").category == "Application"
    assert _one(spark, kc, t="the timeout again").confidence == 0.56


def test_security_and_review_reason(spark):
    sec = R.security_findings(F.col("t"))
    assert _one(spark, sec, t="VPN login fails after password reset") == []
    found = _one(spark, sec, t="VPN ticket includes password=TempPass123 in logs")
    assert found == ["Credential exposure"]
    reason = R.review_reason(F.col("t"), F.col("u"), F.col("i"), R.security_findings(F.col("t")))
    assert _one(spark, reason, t="VPN ticket includes password=TempPass123 in logs", u=3, i=3) == \
        "credential exposure requires security review"
    assert _one(spark, reason, t="Please arrange cafeteria lunch for the product event", u=3, i=3) == \
        "outside supported IT incident scope"
    assert _one(spark, reason, t="VPN login fails after password reset", u=3, i=3) is None
    assert _one(spark, reason, t="anything", u=1, i=3) == "critical urgency or impact requires human review"


def test_privacy_risk(spark):
    df = spark.createDataFrame(
        [([("EMAIL",), ("CREDENTIAL",)], 2, []), ([], 0, ["Credential exposure"]), ([("EMAIL",)], 1, [])],
        "findings array<struct<entity_type:string>>, n int, sec array<string>")
    got = [r.x for r in df.select(R.privacy_risk(F.col("findings"), F.col("n"), F.col("sec")).alias("x")).collect()]
    assert got == [0.43, 0.35, 0.14]


def test_clip_and_steps(spark):
    assert _one(spark, T.clip_text(F.col("t"), 0), t="abcdef") == ""
    assert _one(spark, T.clip_text(F.col("t"), 3), t="abcdef") == "abc"
    long = "word " * 10
    assert _one(spark, T.clip_text(F.col("t"), 19), t=long) == "word" + "\n[truncated]"
    steps = _one(spark, T.normalize_steps(F.col("t")), t="1. Restart the service\n2) Verify logs\n3 - Monitor")
    assert steps == ["Restart the service", "Verify logs", "Monitor"]


def test_lenient_json_and_decision(spark):
    payload = "```json\n" + json.dumps({"confidence_score": 0.82, "resolution_steps": ["a", " b "]}) + "\n```"
    d = _one(spark, T.model_decision(F.col("p")), p=payload)
    assert d.parsed and d.confidence == 0.82 and d.steps == ["a", "b"] and d.escalation_required is True
    assert _one(spark, F.to_json(T.lenient_json(F.col("p"))), p="[1,2]") == "{}"
    assert _one(spark, T.lenient_json(F.col("p")), p="no json here") is None


def test_category_and_groups(spark):
    assert _one(spark, R.normalize_category(F.col("c")), c=" software ") == "Application"
    assert _one(spark, R.normalize_category(F.col("c")), c="it-support") == "It-Support"
    assert _one(spark, R.normalize_category(F.col("c")), c="  ") == "Application"
    g = T.first_useful_group(F.col("a"), F.col("b"), F.col("c"))
    assert _one(spark, g, a="", b="Pending Review", c="Network Ops") == "Network Ops"
    assert _one(spark, g, a="", b="Pending Review", c="") == "Pending Review"


def test_steps_actionable(spark):
    ok = spark.createDataFrame([(["Restart the VPN", "Verify logs", "Monitor"],), (["Escalate to human reviewer", "x"],)],
                               "s array<string>")
    got = [r.x for r in ok.select(R.steps_actionable(F.col("s")).alias("x")).collect()]
    assert got == [True, False]


def test_rules_lower_a_text_once_and_look_for_patterns_only_where_they_can_match(spark):
    """``lower`` ran for each term, 25 times a text; it is most of the cost of texts that are not plain ASCII."""
    df = spark.createDataFrame([("BEARER ABCDEFGHIJKL1", 0), ("É api-key: s\u00e9cret99", 1), ("Pwd = hunter2x", 2), ("passwd:short secret=longenough", 3),
                                ("Passphrase: longenough", 4), ("bearer short api_key=1", 5), (None, 6), ("", 7), ("OAuth Token", 8)], "t string, i int")
    got = {r.i: r.s for r in df.select("i", R.security_findings(F.col("t")).alias("s")).collect()}
    assert got == {0: ["Bearer token exposure"], 1: ["API key exposure"], 2: ["Credential exposure"], 3: ["Credential exposure"], 4: [], 5: [],
                   6: [], 7: [], 8: ["OAuth token exposure"]}
    plan = df.select(R.security_findings(F.col("t")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(t#") == 1
