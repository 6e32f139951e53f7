"""Evidence, vote, risk and decision scoring over a ticket's retrieved list
(AGG-24..26, SCR-1..4, SCR-7..9, SCR-13..16, SCR-19, TXT-6/7/11, WIN-2/6/8).

``retrieved`` is an ``array<struct<rank, ticket_id, similarity, category,
assignment_group, resolution, source, ...>>`` sorted by rank and bounded by k, so
every vote and statistic is an in-row fold over at most k elements: no shuffle, no
group can grow with the data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import let, pyround
from ..settings import DEFAULT, Settings
from .rules import classifier_signals, normalize_category, risk_level, strip_ws

# --- fixed values: reference texts ---------------------------------------------------
POLICY_NONE = ("No approved retrieved evidence was available; the LLM must decide from the sanitized ticket and "
               "escalate when not grounded.")
POLICY_TEMPLATE = ("Semantic cache bypass is allowed only for an approved, resolved, non-Pending Review ticket at "
                   ">={thr:.2f}; all lower-confidence evidence must be evaluated by the LLM before resolution or "
                   "escalation.")
GAP_WEAK = "RAG evidence quality is {band}; LLM must treat retrieved context as low-confidence support"
GAP_VERIFIER = "LLM decision confidence is below grounding threshold"
GAP_NONE = "approved historical context has enough quality for LLM-grounded reasoning"
RESOLVER_DEFAULTS = (("Network", "Network Ops"), ("Access Management", "Identity and Access Management"),
                     ("Security", "Security Operations"), ("Database", "DBA Team"),
                     ("Storage", "Storage Operations"), ("Infrastructure", "Platform Engineering"),
                     ("Application", "Application Operations"))
PAYMENT_TERMS = ("payment", "checkout", "merchant", "orchestration")
VOTE_EXCLUDED_GROUPS = ("Pending Review", "IT Support")
PLAYBOOKS = {
    "Network": [
        "Classify as Network based on the reported connectivity symptoms.",
        "Collect affected user, location, VPN or network path, timestamps, and recent network changes.",
        "Check VPN gateway, DNS, routing, packet loss, and interface health before applying remediation.",
        "Route to Network Ops with the collected diagnostics and monitor for recurrence after the fix.",
    ],
    "Access Management": [
        "Classify as Access Management based on the login, permission, or MFA symptoms.",
        "Verify the requester identity, affected account, application, and required access level.",
        "Check identity provider status, group membership, MFA enrollment, and recent access-policy changes.",
        "Route to Identity and Access Management with the validation notes and confirm access restoration.",
    ],
    "Security": [
        "Classify as Security based on the reported security signal.",
        "Preserve relevant logs, timestamps, affected identities, and indicators of compromise.",
        "Check whether the issue is contained and whether any credentials or tokens need rotation.",
        "Route to Security Operations with evidence and recommended containment steps.",
    ],
    "Database": [
        "Classify as Database based on the data-store symptoms.",
        "Collect query errors, affected tables or services, timestamps, replication status, and recent changes.",
        "Check connection health, locks, slow queries, storage pressure, and replica lag.",
        "Route to the DBA team with diagnostics and validate the affected transaction or workflow.",
    ],
    "Storage": [
        "Classify as Storage based on disk, volume, backup, or capacity symptoms.",
        "Collect affected host, mount, volume, backup job, timestamps, and current capacity metrics.",
        "Check volume health, available capacity, recent expansion or backup failures, and related alerts.",
        "Route to Storage Operations with remediation notes and verify service recovery.",
    ],
    "Infrastructure": [
        "Classify as Infrastructure based on server, host, CPU, memory, or platform symptoms.",
        "Collect affected host, service, timestamps, resource metrics, and recent deployment or patch history.",
        "Check process health, capacity, logs, and platform alerts before applying remediation.",
        "Route to Platform Engineering with diagnostics and monitor the host after recovery.",
    ],
    "Application": [
        "Classify as Application based on the reported service or workflow symptoms.",
        "Collect affected workflow, user scope, timestamps, error messages, and recent release history.",
        "Check application logs, dependency health, queues, and configuration changes before remediation.",
        "Route to Application Operations with diagnostics and verify the workflow after recovery.",
    ],
}
ESCALATION_STEP_2 = "Do not apply a historical incident fix until a reviewer confirms the request is in scope."
ESCALATION_STEP_3 = "Collect the requester, business context, affected service, timestamps, and any supporting evidence."
VALIDATE_STEP = "Validate the fix with the affected user and monitor for recurrence."
RATIONALE_ESCALATE = "Fallback decision used because the LLM decision call was unavailable."
RATIONALE_GROUNDED = ("Deterministic fallback used an approved historical resolution because the LLM decision call "
                      "was unavailable.")
RATIONALE_PLAYBOOK = ("Deterministic fallback used a category playbook because the LLM decision call was unavailable "
                      "and no high-risk signal matched.")
AUTO_RESOLVE_RATIONALE = ("LLM requested review because evidence was sparse, but no policy, security, privacy, or "
                          "critical-risk signal matched.")
# -------------------------------------------------------------------------------------


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda s, x: s + x)


def weighted_vote(retrieved: Column, key, exclude: tuple[str, ...] = (), top: int = 1) -> Column:
    """AGG-24/25 + WIN-8 in-row: sum of max(similarity, 0) per key; ranked by weight desc,
    ties by first appearance (the reference's ``Counter.most_common``). Returns
    struct(ranked: array<struct(name, weight)> of the ``top`` best, total weight)."""
    def vote(kw: Column) -> Column:
        names = F.array_distinct(F.filter(F.transform(kw, lambda e: e["k"]),
                                          (lambda n: n.isNotNull() & (n != "") & ~n.isin(*exclude)) if exclude
                                          else (lambda n: n.isNotNull())))
        scored = F.transform(names, lambda n, i: F.struct(
            (-_sum(F.transform(F.filter(kw, lambda e: e["k"] == n), lambda e: e["w"]))).alias("neg"),
            i.alias("pos"), n.alias("name")))
        ranked = F.slice(F.array_sort(scored), 1, top)
        total = _sum(F.transform(scored, lambda r: -r["neg"]))
        return F.struct(F.transform(ranked, lambda r: F.struct(r["name"].alias("name"), (-r["neg"]).alias("weight")))
                        .alias("ranked"), total.alias("total"))

    # Keys (possibly a normalisation) and weights are computed once per element.
    keyed = F.transform(retrieved, lambda x: F.struct(key(x).alias("k"),
                                                      F.greatest(x["similarity"], F.lit(0.0)).alias("w")))
    return let(keyed, vote)


def fast_path_match(retrieved: Column, settings: Settings = DEFAULT) -> Column:
    """WIN-2: first retrieved row (rank order) at/above the cache threshold that is eligible."""
    ok = F.filter(retrieved, lambda x: (x["similarity"] >= settings.fast_path_similarity_threshold)
                  & x["source"].isin(*settings.approved_knowledge_sources)
                  & (x["assignment_group"] != "Pending Review") & (strip_ws(x["resolution"]) != ""))
    return F.get(ok, 0)


def rag_evidence(retrieved: Column, fast_match: Column, settings: Settings = DEFAULT) -> Column:
    """SCR-1..3 + AGG-26: the evidence pack as a struct. Intermediate values are bound
    once (``let``) so the vote and statistics are not re-evaluated per reference."""
    return let(F.struct(retrieved.alias("r"), fast_match.alias("f")),
               lambda b: _rag_evidence(b["r"], b["f"], settings))


def _rag_evidence(retrieved: Column, fast_match: Column, settings: Settings) -> Column:
    n = F.size(retrieved)

    def stats(v: Column) -> Column:
        sims = F.transform(retrieved, lambda x: clamp01(x["similarity"]))
        return F.struct(
            F.coalesce(F.get(sims, 0), F.lit(0.0)).alias("top"), (_sum(sims) / n).alias("avg"),
            (_sum(F.slice(sims, 1, 3)) / F.least(n, F.lit(3))).alias("top3"),
            (F.size(F.filter(retrieved, lambda x: strip_ws(x["resolution"]) != "")) / n).alias("coverage"),
            F.get(v["ranked"], 0)["name"].alias("dominant"),
            (F.get(v["ranked"], 0)["weight"] / F.when(v["total"] == 0, F.lit(1.0)).otherwise(v["total"]))
            .alias("consensus"))

    def pack(st: Column) -> Column:
        top, cons, cov = st["top"], st["consensus"], st["coverage"]
        quality = pyround(clamp01(0.45 * top + 0.20 * st["top3"] + 0.20 * cons + 0.15 * cov), 4)
        band = (F.when(fast_match.isNotNull() & (top >= settings.fast_path_similarity_threshold), "cache_ready")
                .when((top >= settings.rag_similarity_threshold) & (cons >= 0.45) & (cov >= 0.80), "strong")
                .when((top >= 0.50) & (cov >= 0.50), "usable").otherwise("weak"))
        items = F.transform(retrieved, lambda x: F.struct(
            x["ticket_id"].alias("ticket_id"), normalize_category(x["category"]).alias("category"),
            x["assignment_group"].alias("assignment_group"), x["source"].alias("source"),
            pyround(x["similarity"], 4).alias("similarity"),
            F.when(fast_match.isNotNull() & (x["ticket_id"] == fast_match["ticket_id"])
                   & (x["similarity"] >= settings.fast_path_similarity_threshold), "cache_candidate")
            .otherwise("supporting_context").alias("evidence_role"),
            (strip_ws(x["resolution"]) != "").alias("resolution_present")))
        return F.struct(
            quality.alias("quality_score"), band.alias("quality_band"), pyround(top, 4).alias("top_similarity"),
            pyround(st["avg"], 4).alias("average_similarity"), pyround(cons, 4).alias("category_consensus"),
            pyround(cov, 4).alias("resolution_coverage"), n.alias("evidence_count"),
            st["dominant"].alias("dominant_category"), items.alias("items"),
            F.lit(POLICY_TEMPLATE.format(thr=settings.fast_path_similarity_threshold)).alias("policy"),
            pyround(st["top3"], 4).alias("top3_average"))

    some = let(let(weighted_vote(retrieved, lambda x: normalize_category(x["category"])), stats), pack)
    empty_items = F.array().cast(
        "array<struct<ticket_id:string,category:string,assignment_group:string,source:string,similarity:double,"
        "evidence_role:string,resolution_present:boolean>>")
    none = F.struct(
        F.lit(0.0).alias("quality_score"), F.lit("none").alias("quality_band"), F.lit(0.0).alias("top_similarity"),
        F.lit(0.0).alias("average_similarity"), F.lit(0.0).alias("category_consensus"),
        F.lit(0.0).alias("resolution_coverage"), F.lit(0).alias("evidence_count"),
        F.lit(None).cast("string").alias("dominant_category"), empty_items.alias("items"),
        F.lit(POLICY_NONE).alias("policy"), F.lit(0.0).alias("top3_average"))
    return F.when(n > 0, some).otherwise(none)


def triage(retrieved: Column, keyword: Column) -> Column:
    """SCR-4: struct(category, confidence): vote on the raw retrieved categories (Q7),
    share clamped to [0.35, 0.98]; without retrieval the keyword category."""
    def winner(vote: Column) -> Column:
        win = F.get(vote["ranked"], 0)
        total = F.when(vote["total"] == 0, F.lit(1.0)).otherwise(vote["total"])
        share = F.greatest(F.lit(0.35), F.least(F.lit(0.98), win["weight"] / total))
        return F.struct(normalize_category(win["name"]).alias("category"), pyround(share, 4).alias("confidence"))

    return F.when(F.size(retrieved) > 0, let(weighted_vote(retrieved, lambda x: x["category"]), winner)) \
        .otherwise(F.struct(normalize_category(keyword["category"]).alias("category"),
                            pyround(keyword["confidence"], 4).alias("confidence")))


def resolver_recommendation(retrieved: Column, category: Column, raw_text: Column, sanitized_text: Column,
                            privacy_risk: Column) -> Column:
    """SCR-7: retrieval consensus over groups (2 excluded, Q26) with 3 alternates; else the
    category default with the payments and security overrides."""
    def consensus_of(vote: Column) -> Column:
        win = F.get(vote["ranked"], 0)
        total = F.when(vote["total"] == 0, F.lit(1.0)).otherwise(vote["total"])
        return F.when(F.size(vote["ranked"]) > 0, F.struct(
            win["name"].alias("group"), pyround(clamp01(win["weight"] / total), 4).alias("confidence"),
            F.lit("retrieval_consensus").alias("source"),
            F.transform(F.slice(vote["ranked"], 2, 3), lambda r: r["name"]).alias("alternates")))

    consensus = let(weighted_vote(retrieved, lambda x: x["assignment_group"], VOTE_EXCLUDED_GROUPS, top=4),
                    consensus_of)
    cat = normalize_category(category)
    combined = F.concat(F.lower(raw_text), F.lit("\n"), F.lower(sanitized_text))
    payments = F.lit(False)
    for t in PAYMENT_TERMS:
        payments = payments | combined.contains(t)
    defaults = F.create_map(*[F.lit(x) for kv in RESOLVER_DEFAULTS for x in kv])
    group = (F.when((cat == "Application") & payments, "Payments Engineering")
             .when((privacy_risk >= 0.35) & (cat == "Security"), "Security Operations")
             .otherwise(F.coalesce(F.try_element_at(defaults, cat), F.lit("Application Operations"))))
    fallback = F.struct(group.alias("group"), F.when(group != "IT Support", 0.62).otherwise(0.45).alias("confidence"),
                        F.lit("category_default").alias("source"), F.array().cast("array<string>").alias("alternates"))
    return F.coalesce(consensus, fallback)


def knowledge_gap_signal(band: Column, similarity: Column, verifier: Column, route_path: Column) -> Column:
    """SCR-8 (routing variant: verifier only on generative_rag, Q16)."""
    weak = band.isin("none", "weak")
    return (F.when(weak, F.struct(F.lit(True).alias("is_gap"),
                                  F.format_string(GAP_WEAK.replace("{band}", "%s"), band).alias("reason"),
                                  F.when((band == "none") | (similarity < 0.50), "critical").otherwise("elevated")
                                  .alias("severity")))
            .when(verifier.isNotNull() & (verifier < 0.70) & (route_path == "generative_rag"),
                  F.struct(F.lit(True).alias("is_gap"), F.lit(GAP_VERIFIER).alias("reason"),
                           F.lit("elevated").alias("severity")))
            .otherwise(F.struct(F.lit(False).alias("is_gap"), F.lit(GAP_NONE).alias("reason"),
                                F.lit("normal").alias("severity"))))


# --- fixed values: shares of the SLA pressure -----------------------------------------
SLA_SHARES = {"priority": 0.45, "doubt": 0.25, "thin_evidence": 0.15, "weak_check": 0.10, "privacy": 0.05}
ESCALATION_PRESSURE = 0.15
FULL_CHECK = 0.70
# -------------------------------------------------------------------------------------


def sla_pressure(urgency: Column, impact: Column, confidence: Column, similarity: Column, verifier: Column, privacy_risk: Column,
                 escalated: Column, evidence_floor: float, unset_check: float | None = None) -> Column:
    """SCR-9, SCR-10: the SLA risk from 0 to 1. A verifier of 0 counts as ``unset_check`` where that is given (Q15)."""
    if unset_check is not None:
        verifier = F.coalesce(F.nullif(verifier, F.lit(0.0)), F.lit(unset_check))

    def short_of(value: Column, wanted: float) -> Column:
        return F.greatest(F.lit(0.0), wanted - value) / max(wanted, 0.01)

    parts = {
        "priority": (8 - urgency - impact) / 6.0, "doubt": 1.0 - clamp01(confidence), "thin_evidence": short_of(similarity, evidence_floor),
        "weak_check": short_of(verifier, FULL_CHECK), "privacy": privacy_risk,
    }
    total = reduce(lambda a, b: a + b, [SLA_SHARES[name] * part for name, part in parts.items()])
    return pyround(clamp01(total + F.when(escalated, ESCALATION_PRESSURE).otherwise(0.0)), 4)


def sla_risk_routing(urgency: Column, impact: Column, confidence: Column, similarity: Column, verifier: Column,
                     privacy_risk: Column, escalated: Column, settings: Settings = DEFAULT) -> Column:
    """SCR-9 + SCR-11: struct(score, level) of a ticket that is being routed."""
    s = sla_pressure(urgency, impact, confidence, similarity, verifier, privacy_risk, escalated, settings.rag_similarity_threshold, FULL_CHECK)
    return F.struct(s.alias("score"), risk_level(s).alias("level"))


def final_confidence(classification: Column, quality: Column, similarity: Column, modifier: Column) -> Column:
    """SCR-13."""
    return pyround(clamp01(0.35 * classification + 0.35 * clamp01(quality)
                           + 0.20 * F.greatest(F.lit(0.0), similarity) + 0.10 * modifier), 4)


def grounding_score(top_similarity: Column, has_steps: Column, failure: bool = False) -> Column:
    """SCR-19: heuristic verifier (0.72/0.45), or its failure variant (0.70/0.42)."""
    if failure:
        return F.when((top_similarity >= 0.50) & has_steps, 0.70).otherwise(0.42)
    return F.when((top_similarity >= 0.35) & has_steps, 0.72).otherwise(0.45)


def playbook_steps(category: Column) -> Column:
    m = F.create_map(*[x for name, steps in PLAYBOOKS.items()
                       for x in (F.lit(name), F.array(*[F.lit(s) for s in steps]))])
    return F.coalesce(F.try_element_at(m, category), F.try_element_at(m, F.lit("Application")))


def escalation_steps(reason: Column) -> Column:
    first = F.when(reason.isNotNull() & (reason != ""),
                   F.concat(F.lit("Route this ticket to human support triage: "), reason)) \
        .otherwise(F.lit("Route this ticket to human support triage."))
    return F.array(first, F.lit(ESCALATION_STEP_2), F.lit(ESCALATION_STEP_3))


def fallback_decision(category: Column, retrieved: Column, policy_signal: Column) -> Column:
    """SCR-15: the deterministic decision (escalate iff a policy signal; confidences
    0.42 / 0.62 / 0.58; steps from the signal, the top match or the category playbook)."""
    top = F.get(retrieved, 0)
    escalate = policy_signal.isNotNull()
    grounded = top.isNotNull() & (strip_ws(top["resolution"]) != "")
    from_top = F.array(F.format_string("Classify as %s and compare with similar incident %s.", category,
                                       top["ticket_id"]), top["resolution"], F.lit(VALIDATE_STEP))
    steps = (F.when(escalate, escalation_steps(policy_signal))
             .when(top.isNotNull(), from_top).otherwise(playbook_steps(category)))
    conf = F.when(escalate, 0.42).when(grounded, 0.62).otherwise(0.58)
    rationale = F.when(escalate, RATIONALE_ESCALATE).when(grounded, RATIONALE_GROUNDED).otherwise(RATIONALE_PLAYBOOK)
    return F.struct(steps.alias("steps"), escalate.alias("escalation_required"), conf.alias("confidence"),
                    rationale.alias("rationale"))


def complete_steps(decision: Column, category: Column, retrieved: Column) -> Column:
    """TXT-5: a model decision whose steps are empty gets the escalation steps or the fallback's."""
    instead = F.when(decision["escalation_required"], escalation_steps(decision["rationale"])).otherwise(
        fallback_decision(category, retrieved, F.lit(None).cast("string"))["steps"])
    return decision.withField("steps", F.when(F.size(decision["steps"]) > 0, decision["steps"]).otherwise(instead))


def should_auto_resolve(decision: Column, review_reason: Column, urgency: Column, impact: Column,
                        privacy_risk: Column, security: Column) -> Column:
    """SCR-16: override a requested review when nothing risky is present."""
    from .rules import rationale_requires_review, steps_actionable

    return (decision["escalation_required"] & review_reason.isNull() & (urgency != 1) & (impact != 1)
            & (privacy_risk < 0.35) & (F.size(security) == 0) & (decision["confidence"] < 0.70)
            & ~rationale_requires_review(decision["rationale"]) & steps_actionable(decision["steps"]))


def _f2(c: Column) -> Column:
    """Python's ``f"{x:.2f}"`` (exact half-even rounding first; Java's %.2f rounds half-up)."""
    return F.format_string("%.2f", pyround(c, 2))


def route_explanation(assigned_category: Column, classification: Column, sanitized: Column, security: Column,
                      redacted_count: Column, privacy_risk: Column, matched: Column, similarity: Column,
                      route_path: Column, cache_hit: Column, escalated: Column, rationale: Column,
                      evidence: Column, resolver: Column, confidence: Column, sla: Column, gap: Column) -> Column:
    """TXT-11: the nine explanation rows stored with each decision."""
    def row(label, value, impact):
        return F.struct(F.lit(label).alias("label"), value.alias("value"), impact.alias("impact"))

    has_sec = F.size(security) > 0
    route_impact = (F.when(cache_hit, F.lit("approved historical resolution returned without invoking the LLM"))
                    .when(escalated, F.coalesce(F.when(rationale != "", rationale),
                                                F.lit("LLM decision requires human review")))
                    .otherwise(F.coalesce(F.when(rationale != "", rationale),
                                          F.lit("retrieved context was attached to the prompt and resolved by the LLM"))))
    return F.array(
        row("Classifier agent", F.concat(assigned_category, F.lit(" at "), _f2(classification)),
            classifier_signals(sanitized)),
        row("Security agent",
            F.when(has_sec, F.array_join(security, ", ")).otherwise(F.concat(redacted_count.cast("string"),
                                                                             F.lit(" redactions"))),
            F.when(has_sec, F.format_string("privacy risk %.2f; credentials force reviewer visibility", pyround(privacy_risk, 2)))
            .otherwise(F.lit("only sanitized text is available to retrieval and model calls"))),
        row("Nearest approved ticket", F.concat(F.coalesce(matched, F.lit("none")), F.lit(" at "), _f2(similarity)),
            F.lit("similarity only controls the >=0.95 semantic cache bypass; otherwise the LLM decides")),
        row("Route branch", route_path, route_impact),
        row("RAG evidence pack", F.concat(evidence["quality_band"], F.lit(" at "), _f2(evidence["quality_score"])),
            F.format_string("%d approved tickets; category consensus %.2f", evidence["evidence_count"],
                            pyround(evidence["category_consensus"], 2))),
        row("Resolver recommendation", F.concat(resolver["group"], F.lit(" at "), _f2(resolver["confidence"])),
            F.concat(F.lit("source: "), resolver["source"])),
        row("Confidence formula", _f2(confidence),
            F.lit("35% classifier + 35% RAG quality + 20% historical similarity + 10% risk modifier")),
        row("SLA risk", F.concat(sla["level"], F.lit(" at "), _f2(sla["score"])),
            F.lit("priority, confidence, retrieval gap, LLM confidence gap, and privacy risk combined")),
        row("Knowledge coverage", F.when(gap["is_gap"], "gap detected").otherwise("covered"), gap["reason"]),
    )


def evidence_summary(evidence: Column) -> Column:
    """TXT-6: compact ASCII JSON of the evidence pack (9 keys + at most 5 items of 6 keys)."""
    keys = ("ticket_id", "category", "assignment_group", "similarity", "evidence_role", "resolution_present")
    items = F.transform(F.slice(evidence["items"], 1, 5), lambda x: F.struct(*[x[k].alias(k) for k in keys]))
    return F.when(evidence.isNull(), F.lit("No RAG evidence pack was provided.")).otherwise(F.to_json(F.struct(
        evidence["quality_score"].alias("quality_score"), evidence["quality_band"].alias("quality_band"),
        evidence["top_similarity"].alias("top_similarity"), evidence["average_similarity"].alias("average_similarity"),
        evidence["category_consensus"].alias("category_consensus"),
        evidence["resolution_coverage"].alias("resolution_coverage"), evidence["evidence_count"].alias("evidence_count"),
        evidence["dominant_category"].alias("dominant_category"), evidence["policy"].alias("policy"),
        items.alias("items")), {"ignoreNullFields": "false", "writeNonAsciiCharacterAsCodePoint": "true"}))


def context_pack(retrieved: Column, limit: int, max_chars: int, resolutions_only: bool = False) -> Column:
    """TXT-7 + WIN-6: ranked items rendered into chunks inside a running character budget;
    the chunk that crosses the budget is clipped, and the fold stops when it is spent."""
    from .text import clip_text

    def chunk(x: Column) -> Column:
        if resolutions_only:
            return F.concat(x["ticket_id"], F.lit(": "), x["resolution"])
        return F.format_string("Past ticket %s (%s, score=%.2f):\nSymptoms: %s\nResolution: %s", x["ticket_id"],
                               x["category"], pyround(x["similarity"], 2), x["sanitized_text"], x["resolution"])

    init = F.struct(F.lit(max_chars).alias("remaining"), F.lit(False).alias("done"),
                    F.array().cast("array<string>").alias("chunks"))

    def step(acc: Column, x: Column) -> Column:
        c = clip_text(chunk(x), F.greatest(acc["remaining"], F.lit(0)))
        stop = acc["done"] | (c == "")
        return F.struct(
            F.when(stop, acc["remaining"]).otherwise(acc["remaining"] - F.length(c)).alias("remaining"),
            stop.alias("done"),
            F.when(stop, acc["chunks"]).otherwise(F.concat(acc["chunks"], F.array(c))).alias("chunks"))

    folded = F.aggregate(F.slice(retrieved, 1, limit), init, step)
    return F.array_join(folded["chunks"], "\n\n")
