"""Classification and policy rules as column expressions (CLS-1..6, PRJ-3, SCR-5/6).

All rules are ``contains`` disjunctions or ``rlike`` on ``lower(text)`` inside
``when`` chains, so they compile into whole-stage codegen with the scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import let, pyround

# --- fixed values: term lists and labels of the reference ---------------------------
KEYWORD_RULES: tuple[tuple[tuple[str, ...], str, float], ...] = (
    (("api", "application", "app", "gateway", "payment", "portal", "service", "transfer", "upload", "checkout",
      "transaction", "500", "503"), "Application", 0.66),
    (("vpn", "network", "latency", "router", "switch", "dns", "packet"), "Network", 0.62),
    (("timeout",), "Network", 0.56),
    (("access", "permission", "login", "mfa", "password"), "Access Management", 0.62),
    (("database", "sql", "query", "replication"), "Database", 0.58),
    (("disk", "storage", "backup", "volume"), "Storage", 0.58),
    (("malware", "phishing", "vulnerability", "token"), "Security", 0.60),
    (("server", "cpu", "memory", "host"), "Infrastructure", 0.58),
)
KEYWORD_DEFAULT = ("Application", 0.45)

SECURITY_RULES: tuple[tuple[str, tuple[str, ...], str | None], ...] = (
    ("Bearer token exposure", ("bearer token", "authorization: bearer", "unredacted bearer"),
     r"\bbearer\s+[a-z0-9._~+/=\-]{12,}"),
    ("OAuth token exposure", ("oauth token", "oauth refresh token", "refresh token exposed", "refresh token leaked"),
     None),
    ("API key exposure", ("api key exposed", "api key leaked", "apikey exposed", "api_key exposed"),
     r"\bapi[_-]?key\s*[:=]\s*[^\s,;]{6,}"),
    ("JWT exposure", ("jwt exposed", "jwt leaked", "json web token exposed", "json web token leaked"), None),
    ("Credential exposure", ("credential exposure", "credentials exposed", "credential leaked", "credentials leaked",
                             "password exposed", "password leaked", "hardcoded password", "hardcoded secret"),
     r"\b(?:password|passwd|pwd|secret)\s*[:=]\s*[^\s,;]{6,}"),
)

#: One of these is in any text that a pattern of SECURITY_RULES matches, and is found much faster.
SECURITY_NEEDED = dict(zip([rx for _, _, rx in SECURITY_RULES if rx], (("bearer",), ("api",), ("password", "passwd", "pwd", "secret"))))

OUT_OF_SCOPE_TERMS = ("cafeteria", "lunch", "catering", "company event", "office event", "facility", "facilities",
                      "office admin", "travel", "payroll", "human resources", "procurement", "purchase order")
HIGH_RISK_TERMS = ("unauthorized", "bulk export", "another merchant", "corruption", "production restore", "privileged",
                   "oauth", "audit logs", "duplicate payment", "duplicate charge", "fee calculation mismatch",
                   "different total", "financial discrepancies", "incorrect processing rates", "outage across",
                   "queue depth", "crashing", "security", "compliance")
REASON_CRITICAL = "critical urgency or impact requires human review"
REASON_CREDENTIAL = "credential exposure requires security review"
REASON_SCOPE = "outside supported IT incident scope"
REASON_RISK = "security, compliance, payment, or production-risk signal matched"

SIGNAL_TERMS = ("checkout", "payment", "orchestration", "oauth", "deadlock", "replica lag", "timeout", "database", "waf")
SIGNAL_DEFAULT = "keyword and retrieved-category signals"

RATIONALE_REVIEW_TERMS = ("human authorization", "manual authorization", "outside supported", "outside it", "security",
                          "compliance", "privacy", "credential", "token", "payment", "financial", "data integrity",
                          "production risk", "critical")
BLOCKED_STEP_TERMS = ("human review", "human support triage", "reviewer", "manual review", "escalate to human")

CATEGORY_MAP = (("software", "Application"), ("application", "Application"), ("hardware", "Infrastructure"),
                ("network", "Network"), ("access", "Access Management"), ("security", "Security"),
                ("database", "Database"), ("storage", "Storage"), ("infrastructure", "Infrastructure"))

SENSITIVE_ENTITIES = ("BEARER_TOKEN", "CREDENTIAL", "API_KEY", "AWS_ACCESS_KEY", "PRIVATE_KEY", "JWT", "OAUTH_TOKEN")
PERSONAL_ENTITIES = ("ACCOUNT_ID", "EMAIL", "PHONE_NUMBER")
# -------------------------------------------------------------------------------------


def any_term(lowered: Column, terms: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [lowered.contains(t) for t in terms])


def strip_ws(c: Column) -> Column:
    """Python ``str.strip()`` for ASCII whitespace (Q20)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def keyword_category(text: Column) -> Column:
    """CLS-1: struct(category, confidence) from the first matching rule."""
    low = F.lower(text)
    chain = None
    for terms, cat, conf in KEYWORD_RULES:
        val = F.struct(F.lit(cat).alias("category"), F.lit(conf).alias("confidence"))
        chain = F.when(any_term(low, terms), val) if chain is None else chain.when(any_term(low, terms), val)
    return chain.otherwise(F.struct(F.lit(KEYWORD_DEFAULT[0]).alias("category"),
                                    F.lit(KEYWORD_DEFAULT[1]).alias("confidence")))


def security_findings(raw_text: Column) -> Column:
    """CLS-2: labels found in the *raw* lowered text (Q13), in rule order."""
    def labels(low: Column) -> Column:
        found = []
        for label, terms, rx in SECURITY_RULES:
            cond = any_term(low, terms)
            if rx:
                cond = cond | (any_term(low, SECURITY_NEEDED[rx]) & low.rlike(rx))
            found.append(F.when(cond, F.lit(label)))
        return F.array_compact(F.array(*found))

    return let(F.lower(raw_text), labels)


def review_reason(sanitized_text: Column, urgency: Column, impact: Column, security: Column) -> Column:
    """CLS-3: first policy reason, NULL when none."""
    low = F.lower(sanitized_text)
    return (F.when((urgency == 1) | (impact == 1), REASON_CRITICAL)
            .when(F.size(security) > 0, REASON_CREDENTIAL)
            .when(any_term(low, OUT_OF_SCOPE_TERMS), REASON_SCOPE)
            .when(any_term(low, HIGH_RISK_TERMS), REASON_RISK))


def classifier_signals(sanitized_text: Column) -> Column:
    """CLS-4: first five present signal terms joined by ', ', else the default text."""
    present = let(F.lower(sanitized_text), lambda low: F.filter(F.array(*[F.lit(t) for t in SIGNAL_TERMS]), lambda t: low.contains(t)))
    return F.when(F.size(present) > 0, F.array_join(F.slice(present, 1, 5), ", ")).otherwise(F.lit(SIGNAL_DEFAULT))


def rationale_requires_review(rationale: Column) -> Column:
    """CLS-5."""
    return any_term(F.lower(F.coalesce(rationale, F.lit(""))), RATIONALE_REVIEW_TERMS)


def steps_actionable(steps: Column) -> Column:
    """CLS-6: at least two non-blank steps and no blocked phrase in the space-joined text."""
    non_blank = F.size(F.filter(steps, lambda s: strip_ws(s) != ""))
    combined = F.array_join(F.transform(steps, lambda s: F.lower(s)), " ")
    return (non_blank >= 2) & ~any_term(combined, BLOCKED_STEP_TERMS)


def python_title(c: Column) -> Column:
    """Python ``str.title()``: upper after an uncased character, lower after a cased one (Q9)."""
    def title(chars: Column) -> Column:
        return F.array_join(F.transform(chars, lambda ch, i: F.when(
            (i == 0) | (F.upper(F.get(chars, i - 1)) == F.lower(F.get(chars, i - 1))), F.upper(ch))
            .otherwise(F.lower(ch))), "")

    # A character is cased when upper and lower forms differ (Python's notion).
    return let(F.split(c, ""), title)


def normalize_category(category: Column) -> Column:
    """PRJ-3: known names map, others title-cased, blank → Application."""
    stripped = strip_ws(F.coalesce(category, F.lit("")))
    key = F.lower(stripped)
    mapping = F.create_map(*[F.lit(x) for kv in CATEGORY_MAP for x in kv])
    return F.coalesce(F.try_element_at(mapping, key),
                      F.when(stripped != "", python_title(stripped)), F.lit("Application"))


def entity_weight(entity_type: Column) -> Column:
    up = F.upper(F.coalesce(entity_type, F.lit("")))
    return (F.when(up.isin(*SENSITIVE_ENTITIES), 0.35).when(up.isin(*PERSONAL_ENTITIES), 0.10)
            .when(up != "", 0.05).otherwise(0.0))


def privacy_risk(findings: Column, redacted_count: Column, security: Column) -> Column:
    """SCR-5: max entity weight vs explicit exposure, plus a count term, capped at 0.95."""
    entity = F.aggregate(findings, F.lit(0.0), lambda acc, f: F.greatest(acc, entity_weight(f["entity_type"])))
    count_risk = F.least(F.lit(0.20), redacted_count * 0.04)
    exposure = F.when(F.size(security) > 0, 0.35).otherwise(0.0)
    return pyround(F.least(F.lit(0.95), F.greatest(entity, exposure) + count_risk), 4)


def risk_modifier(risk: Column) -> Column:
    """SCR-6."""
    return F.when(risk >= 0.35, 0.40).when(risk > 0.15, 0.70).otherwise(1.0)


def risk_level(score: Column) -> Column:
    """SCR-11: the band of a risk score."""
    return F.when(score >= 0.75, "critical").when(score >= 0.55, "elevated").when(score >= 0.35, "watch").otherwise("normal")
