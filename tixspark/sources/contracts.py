"""Input contracts (SRC-2..4) and table schemas with additive alignment (SNK-9).

Validation never raises per row: every record gets the list of violated rules, and
callers split the frame into ``valid`` and ``rejected`` with a filter. The checks are
JSON/string predicates evaluated in the scan's projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import where_computed
from ..functions.rules import strip_ws
from ..functions.text import compose_raw_text

# --- fixed values: field sets and limits of the reference contracts --------------
INGEST_FIELDS = ("ticket_id", "number", "short_description", "description", "urgency", "impact", "category",
                 "assignment_group", "resolution", "raw_text", "metadata", "bypass_redpanda", "return_sanitized",
                 "source")
MAX_BODY_BYTES = 1 << 20
TICKET_LIMITS = (("ticket_id", 0, 128), ("number", 0, 128), ("short_description", 1, 300),
                 ("description", 1, 8000), ("category", 0, 120), ("assignment_group", 0, 160),
                 ("resolution", 0, 5000), ("source", 1, 80))
REVIEW_LIMITS = (("ticket_id", 1, 128), ("decision", 1, 40), ("reviewer", 1, 120), ("notes", 0, 5000),
                 ("corrected_category", 0, 120), ("corrected_assignment_group", 0, 160),
                 ("corrected_resolution", 0, 5000))
# -----------------------------------------------------------------------------------

#: JSON types that the decoder takes for a field; null leaves any field at its zero value.
INGEST_TYPES = dict.fromkeys(INGEST_FIELDS, "STRING") | {
    "urgency": "BIGINT", "impact": "BIGINT", "metadata": "OBJECT", "bypass_redpanda": "BOOLEAN", "return_sanitized": "BOOLEAN",
}
_SPARK_TYPES = {"STRING": "string", "BIGINT": "bigint", "BOOLEAN": "boolean"}


def _violations(checks: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(cond, F.lit(msg)) for cond, msg in checks]))


def validate_ingest(df: DataFrame, value_col: str = "value") -> DataFrame:
    """SRC-2: strict decode (unknown key, wrong JSON type, malformed JSON or body over 1 MiB →
    invalid payload), urgency/impact 0 or 1..3, non-blank composed text. ``metadata`` stays JSON. Adds ``msg`` (parsed
    struct), ``raw_text`` and ``reject_reason`` (NULL when valid)."""
    v = F.col(value_col)
    data = F.try_parse_json(v)
    fields = F.map_entries(F.when(F.schema_of_variant(data).startswith("OBJECT"), F.try_variant_get(data, "$", "map<string,variant>")))
    # Names are matched without regard to case, as the reference's decoder does.
    df = df.withColumn("__fields", fields)
    given = F.transform("__fields", lambda e: F.lower(e["key"]))
    unknown = F.size(F.array_except(given, F.array(*[F.lit(k) for k in INGEST_FIELDS]))) > 0

    def named(name: str) -> Column:
        return F.filter("__fields", lambda e: F.lower(e["key"]) == name)

    values, wrong = {}, F.lit(False)
    for name, kind in INGEST_TYPES.items():
        there = F.size(named(name)) > 0
        value = F.when(there, F.element_at(named(name), -1)["value"])
        found = F.schema_of_variant(value)
        wrong = wrong | (there & ~(found.startswith(kind) | (found == "VOID")))
        values[name] = F.when(found == "VOID", F.lit(None)).otherwise(value) if kind == "OBJECT" else F.try_variant_get(value, "$", _SPARK_TYPES[kind])
    values["metadata"] = F.to_json(values["metadata"])
    msg = F.struct(*[c.alias(n) for n, c in values.items()])
    bad_json = F.col("__fields").isNull() | (F.octet_length(v) > MAX_BODY_BYTES) | unknown | F.coalesce(wrong, F.lit(False))
    df = df.withColumn("__bad", bad_json).withColumn("msg", msg)
    msg, bad_json = F.col("msg"), F.col("__bad")
    u, i = msg["urgency"], msg["impact"]
    bad_range = ((F.coalesce(u, F.lit(0)) != 0) & ((u < 1) | (u > 3))) | \
        ((F.coalesce(i, F.lit(0)) != 0) & ((i < 1) | (i > 3)))
    raw = compose_raw_text(msg["raw_text"], msg["short_description"], msg["description"])
    reason = (F.when(bad_json, "invalid JSON payload")
              .when(bad_range, "urgency and impact must be between 1 and 3 when provided")
              .when(strip_ws(F.coalesce(raw, F.lit(""))) == "", "ticket text is required"))
    return df.withColumn("raw_text", raw).withColumn("reject_reason", reason).drop("__fields", "__bad")


def valid_rows(validated: DataFrame) -> DataFrame:
    """The rows of :func:`validate_ingest` without a reason to reject them; the messages are decoded once."""
    return where_computed(validated, F.col("reject_reason").isNull())


def _length_checks(limits) -> list[tuple[Column, str]]:
    checks = []
    for name, lo, hi in limits:
        c = F.col(name)
        if lo > 0:
            checks.append(((c.isNull()) | (F.length(c) < lo), f"{name}: at least {lo} characters"))
            checks.append((c.isNotNull() & (strip_ws(c) == ""), f"{name}: must not be blank"))
        checks.append((c.isNotNull() & (F.length(c) > hi), f"{name}: at most {hi} characters"))
    return checks


def extra_fields(value: Column, limits, more: tuple[str, ...] = ()) -> Column:
    """SRC-3/4: names in a JSON request that the contract does not know; such a request is rejected."""
    known = F.array(*[F.lit(n) for n in (*[x[0] for x in limits], *more)])
    return F.array_sort(F.array_except(F.coalesce(F.json_object_keys(value), F.array().cast("array<string>")), known))


def validate_ticket_request(df: DataFrame) -> DataFrame:
    """SRC-3: strip strings, apply defaults (urgency 3, impact 3, source 'api'), check
    lengths/ranges/blanks and unknown names; ``violations`` lists every broken rule."""
    s = df
    for name, _, _ in TICKET_LIMITS:
        s = s.withColumn(name, strip_ws(F.col(name)))
    s = (s.withColumn("urgency", F.coalesce("urgency", F.lit(3)).cast("int"))
         .withColumn("impact", F.coalesce("impact", F.lit(3)).cast("int"))
         .withColumn("source", F.coalesce("source", F.lit("api"))))
    checks = _length_checks(TICKET_LIMITS) + [
        ((F.col("urgency") < 1) | (F.col("urgency") > 3), "urgency: between 1 and 3"),
        ((F.col("impact") < 1) | (F.col("impact") > 3), "impact: between 1 and 3"),
    ]
    return s.withColumn("violations", _with_unknown(df, _violations(checks), TICKET_LIMITS, ("urgency", "impact")))


def _with_unknown(df: DataFrame, violations: Column, limits, more: tuple[str, ...] = ()) -> Column:
    """``violations`` and, where ``df`` has the request's JSON as ``value``, the names in it that the contract does not know."""
    if "value" not in df.columns:
        return violations
    return F.concat(violations, F.transform(extra_fields(F.col("value"), limits, more), lambda n: F.concat(F.lit("unknown field: "), n)))


def validate_review(df: DataFrame) -> DataFrame:
    """SRC-4: strip strings, required non-blank ids/decision/reviewer, length limits."""
    s = df
    for name, _, _ in REVIEW_LIMITS:
        s = s.withColumn(name, strip_ws(F.col(name)))
    return s.withColumn("violations", _with_unknown(df, _violations(_length_checks(REVIEW_LIMITS)), REVIEW_LIMITS))


# --- schemas and additive alignment (SNK-9) ----------------------------------------

DECISION_DEFAULTS: dict[str, tuple[str, object]] = {
    "sla_risk_score": ("double", 0.0), "sla_risk_level": ("string", ""), "resolver_group": ("string", ""),
    "resolver_confidence": ("double", 0.0), "knowledge_gap": ("int", 0), "knowledge_gap_reason": ("string", ""),
    "route_explanation": ("string", ""),
}
DECISION_COLUMNS = (
    ("ticket_id", "string"), ("assigned_category", "string"), ("suggested_resolution", "string"),
    ("confidence_score", "double"), ("classification_confidence", "double"), ("retrieval_similarity", "double"),
    ("verifier_score", "double"), ("privacy_risk", "double"), ("escalation_required", "int"),
    ("route_path", "string"), ("semantic_cache_hit", "int"), ("matched_ticket_id", "string"),
    ("sla_risk_score", "double"), ("sla_risk_level", "string"), ("resolver_group", "string"),
    ("resolver_confidence", "double"), ("knowledge_gap", "int"), ("knowledge_gap_reason", "string"),
    ("route_explanation", "string"), ("model_name", "string"), ("latency_ms", "bigint"),
    ("created_at", "timestamp_ntz"),
)


def align_schema(df: DataFrame, columns=DECISION_COLUMNS, defaults=DECISION_DEFAULTS) -> DataFrame:
    """Add missing columns with their declared defaults, cast, and order as declared;
    NULL in a defaulted column takes the default (the store's non-null semantics)."""
    out = []
    for name, typ in columns:
        if name in df.columns:
            c = F.col(name).cast(typ)
            if name in defaults:
                c = F.coalesce(c, F.lit(defaults[name][1]).cast(typ))
        elif name in defaults:
            c = F.lit(defaults[name][1]).cast(typ)
        else:
            c = F.lit(None).cast(typ)
        out.append(c.alias(name))
    return df.select(*out)


def split_valid(df: DataFrame, violations: str = "violations") -> tuple[DataFrame, DataFrame]:
    col = F.col(violations)
    ok = (F.size(col) == 0) if dict(df.dtypes).get(violations, "").startswith("array") else col.isNull()
    return df.where(ok), df.where(~ok)

