"""Shared building blocks of the read-side plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import pyround
from ..functions.rules import risk_level  # noqa: F401  (part of the plans' building blocks)
from ..operators.latest import latest_by_key

TICKET_VALUES = (
    "number", "short_description", "description", "sanitized_text", "category", "assignment_group",
    "resolution", "urgency", "impact", "source",
)
DECISION_VALUES = (
    "assigned_category", "confidence_score", "classification_confidence", "retrieval_similarity",
    "verifier_score", "privacy_risk", "escalation_required", "route_path", "semantic_cache_hit",
    "matched_ticket_id", "model_name", "latency_ms", "sla_risk_score", "sla_risk_level", "resolver_group",
    "resolver_confidence", "knowledge_gap", "knowledge_gap_reason",
)
STATUSES = ("unrouted", "resolved", "semantic_cache_resolved", "human_review_required")


def check_bound(name: str, value: int | None, lo: int, hi: int) -> None:
    """FLT-11: API parameter bounds."""
    if value is not None and not lo <= value <= hi:
        raise ValueError(f"{name} must be in [{lo}, {hi}], got {value}")


def latest_tickets(tickets: DataFrame, values=TICKET_VALUES) -> DataFrame:
    # Tie-break equal timestamps by a hash of short identifying columns so the pick is
    # deterministic without hashing long text.
    return latest_by_key(
        tickets, "ticket_id", ["created_at", F.xxhash64("number", "short_description")], list(values),
        latest_alias="latest_created_at",
    )


def latest_decisions(decisions: DataFrame, values=DECISION_VALUES, alias="latest_routed_at") -> DataFrame:
    return latest_by_key(decisions, "ticket_id", ["created_at", "event_id"], list(values), latest_alias=alias)


def spread_key(key: Column, own_id: Column) -> Column:
    """``key`` for a left join; blank keys become keys of their own that match nothing.

    A quarter of the decisions have no matched ticket. Their rows would all meet in one task.
    """
    return F.when(key.isNotNull() & (key != ""), key).otherwise(F.concat(F.lit("\u0000"), F.coalesce(own_id, F.lit(""))))


def ticket_status(decision_key: Column, escalated: Column, cache_hit: Column) -> Column:
    """PRJ-4: status of a ticket from its (possibly missing) latest decision."""
    return (
        F.when(decision_key.isNull(), "unrouted")
        .when(escalated == 1, "human_review_required")
        .when(cache_hit == 1, "semantic_cache_resolved")
        .otherwise("resolved")
    )


def r4(c: Column | str) -> Column:
    return pyround(F.col(c) if isinstance(c, str) else c, 4)


def r1(c: Column | str) -> Column:
    return pyround(F.col(c) if isinstance(c, str) else c, 1)


def safe_ratio(num: Column, den: Column) -> Column:
    """0 when the denominator is 0, else round(num/den, 4)."""
    return F.when(den == 0, F.lit(0.0)).otherwise(pyround(num.cast("double") / den, 4))
