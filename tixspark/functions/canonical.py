"""One record from the shapes that services return (PRJ-10).

A payload is a VARIANT: a search row (flat), a ticket detail (``ticket``, ``routing`` and
``matched_ticket`` objects) or a routing response (``confidence_components``, ``sla_risk`` and other
objects). ``PRECEDENCE`` says where each field may stand; the first place that is neither missing, null nor an
empty text wins. Numbers may come as texts. Everything is one expression over the payload, in the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import risk_modifier
from .text import as_number

# --- fixed values: where each field may stand, first come first served -------------------
PRECEDENCE = {
    "ticket_id": ("ticket_id", "ticket.ticket_id", "routing.ticket_id", "id", "ticket.id"),
    "short_description": ("short_description", "ticket.short_description", "routing.short_description"),
    "description": ("description", "ticket.description", "ticket.sanitized_text", "sanitized_text"),
    "resolution": ("resolution", "ticket.resolution", "ticket.stored_resolution", "stored_resolution"),
    "category": ("category", "ticket.category", "routing.assigned_category", "assigned_category"),
    "assigned_category": ("assigned_category", "routing.assigned_category", "ticket.category", "category"),
    "route_path": ("route_path", "routing.route_path"),
    "matched_ticket_id": ("matched_ticket_id", "routing.matched_ticket_id", "matched_ticket.ticket_id", "routing.matched_ticket.ticket_id"),
    "sla_risk_level": ("sla_risk.level", "routing.sla_risk.level", "sla_risk_level", "routing.sla_risk_level"),
    "status": ("status", "ticket.status", "routing.status"),
    "created_at": ("created_at", "ticket.created_at", "routing.created_at"),
}
NUMBERS = {
    "confidence_score": ("confidence_score", "routing.confidence_score"),
    "classification": ("confidence_components.classification", "confidence_components.classification_confidence",
                       "routing.confidence_components.classification", "routing.confidence_components.classification_confidence",
                       "classification_confidence", "routing.classification_confidence"),
    "retrieval_similarity": ("retrieval_similarity", "routing.retrieval_similarity", "confidence_components.retrieval_similarity",
                             "routing.confidence_components.retrieval_similarity", "matched_ticket.retrieval_similarity"),
    "rag_evidence_quality": ("confidence_components.rag_evidence_quality", "routing.confidence_components.rag_evidence_quality",
                             "rag_evidence.quality_score", "routing.rag_evidence.quality_score"),
    "verifier_score": ("verifier_score", "routing.verifier_score", "confidence_components.verifier_score", "routing.confidence_components.verifier_score"),
    "privacy_risk": ("privacy_risk", "routing.privacy_risk", "confidence_components.privacy_risk", "routing.confidence_components.privacy_risk"),
    "redacted_entities_count": ("redacted_entities_count", "routing.redacted_entities_count"),
}
GROUPS = ("assignment_group", "ticket.assignment_group", "routing.assignment_group", "resolver_group", "routing.resolver_group",
          "resolver_recommendation.group", "routing.resolver_recommendation.group", "matched_ticket.assignment_group")
PENDING, UNNAMED = "pending review", "—"
# -------------------------------------------------------------------------------------------


def text_at(payload: Column, *paths: str) -> Column:
    """The first value at ``paths`` as a text, null or empty ones passed over. An object or array is its JSON."""
    found = [F.try_variant_get(payload, f"$.{p}", "string") for p in paths]
    return F.coalesce(*[F.when(f != "", f) for f in found])


def object_at(payload: Column, path: str) -> Column:
    """Whether an object stands at ``path``."""
    return F.coalesce(F.schema_of_variant(F.try_variant_get(payload, f"$.{path}", "variant")).startswith("OBJECT"), F.lit(False))


def number_at(payload: Column, *paths: str) -> Column:
    return as_number(text_at(payload, *paths))


def flag_at(payload: Column, *paths: str) -> Column:
    """Whether the first value there is true, a number other than 0, or a text."""
    v = F.lower(text_at(payload, *paths))
    return F.coalesce(F.when(v.isin("true", "false"), v == "true").otherwise(F.coalesce(v.try_cast("double") != 0, v.isNotNull())), F.lit(False))


def useful_group_at(payload: Column) -> Column:
    """The first group that is not pending review, else the first."""
    named = F.array_compact(F.array(*[text_at(payload, p) for p in GROUPS]))
    return F.coalesce(F.get(F.filter(named, lambda g: F.lower(g) != PENDING), 0), F.get(named, 0))


def gap_text(payload: Column) -> Column:
    """What is told of a knowledge gap: ``none``, the reason, or the stored flag where no reason is."""
    is_object = lambda p: object_at(payload, p)
    reason = text_at(payload, "knowledge_gap_reason", "routing.knowledge_gap_reason")
    flag = text_at(payload, "knowledge_gap", "routing.knowledge_gap")

    def of_object(p: str) -> Column:
        closed = F.coalesce(F.try_variant_get(payload, f"$.{p}.is_gap", "string") == "false", F.lit(False))
        return F.when(closed, "none").otherwise(F.coalesce(text_at(payload, f"{p}.reason", f"{p}.severity"), F.lit("gap detected")))

    stored = F.when(flag.isNotNull() & ~flag.isin("0", "false") & reason.isNotNull(), reason).otherwise(flag)
    return F.when(is_object("knowledge_gap"), of_object("knowledge_gap")).when(
        text_at(payload, "knowledge_gap").isNull() & is_object("routing.knowledge_gap"), of_object("routing.knowledge_gap")).otherwise(stored)


def resolver_at(payload: Column) -> tuple[Column, Column]:
    """(group, told text) of the recommended resolver: of the recommendation, or of the flat fields."""
    rec = "resolver_recommendation"
    group = text_at(payload, f"{rec}.group", f"routing.{rec}.group", "resolver_group", "routing.resolver_group")
    confidence = number_at(payload, f"{rec}.confidence", f"routing.{rec}.confidence", "resolver_confidence", "routing.resolver_confidence")
    share = F.concat(F.lit(" ("), F.floor(confidence * 100 + 0.5).cast("string"), F.lit("%)"))
    is_object = object_at(payload, rec) | object_at(payload, f"routing.{rec}")
    told = F.concat(F.coalesce(group, F.when(is_object, UNNAMED)), F.coalesce(share, F.lit("")))
    return group, F.coalesce(told, text_at(payload, rec, f"routing.{rec}"))


def suggestions_at(payload: Column) -> Column:
    """The suggested steps: the first that is there of an array or a text."""
    places = ("suggested_resolution", "routing.suggested_resolution", *PRECEDENCE["resolution"])
    lists = [F.coalesce(F.try_variant_get(payload, f"$.{p}", "array<string>"), F.when(F.length(text_at(payload, p)) > 0, F.array(text_at(payload, p)))) for p in places]
    first = reduce(F.coalesce, lists)
    return F.filter(F.coalesce(first, F.array().cast("array<string>")), lambda s: F.coalesce(s != "", F.lit(False)))


def canonical_ticket(payload: Column) -> Column:
    """struct of the unified fields."""
    fields = [text_at(payload, *paths).alias(name) for name, paths in PRECEDENCE.items() if name != "status"]
    numbers = [number_at(payload, *paths).alias(name) for name, paths in NUMBERS.items()]
    risk = number_at(payload, *NUMBERS["privacy_risk"])
    modifier = F.coalesce(number_at(payload, "confidence_components.risk_modifier", "routing.confidence_components.risk_modifier"),
                          F.when(risk.isNotNull(), risk_modifier(risk)))
    historical = F.coalesce(number_at(payload, "confidence_components.historical_similarity", "routing.confidence_components.historical_similarity"),
                            number_at(payload, *NUMBERS["retrieval_similarity"]))
    group, told = resolver_at(payload)
    steps = suggestions_at(payload)
    status = F.coalesce(text_at(payload, *PRECEDENCE["status"]), F.when(flag_at(payload, "escalation_required"), "human_review_required"))
    return F.struct(
        *fields, *numbers, modifier.alias("risk_modifier"), historical.alias("historical_similarity"), useful_group_at(payload).alias("assignment_group"),
        number_at(payload, "sla_risk.score", "routing.sla_risk.score", "sla_risk", "sla_risk_score", "routing.sla_risk_score").alias("sla_risk"),
        flag_at(payload, "semantic_cache_hit", "routing.semantic_cache_hit").alias("semantic_cache_hit"), gap_text(payload).alias("knowledge_gap"),
        group.alias("resolver_group"), told.alias("resolver_recommendation"), steps.alias("suggested_resolution_items"),
        F.coalesce(F.get(steps, 0), F.lit("")).alias("suggested_resolution_preview"), status.alias("status"))
