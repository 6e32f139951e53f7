"""Text normalisation and JSON helpers as column expressions (PRJ-1/2/9, TXT-1..5, 8..11).

These run per row inside Catalyst (string functions, higher-order array functions,
``try_parse_json``/variant access); none of them needs a Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import strip_ws

TRUNCATED = "\n[truncated]"
# Line boundaries of Python's str.splitlines().
LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"
STEP_PREFIX = r"^\s*(?:[-*]|\d+[\).\s-]*)\s*"


def rstrip_ws(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+$", "")


def clip_text(value: Column, max_chars: Column | int) -> Column:
    """TXT-1: ≤ 0 → ''; fits → as is; ≤ 14 → hard cut; else cut n−14, rstrip, mark truncated."""
    n = F.lit(max_chars) if isinstance(max_chars, int) else max_chars
    return (F.when(n <= 0, F.lit(""))
            .when(F.length(value) <= n, value)
            .when(n <= 14, value.substr(F.lit(1), n))
            .otherwise(F.concat(rstrip_ws(value.substr(F.lit(1), n - 14)), F.lit(TRUNCATED))))


def normalize_steps(text: Column, max_steps: int = 6, max_chars: int = 800) -> Column:
    """TXT-2: lines without bullets/numbering/emphasis, blanks dropped, clipped, first 6;
    a non-blank text without usable lines becomes one clipped step."""
    lines = F.split(F.coalesce(text, F.lit("")), LINE_BREAK, -1)
    cleaned = F.transform(lines, lambda ln: strip_ws(F.replace(F.replace(
        F.regexp_replace(strip_ws(ln), STEP_PREFIX, ""), F.lit("**"), F.lit("")), F.lit("__"), F.lit(""))))
    kept = F.transform(F.filter(cleaned, lambda x: x != ""), lambda x: clip_text(x, max_chars))
    whole = strip_ws(F.coalesce(text, F.lit("")))
    return F.slice(F.when((F.size(kept) == 0) & (whole != ""), F.array(clip_text(whole, max_chars)))
                   .otherwise(kept), 1, max_steps)


def lenient_json(payload: Column) -> Column:
    """TXT-4: parse as JSON; else the span from the first '{' to the last '}'; a
    non-object parses to ``{}``; NULL when nothing parses (the reference raises)."""
    p = F.coalesce(payload, F.lit(""))
    first = F.instr(p, "{")
    last = F.length(p) - F.instr(F.reverse(p), "}") + 1
    inner = F.when((first > 0) & (F.instr(F.reverse(p), "}") > 0) & (last > first),
                   p.substr(first, last - first + 1))
    parsed = F.coalesce(F.try_parse_json(p), F.try_parse_json(inner))
    is_obj = F.schema_of_variant(parsed).startswith("OBJECT")
    return F.when(parsed.isNull(), F.lit(None)).when(is_obj, parsed).otherwise(F.parse_json(F.lit("{}")))


def _vtype(v: Column) -> Column:
    return F.schema_of_variant(v)


def python_text(v: Column) -> Column:
    """``str()`` of a JSON value as the reference's language writes it (objects and lists: as JSON)."""
    t = _vtype(v)
    text = F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))
    return (F.when(v.isNull() | (t == "VOID"), F.lit("None"))
            .when(t == "BOOLEAN", F.initcap(text)).otherwise(text))


def python_truth(v: Column) -> Column:
    """``bool()`` of a JSON value: false for null, false, 0, '' and empty lists and objects."""
    t = _vtype(v)
    return (F.when(t == "VOID", F.lit(False))
            .when(t == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
            .when(t == "STRING", F.try_variant_get(v, "$", "string") != "")
            .when(t.startswith("ARRAY") | t.startswith("OBJECT"), ~F.to_json(v).isin("[]", "{}"))
            .otherwise(F.coalesce(F.try_variant_get(v, "$", "double"), F.lit(0.0)) != 0))


def steps_from_json(data: Column, key: str = "resolution_steps") -> Column:
    """TXT-3: array → stripped non-blank items (clipped, first 6); string → TXT-2; else []."""
    v = F.try_variant_get(data, f"$.{key}", "variant")
    t = _vtype(v)
    items = F.try_variant_get(v, "$", "array<variant>")
    as_text = F.transform(items, lambda x: strip_ws(python_text(x)))
    arr_steps = F.slice(F.transform(F.filter(as_text, lambda s: s != ""), lambda s: clip_text(s, 800)), 1, 6)
    return (F.when(t.startswith("ARRAY"), arr_steps)
            .when(t == "STRING", normalize_steps(F.try_variant_get(v, "$", "string")))
            .otherwise(F.array().cast("array<string>")))


def model_decision(payload: Column) -> Column:
    """TXT-5: struct(parsed, steps, confidence, escalation_required, rationale) of a model
    response; ``parsed`` is false when the payload is not JSON at all or its confidence is no
    number (→ fallback). Empty steps are completed by ``scoring.complete_steps``."""
    data = lenient_json(payload)
    conf_v = F.try_variant_get(data, "$.confidence_score", "variant")
    conf_t = _vtype(conf_v)
    number = F.when(conf_t == "BOOLEAN", F.try_variant_get(conf_v, "$", "boolean").cast("double")).when(
        conf_t == "STRING", strip_ws(F.try_variant_get(conf_v, "$", "string")).try_cast("double")).otherwise(
        F.try_variant_get(conf_v, "$", "double"))
    conf = F.when(conf_v.isNull(), F.lit(0.0)).otherwise(number)
    esc_v = F.try_variant_get(data, "$.escalation_required", "variant")
    esc = F.when(esc_v.isNull(), F.lit(True)).otherwise(python_truth(esc_v))
    rat_v = F.try_variant_get(data, "$.rationale", "variant")
    rationale = F.when(rat_v.isNull(), F.lit("")).otherwise(python_text(rat_v))
    return F.struct(
        (data.isNotNull() & conf.isNotNull()).alias("parsed"),
        steps_from_json(data).alias("steps"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(conf, F.lit(0.0)))).alias("confidence"),
        esc.alias("escalation_required"),
        rationale.substr(F.lit(1), F.lit(1000)).alias("rationale"),
    )


def compose_raw_text(raw_text: Column, short: Column, description: Column, trim_result: bool = True) -> Column:
    """PRJ-1: raw text when non-blank, else short + blank line + description (trimmed)."""
    raw = F.coalesce(raw_text, F.lit(""))
    joined = F.concat(F.coalesce(short, F.lit("")), F.lit("\n\n"), F.coalesce(description, F.lit("")))
    return F.when(strip_ws(raw) != "", raw).otherwise(strip_ws(joined) if trim_result else joined)


def split_display(sanitized: Column) -> Column:
    """PRJ-2 split branch: struct(short, description) at the first blank line; NULL when
    the stripped text has no blank line (callers then redact both fields separately)."""
    s = strip_ws(F.coalesce(sanitized, F.lit("")))
    parts = F.split(s, "\n\n", 2)
    return F.when((s != "") & (F.size(parts) == 2), F.struct(
        strip_ws(parts[0]).alias("short_description"), strip_ws(parts[1]).alias("description")))


def split_resolution(text: Column) -> Column:
    """TXT-8: stripped non-blank lines."""
    lines = F.split(F.coalesce(text, F.lit("")), LINE_BREAK, -1)
    return F.filter(F.transform(lines, strip_ws), lambda x: x != "")


def plain_steps(text: Column) -> Column:
    """TXT-9: split on newline runs, drop a leading number marker, trim, drop blanks."""
    parts = F.split(F.coalesce(text, F.lit("")), "\n+", -1)
    return F.filter(F.transform(parts, lambda x: F.trim(F.regexp_replace(x, r"^\s*\d+[\).\s-]*", ""))),
                    lambda x: x != "")


def first_useful_group(*groups: Column) -> Column:
    """PRJ-9: first non-empty group that is not 'pending review', else the first non-empty."""
    present = F.filter(F.array(*groups), lambda g: g.isNotNull() & (g != ""))
    useful = F.filter(present, lambda g: F.lower(g) != "pending review")
    return F.coalesce(F.get(useful, 0), F.get(present, 0))


def as_number(c: Column) -> Column:
    """PRJ-11: NULL / '' / non-numeric / non-finite → NULL."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


EXPLANATION_TYPE = "array<struct<label:string,value:string,impact:string>>"


def parse_explanation(value: Column) -> Column:
    """TXT-10: JSON list of explanation rows, or an empty list."""
    return F.coalesce(F.from_json(F.coalesce(value, F.lit("[]")), EXPLANATION_TYPE), F.array().cast(EXPLANATION_TYPE))
