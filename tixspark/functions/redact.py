"""Sensitive-data redaction as Catalyst expressions (RED-1..17).

No UDF: every detector is scanned with ``regexp_extract_all`` (matches) and, only when
it matched, ``split`` (the gaps between matches); match offsets are the running sum
of gap and match lengths. All spans of all detectors are merged into one array,
sorted by (start, -length, detector order), folded greedily (a span that starts
before the end of the last kept span is dropped), numbered per entity type and
spliced back into the text. Everything happens inside one row, so the work is
spread by whatever partitioning the input already has and nothing shuffles.

Offsets are code points (Spark ``length``/``substring``), like the batch path of
the reference. Regex dialect is the JVM's (see SURVEY Q10).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numeric import let

# --- fixed values: detector table (type, confidence, pattern), order matters ------
# Patterns are the reference's; "(?i)" marks the case-insensitive ones.
DETECTORS: tuple[tuple[str, float, str], ...] = (
    ("EMAIL", 0.99, r"(?i)\b[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}\b"),
    ("IP_ADDRESS", 0.95, r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"),
    ("CREDENTIAL", 0.97, r"""(?i)\b(?:password|passwd|pwd|secret|api[_-]?key|token)\s*[:=]\s*["']?[^"'\s,;]{6,}"""),
    ("BEARER_TOKEN", 0.98, r"(?i)\bBearer\s+[A-Za-z0-9._~+/=\-]{12,}"),
    ("AWS_ACCESS_KEY", 0.99, r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"),
    ("PRIVATE_KEY", 0.99, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("PHONE_NUMBER", 0.85, r"(?:\+?\d{1,3}[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)\d{3}[-.\s]?\d{4}\b"),
    ("ACCOUNT_ID", 0.80, r"(?i)\b(?:(?:account|acct|merchant|customer)[_-]?(?:id)?|user[_-]?id)\s*[:#=]\s*[A-Z0-9\-]{4,}\b"),
)
DETECTOR_VERSION = "privacy-shield-regex-v1"
LOCAL_DETECTOR_VERSION = "python-regex-v1"
POLICY_VERSION = "enterprise-ticket-policy-v1"
# ----------------------------------------------------------------------------------


def _any_of(*parts: str):
    return lambda text: reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts])


#: What a text must hold for a pattern to match in it at all, and which is found several times faster than the pattern.
NEEDED = dict(zip([p for _, _, p in DETECTORS], (
    _any_of("@"), lambda text: text.rlike(r"\d\.\d"), _any_of(":", "="), None, _any_of("AKIA", "ASIA"), _any_of("-----BEGIN "),
    lambda text: text.rlike(r"\d{3}[-.\s]?\d{4}"), _any_of(":", "#", "="))))

SPAN_TYPE = "array<struct<s:int,nl:int,o:int,t:string,c:double,e:int>>"
FINDING_TYPE = (
    "array<struct<entity_type:string,placeholder:string,confidence:double,start_offset:bigint,end_offset:bigint>>"
)


#: Elements folded at a time. A fold that appends to an array copies it each time, so the
#: folds run over stretches of this many and then over the stretches.
STRETCH = 128


def stretches(array: Column) -> Column:
    """``array`` (a bound variable or a column) in pieces of STRETCH elements."""
    last = F.greatest(F.lit(0), F.floor((F.size(array) - 1) / STRETCH).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(array, k * STRETCH + 1, STRETCH))


def detector_spans(text: Column, order: int, entity_type: str, confidence: float, pattern: str) -> Column:
    """All matches of one detector as span structs; empty array when none."""
    gaps = F.split(text, pattern, -1)
    none = F.array().cast(SPAN_TYPE)

    def step(acc: Column, z: Column) -> Column:
        s = acc["pos"] + z["gl"]
        e = s + z["ml"]
        span = F.struct(
            s.alias("s"), (-z["ml"]).alias("nl"), F.lit(order).alias("o"), F.lit(entity_type).alias("t"),
            F.lit(confidence).alias("c"), e.alias("e"),
        )
        return F.struct(e.alias("pos"), F.concat(acc["out"], F.array(span)).alias("out"))

    def moved(spans: Column, by: Column) -> Column:
        return F.transform(spans, lambda z: F.struct(
            (z["s"] + by).alias("s"), z["nl"].alias("nl"), z["o"].alias("o"), z["t"].alias("t"), z["c"].alias("c"),
            (z["e"] + by).alias("e")))

    def placed(lens: Column) -> Column:
        """Running sums: within each stretch, then over the stretches."""
        start = F.struct(F.lit(0).alias("pos"), none.alias("out"))
        parts = F.transform(stretches(lens), lambda c: F.aggregate(c, start, step))
        begin = F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{SPAN_TYPE}>").alias("out"))
        whole = F.aggregate(parts, begin, lambda acc, p: F.struct(
            (acc["pos"] + p["pos"]).alias("pos"),
            F.concat(acc["out"], F.array(moved(p["out"], acc["pos"]))).alias("out")))
        return F.flatten(whole["out"])

    def from_matches(matches: Column) -> Column:
        lens = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.struct(
            F.length(g).alias("gl"), F.length(m).alias("ml")))
        # split() only runs for texts where the detector matched at all.
        return F.when(F.size(matches) > 0, let(lens, placed)).otherwise(none)

    found, need = F.regexp_extract_all(text, F.lit(pattern), 0), NEEDED.get(pattern)
    if need:
        found = F.when(need(text), found).otherwise(F.array().cast("array<string>"))
    # The match array is bound once: it is read by the size test and by the fold.
    return let(found, from_matches)


def all_spans(text: Column, detectors=DETECTORS) -> Column:
    """RED-9: every detector's matches, sorted by (start, -length, detector order)."""
    per = [detector_spans(text, i, t, c, p) for i, (t, c, p) in enumerate(detectors, start=1)]
    return F.array_sort(F.flatten(F.array(*per)))


def resolve_overlaps(sorted_spans: Column) -> Column:
    """RED-10: greedy fold, keep a span only if it starts at/after the last kept end."""
    def step(acc: Column, z: Column) -> Column:
        return F.when(z["s"] < acc["e"], acc).otherwise(
            F.struct(z["e"].alias("e"), F.concat(acc["out"], F.array(z)).alias("out")))

    def stretch(acc: Column, c: Column) -> Column:
        start = F.struct(acc["e"].alias("e"), F.array().cast(SPAN_TYPE).alias("out"))
        return let(F.aggregate(c, start, step), lambda r: F.struct(
            r["e"].alias("e"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    begin = F.struct(F.lit(0).alias("e"), F.array().cast(f"array<{SPAN_TYPE}>").alias("out"))
    return let(sorted_spans, lambda spans: F.flatten(F.aggregate(stretches(spans), begin, stretch)["out"]))


def number_findings(kept: Column, types: tuple[str, ...] = tuple(dict.fromkeys(d[0] for d in DETECTORS))) -> Column:
    """RED-11: ``[TYPE_n]`` with n = running count of that type among kept spans (numbered
    type by type, then put back in order)."""
    def of_type(spans: Column, name: str) -> Column:
        mine = F.filter(spans, lambda z: z["t"] == name)
        return F.transform(mine, lambda z, i: F.struct(
            z["s"].alias("s"), z["e"].alias("e"), z["t"].alias("t"), z["c"].alias("c"),
            F.concat(F.lit(f"[{name}_"), (i + 1).cast("string"), F.lit("]")).alias("p")))

    numbered = let(kept, lambda spans: F.array_sort(F.flatten(F.array(*[of_type(spans, t) for t in types]))))
    return F.transform(numbered, lambda z: F.struct(
        z["t"].alias("entity_type"), z["p"].alias("placeholder"), z["c"].alias("confidence"),
        z["s"].cast("bigint").alias("start_offset"), z["e"].cast("bigint").alias("end_offset")))


def splice(text: Column, findings: Column) -> Column:
    """RED-12: rebuild the text from the gaps between findings and their placeholders. Each
    stretch of findings is cut out of the text once, so places in it are near its start."""
    def end_of(array: Column, at: Column) -> Column:
        return F.coalesce(F.get(array, at)["end_offset"], F.lit(0)).cast("int")

    def part(c: Column) -> Column:
        def piece(f: Column, i: Column) -> Column:
            prev = F.greatest(end_of(c["own"], i - 1), c["base"])
            return F.concat(c["sub"].substr(prev - c["base"] + 1, f["start_offset"].cast("int") - prev), f["placeholder"])

        return F.array_join(F.transform(c["own"], piece), "")

    def stretch(k: Column) -> Column:
        base = F.when(k > 0, end_of(findings, k * STRETCH - 1)).otherwise(F.lit(0))
        own = F.slice(findings, k * STRETCH + 1, STRETCH)
        last = end_of(findings, F.least((k + 1) * STRETCH, F.size(findings)) - 1)
        return let(F.struct(base.alias("base"), own.alias("own"), text.substr(base + 1, last - base).alias("sub")), part)

    numbers = F.sequence(F.lit(0), F.floor((F.size(findings) - 1) / STRETCH).cast("int"))
    body = F.when(F.size(findings) > 0, F.array_join(F.transform(numbers, stretch), "")).otherwise(F.lit(""))
    tail_start = F.coalesce(F.try_element_at(findings, F.lit(-1))["end_offset"], F.lit(0)).cast("int") + 1
    tail = text.substr(tail_start, F.greatest(F.length(text) - tail_start + 1, F.lit(0)))
    return F.concat(body, tail)


def sha256_hex(text: Column) -> Column:
    """RED-15: hex SHA-256 of the UTF-8 bytes."""
    return F.sha2(text, 256)


def stable_id(prefix: str, *values: Column) -> Column:
    """RED-16: prefix + '_' + first 16 hex of SHA-256 over values each followed by a NUL byte."""
    parts = []
    for v in values:
        parts += [F.encode(v, "UTF-8"), F.unhex(F.lit("00"))]
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat(*parts), 256), 1, 16))


def local_ticket_id(ticket_id: Column, number: Column, sanitized_hash: Column) -> Column:
    """RED-17: the id used when the redaction service is not there."""
    given = [F.when(c != "", c) for c in (ticket_id, number)]
    return F.coalesce(*given, F.substring(sanitized_hash, 1, 16))


@dataclass(frozen=True)
class Redaction:
    """Column names added by :func:`redact`."""

    sanitized: str = "sanitized_text"
    findings: str = "findings"
    raw_hash: str = "raw_sha256"
    sanitized_hash: str = "sanitized_sha256"
    count: str = "redacted_count"


def redact(df: DataFrame, text_col: str, out: Redaction = Redaction()) -> DataFrame:
    """RED-13: add sanitized text, findings (never NULL: RED-14), both hashes and the count.

    The span array is computed once into a column and reused (regex time dominates).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    with_spans = df.withColumn("_kept", resolve_overlaps(all_spans(text)))
    with_findings = with_spans.withColumn(out.findings, number_findings(F.col("_kept"))).drop("_kept")
    return (
        with_findings.withColumn(out.sanitized, splice(text, F.col(out.findings)))
        .withColumn(out.raw_hash, sha256_hex(text))
        .withColumn(out.sanitized_hash, sha256_hex(F.col(out.sanitized)))
        .withColumn(out.count, F.size(out.findings))
    )


def pii_hits(df: DataFrame, text_col: str, detectors=DETECTORS) -> DataFrame:
    """RED-1..8: raw matches per detector (before overlap resolution), one row per match."""
    text = F.col(text_col)
    arr = F.array(*[
        F.struct(F.lit(t).alias("entity_type"), F.lit(c).alias("confidence"),
                 F.regexp_extract_all(text, F.lit(p), 0).alias("matches"))
        for t, c, p in detectors
    ])
    return (
        df.select("*", F.inline(arr))
        .select("*", F.posexplode_outer("matches").alias("match_index", "matched"))
        .where(F.col("matched").isNotNull())
        .drop("matches")
    )
