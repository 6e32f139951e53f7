"""Batch jobs of the rule and text functions over the driver's text tables
(CLS-1..6, PRJ-1..3/9, TXT-1..5/8..10, RED-16).

Each job is a single narrow projection over ``documents``, ``conversations``,
``tickets`` or ``routing_decisions``: no shuffle, work proportional to the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..functions.redact import local_ticket_id, stable_id
from ..sources import fixtures
from ..sources.fixtures import with_views
from ..sources.tables import padded, padded_sql, read_table, text_rows
from .registry import register


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pruned text rows for the CPU-bound rules."""
    return text_rows(read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))


def _conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_rows(read_table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")))


# --- SQL renderings (DuckDB) of the same rules ------------------------------------

def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _any(col: str, terms) -> str:
    return "(" + " or ".join(f"contains({col}, {_q(t)})" for t in terms) + ")"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _clip(v: str, n: str) -> str:
    return (f"(case when {n} <= 0 then '' when length({v}) <= {n} then {v} when {n} <= 14 then substring({v}, 1, {n}) "
            f"else regexp_replace(substring({v}, 1, {n} - 14), '\\s+$', '') || chr(10) || '[truncated]' end)")


_DUCK_BREAK = "'\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]'"


def _steps_sql(text: str) -> str:
    cleaned = (f"list_transform(string_split_regex({text}, {_DUCK_BREAK}), lambda ln: "
               f"{_strip(chr(39) * 0 + 'replace(replace(regexp_replace(' + _strip('ln') + ', ' + _q(T.STEP_PREFIX) + ', ' + _q('') + '), ' + _q('**') + ', ' + _q('') + '), ' + _q('__') + ', ' + _q('') + ')')})")
    kept = f"list_transform(list_filter({cleaned}, lambda x: x <> ''), lambda x: {_clip('x', '800')})"
    whole = _strip(text)
    return f"(case when len({kept}) = 0 and {whole} <> '' then [{_clip(whole, '800')}] else {kept} end)[1:6]"


def _keyword_sql(col: str) -> tuple[str, str]:
    cat = "case " + " ".join(f"when {_any(col, terms)} then {_q(c)}" for terms, c, _ in R.KEYWORD_RULES) + \
        f" else {_q(R.KEYWORD_DEFAULT[0])} end"
    conf = "case " + " ".join(f"when {_any(col, terms)} then {v}" for terms, _, v in R.KEYWORD_RULES) + \
        f" else {R.KEYWORD_DEFAULT[1]} end"
    return cat, conf


def _security_sql(low: str) -> str:
    parts = []
    for label, terms, rx in R.SECURITY_RULES:
        cond = _any(low, terms)
        if rx:
            cond = f"({cond} or regexp_matches({low}, {_q(rx)}))"
        parts.append(f"case when {cond} then {_q(label)} end")
    return f"concat_ws(', ', {', '.join(parts)})"


# --- CLS ---------------------------------------------------------------------------

_KW_CAT, _KW_CONF = _keyword_sql("lower(text)")


@register("keyword_category", f"""
select doc_id, {_KW_CAT} as category, cast({_KW_CONF} as double) as confidence
from (select doc_id, coalesce(text, '') as text from documents)""")
def q_keyword_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    kc = R.keyword_category(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", kc["category"].alias("category"), kc["confidence"].alias("confidence"))


@register("security_findings", f"""
select doc_id, {_security_sql('lower(text)')} as security_labels
from (select doc_id, coalesce(text, '') as text from documents)""")
def q_security_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select(
        "doc_id", F.array_join(R.security_findings(F.col("text")), ", ").alias("security_labels"))


@register("review_reason", with_views(f"""
select ticket_id,
  case when urgency = 1 or impact = 1 then {_q(R.REASON_CRITICAL)}
       when {_security_sql('lower(description)')} <> '' then {_q(R.REASON_CREDENTIAL)}
       when {_any('lower(sanitized_text)', R.OUT_OF_SCOPE_TERMS)} then {_q(R.REASON_SCOPE)}
       when {_any('lower(sanitized_text)', R.HIGH_RISK_TERMS)} then {_q(R.REASON_RISK)} end as review_reason
from tickets""", "tickets"))
def q_review_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS-3 over tickets: security findings read the raw description (Q13)."""
    t = fixtures.tickets(spark, sf_dir)
    sec = R.security_findings(F.col("description"))
    return t.select("ticket_id", R.review_reason(F.col("sanitized_text"), F.col("urgency"), F.col("impact"), sec)
                    .alias("review_reason"))


_SIG_LIST = "[" + ", ".join(_q(t) for t in R.SIGNAL_TERMS) + "]"


@register("classifier_signals", f"""
select doc_id, case when len(p) > 0 then array_to_string(p[1:5], ', ') else {_q(R.SIGNAL_DEFAULT)} end as signals
from (select doc_id, list_filter({_SIG_LIST}, lambda t: contains(lower(coalesce(text, '')), t)) as p from documents)""")
def q_classifier_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", R.classifier_signals(F.col("text")).alias("signals"))


@register("rationale_flags", f"""
select conv_id, turn, cast({_any('lower(coalesce(text, ' + chr(39) * 2 + '))', R.RATIONALE_REVIEW_TERMS)} as integer)
  as requires_review from conversations""")
def q_rationale_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS-5 over conversation turns read as model rationales."""
    return _conv(spark, sf_dir).select("conv_id", "turn",
                                       R.rationale_requires_review(F.col("text")).cast("int").alias("requires_review"))


@register("steps_actionable", f"""
select conv_id, turn, cast(len(list_filter(s, lambda x: {_strip('x')} <> '')) >= 2
  and not {_any("array_to_string(list_transform(s, lambda x: lower(x)), ' ')", R.BLOCKED_STEP_TERMS)} as integer) as actionable
from (select conv_id, turn, {_steps_sql("coalesce(text, '')")} as s from conversations)""")
def q_steps_actionable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS-6 over the steps normalised from each conversation turn."""
    c = _conv(spark, sf_dir)
    return c.select("conv_id", "turn", R.steps_actionable(T.normalize_steps(F.col("text"))).cast("int")
                    .alias("actionable"))


def _title_sql(s: str) -> str:
    return (f"array_to_string(list_transform(string_split({s}, ''), lambda ch, i: case when i = 1 or not "
            f"upper(string_split({s}, '')[i - 1]) <> lower(string_split({s}, '')[i - 1]) then upper(ch) else lower(ch) end), '')")


_CAT_RAW_SQL = ("case doc_id % 4 when 0 then concat(' ', upper(lang), ' ') when 1 then concat(lang, '-', source, ' x') "
                "when 2 then '' else (case lang when 'en' then 'Software' when 'fr' then 'network' when 'de' then "
                "' DATABASE ' else 'Access' end) end")
_CAT_MAP_SQL = "case lower(k) " + " ".join(f"when {_q(a)} then {_q(b)}" for a, b in R.CATEGORY_MAP) + " end"


@register("normalize_category", f"""
select doc_id, raw_category,
  coalesce({_CAT_MAP_SQL}, case when k <> '' then {_title_sql('k')} end, 'Application') as category
from (select doc_id, raw_category, {_strip('raw_category')} as k
      from (select doc_id, {_CAT_RAW_SQL} as raw_category from documents))""")
def q_normalize_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-3 on category strings derived from each document's language and source."""
    d = read_table(spark, sf_dir, "documents")
    m = F.col("doc_id") % 4
    raw = (F.when(m == 0, F.concat(F.lit(" "), F.upper("lang"), F.lit(" ")))
           .when(m == 1, F.concat("lang", F.lit("-"), "source", F.lit(" x")))
           .when(m == 2, F.lit(""))
           .otherwise(F.when(F.col("lang") == "en", "Software").when(F.col("lang") == "fr", "network")
                      .when(F.col("lang") == "de", " DATABASE ").otherwise("Access")))
    return d.select("doc_id", raw.alias("raw_category")).withColumn(
        "category", R.normalize_category(F.col("raw_category")))


# --- TXT ---------------------------------------------------------------------------

@register("clip_text", f"""
select doc_id, n, {_clip('text', 'n')} as clipped
from (select doc_id, coalesce(text, '') as text, cast(doc_id % 40 as integer) - 2 as n from documents)""")
def q_clip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-1 with budgets −2..37 so every branch runs."""
    d = _docs(spark, sf_dir).withColumn("n", (F.col("doc_id") % 40).cast("int") - 2)
    return d.select("doc_id", "n", T.clip_text(F.col("text"), F.col("n")).alias("clipped"))


@register("normalize_steps", f"""
select conv_id, turn, {_steps_sql("coalesce(text, '')")} as steps from conversations""")
def q_normalize_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-2 over conversation turns."""
    return _conv(spark, sf_dir).select("conv_id", "turn", T.normalize_steps(F.col("text")).alias("steps"))


@register("split_resolution", with_views(f"""
select event_id, list_filter(list_transform(string_split_regex(coalesce(suggested_resolution, ''), {_DUCK_BREAK}),
  lambda x: {_strip('x')}), lambda x: x <> '') as steps from routing_decisions""", "routing_decisions"))
def q_split_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-8 on stored decision resolutions."""
    return fixtures.routing_decisions(spark, sf_dir).select(
        "event_id", T.split_resolution(F.col("suggested_resolution")).alias("steps"))


@register("plain_steps", """
select conv_id, turn, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\\n+'),
  lambda x: trim(regexp_replace(x, '^\\s*\\d+[\\).\\s-]*', ''))), lambda x: x <> '') as steps from conversations""")
def q_plain_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-9."""
    return _conv(spark, sf_dir).select("conv_id", "turn", T.plain_steps(F.col("text")).alias("steps"))


@register("compose_text", f"""
select conv_id, turn,
  case when {_strip('raw')} <> '' then raw else {_strip("concat(short, chr(10) || chr(10), descr)")} end as raw_text
from (select conv_id, turn, case when turn % 2 = 0 then '' else coalesce(text, '') end as raw,
        substring(coalesce(text, ''), 1, 40) as short, substring(coalesce(text, ''), 41) as descr from conversations)""")
def q_compose_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-1: raw text wins when non-blank (odd turns), else short + blank line + description."""
    c = _conv(spark, sf_dir)
    raw = F.when(F.col("turn") % 2 == 0, F.lit("")).otherwise(F.col("text"))
    return c.select("conv_id", "turn", T.compose_raw_text(
        raw, F.substring("text", 1, 40), F.expr("substring(text, 41)")).alias("raw_text"))


def display_fields(df: DataFrame, sanitized: str, short: str, description: str) -> DataFrame:
    """PRJ-2: display (short, description) from the combined sanitized text when it holds a
    blank line, else each raw field redacted on its own."""
    from ..functions.redact import Redaction, redact

    sp = T.split_display(F.col(sanitized))
    out = redact(df.withColumn("_split", sp), short, Redaction(sanitized="_rs", findings="_f1", raw_hash="_h1",
                                                               sanitized_hash="_h2", count="_n1"))
    out = redact(out, description, Redaction(sanitized="_rd", findings="_f2", raw_hash="_h3",
                                             sanitized_hash="_h4", count="_n2"))
    return out.withColumn("display_short", F.coalesce(F.col("_split.short_description"), F.col("_rs"))) \
        .withColumn("display_description", F.coalesce(F.col("_split.description"), F.col("_rd"))) \
        .drop("_split", "_rs", "_f1", "_h1", "_h2", "_n1", "_rd", "_f2", "_h3", "_h4", "_n2")


def _display_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _conv(spark, sf_dir)
    short, desc = F.substring("text", 1, 40), F.expr("substring(text, 41)")
    raw = F.when(F.col("turn") % 2 == 0, F.lit("")).otherwise(F.col("text"))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), short.alias("short"),
                    desc.alias("descr"), T.compose_raw_text(raw, short, desc).alias("combined"))


_DISPLAY_IN = """select conv_id * 1000 + turn as doc_id, substring(coalesce(text, ''), 1, 40) as short,
  substring(coalesce(text, ''), 41) as descr,
  case when turn % 2 = 1 and regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') <> '' then coalesce(text, '')
       else regexp_replace(concat(substring(coalesce(text, ''), 1, 40), chr(10) || chr(10), substring(coalesce(text, ''), 41)),
                           '^\\s+|\\s+$', '', 'g') end as combined
from conversations"""
_SPLIT_DOCS = ("select doc_id * 2 as doc_id, short as text from (" + _DISPLAY_IN + ") union all "
               "select doc_id * 2 + 1, descr from (" + _DISPLAY_IN + ")")


@register("display_fields", f"""
with recursive fallback as ({fixtures._redaction_sql(_SPLIT_DOCS)}),
i as ({_DISPLAY_IN}),
s as (select doc_id, {_strip('combined')} as c from i),
p as (select doc_id, c, strpos(c, chr(10) || chr(10)) as k from s)
select p.doc_id,
  case when c <> '' and k > 0 then {_strip('substring(c, 1, k - 1)')} else f1.sanitized_text end as display_short,
  case when c <> '' and k > 0 then {_strip('substring(c, k + 2)')} else f2.sanitized_text end as display_description
from p left join fallback f1 on f1.kind = 'doc' and f1.doc_id = p.doc_id * 2
       left join fallback f2 on f2.kind = 'doc' and f2.doc_id = p.doc_id * 2 + 1""")
def q_display_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-2 over composed conversation tickets: even turns split, odd turns fall back."""
    return display_fields(_display_input(spark, sf_dir), "combined", "short", "descr").select(
        "doc_id", "display_short", "display_description")


@register("useful_group", with_views("""
select event_id, coalesce(list_filter(g, lambda x: lower(x) <> 'pending review')[1], g[1]) as useful_group
from (select event_id, list_filter([case when event_id % 3 = 0 then 'Pending Review' else '' end, resolver_group,
        case when event_id % 2 = 0 then 'pending review' else 'IT Support' end], lambda x: x is not null and x <> '') as g
      from routing_decisions)""", "routing_decisions"))
def q_useful_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-9."""
    d = fixtures.routing_decisions(spark, sf_dir)
    e = F.col("event_id")
    return d.select("event_id", T.first_useful_group(
        F.when(e % 3 == 0, "Pending Review").otherwise(""), F.col("resolver_group"),
        F.when(e % 2 == 0, "pending review").otherwise("IT Support")).alias("useful_group"))


def _explanation_json(d: DataFrame) -> DataFrame:
    e = F.col("event_id")
    good = F.to_json(F.array(
        F.struct(F.lit("Route branch").alias("label"), F.col("route_path").alias("value"), F.lit("neutral").alias("impact")),
        F.struct(F.lit("SLA risk").alias("label"), F.col("sla_risk_level").alias("value"), F.lit("negative").alias("impact"))))
    raw = F.when(e % 5 == 0, F.lit("not json")).when(e % 5 == 1, F.lit("")).otherwise(good)
    return d.select("event_id", raw.alias("route_explanation"))


@register("explanation_parse", with_views("""
select event_id, cast(len(x) as integer) as n_items, coalesce(array_to_string(list_transform(x, lambda r: r.label), '|'), '') as labels
from (select event_id, case when event_id % 5 in (0, 1) then []
        else [{'label': 'Route branch', 'value': route_path, 'impact': 'neutral'},
              {'label': 'SLA risk', 'value': sla_risk_level, 'impact': 'negative'}] end as x
      from routing_decisions)""", "routing_decisions"))
def q_explanation_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-10 over stored explanations (valid JSON lists, junk and blanks)."""
    j = _explanation_json(fixtures.routing_decisions(spark, sf_dir))
    x = T.parse_explanation(F.col("route_explanation"))
    return j.select("event_id", F.size(x).alias("n_items"),
                    F.array_join(F.transform(x, lambda r: r["label"]), "|").alias("labels"))


def _model_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model-response strings derived from conversation turns: JSON objects (steps as
    list or text), fenced JSON, arrays and plain prose."""
    c = _conv(spark, sf_dir)
    obj = F.to_json(F.struct(
        F.col("text").alias("resolution_steps"),
        ((F.col("conv_id") * 7 + F.col("turn")) % 11 / 10.0).alias("confidence_score"),
        (F.col("turn") % 2 == 0).alias("escalation_required"),
        F.col("role").alias("rationale")))
    obj_list = F.to_json(F.struct(
        F.split("text", "\n").alias("resolution_steps"), F.lit(0.82).alias("confidence_score")))
    k = F.col("turn") % 5
    payload = (F.when(k == 0, obj).when(k == 1, F.concat(F.lit("```json\n"), obj_list, F.lit("\n```")))
               .when(k == 2, F.lit("[1, 2]")).when(k == 3, F.col("text")).otherwise(obj_list))
    return c.select("conv_id", "turn", payload.alias("payload"))


@register("lenient_json")
def q_lenient_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-4 (rows): parsed object as JSON text, NULL when the payload holds no JSON."""
    p = _model_payloads(spark, sf_dir)
    return p.select("conv_id", "turn", F.to_json(T.lenient_json(F.col("payload"))).alias("parsed"))


@register("parse_decisions")
def q_parse_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-3/TXT-5 (rows): steps, clamped confidence, escalation default and clipped rationale."""
    p = _model_payloads(spark, sf_dir)
    d = T.model_decision(F.col("payload"))
    return p.select("conv_id", "turn", d["parsed"].alias("parsed"), d["steps"].alias("steps"),
                    d["confidence"].alias("confidence"), d["escalation_required"].alias("escalation_required"),
                    d["rationale"].alias("rationale"))


@register("stable_ids", """
select doc_id, concat('ticket_', substring(sha256(concat(coalesce(text, ''), chr(0), concat('INC', """ + padded_sql("doc_id", 7) + """), chr(0))), 1, 16)) as ticket_id
from documents""")
def q_stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RED-16/17: service-path ticket id over (text, number) when no id is given."""
    d = _docs(spark, sf_dir)
    number = F.concat(F.lit("INC"), padded(F.col("doc_id"), 7))
    return d.select("doc_id", stable_id("ticket", F.col("text"), number).alias("ticket_id"))


@register("ticket_ids_local", """
select doc_id, case when doc_id % 3 = 0 then 'T' || cast(doc_id as varchar) when doc_id % 3 = 1 then 'N' || cast(doc_id as varchar)
  else substring(sha256(coalesce(text, '')), 1, 16) end as ticket_id from documents""")
def q_ticket_ids_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RED-17, local path: the given id, else the number, else 16 hex digits of the (sanitized) text's hash."""
    d, i = _docs(spark, sf_dir), F.col("doc_id")
    given = F.when(i % 3 == 0, F.concat(F.lit("T"), i.cast("string")))
    number = F.when(i % 3 == 1, F.concat(F.lit("N"), i.cast("string"))).otherwise(F.lit(""))
    return d.select("doc_id", local_ticket_id(given, number, F.sha2("text", 256)).alias("ticket_id"))


@register("as_number", """
with w as (select conv_id, turn, string_split(coalesce(text, ''), ' ')[1] as word from conversations),
v as (select *, case turn % 6 when 0 then cast(conv_id as varchar) when 1 then '' when 2 then '1e3' when 3 then word
        when 4 then 'NaN' else cast(turn as varchar) || '.25' end as s from w)
select conv_id, turn, case turn % 6 when 0 then cast(conv_id as double) when 2 then 1000.0 when 3 then try_cast(word as double)
  when 5 then turn + 0.25 end as number from v""")
def q_as_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-11."""
    c, m = _conv(spark, sf_dir), F.col("turn") % 6
    raw = (F.when(m == 0, F.col("conv_id").cast("string")).when(m == 1, "").when(m == 2, "1e3").when(m == 3, F.split("text", " ")[0])
           .when(m == 4, "NaN").otherwise(F.concat(F.col("turn").cast("string"), F.lit(".25"))))
    return c.select("conv_id", "turn", T.as_number(raw).alias("number"))
