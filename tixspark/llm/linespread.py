"""Line dedup by the number of distinct sites that a line is on.

Lines (split at line feeds) are normalised (runs of white space become one space, trimmed) and
hashed. A HyperLogLog sketch of the sites per line hash is made and merged by the aggregation.
Lines well above the threshold are boilerplate by their sketch alone; those near it get an exact
distinct count. Boilerplate lines go from documents. A document in which more than
``KEEP_SHARE`` of the characters are such lines is left whole for the near-duplicate step if it
really is a copy: all its lines with a character are such lines, or a document of another id
has the same text. Short pages that are mostly header and footer lose them like any other.

Defined results: a null site is no site; lines without a character are never boilerplate; null
texts have no lines and stay null; repeated rows are rows of their own and get the same answer;
an empty table gives an empty result; other columns are kept as they are
(names that begin with two underscores are the operator's own).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_side, staged

MIN_SITES, LG_K, BAND, KEEP_SHARE = 6, 12, 0.25, 0.5


def normal_line(line: Column) -> Column:
    """Most lines have single spaces only, which the search for anything else finds faster than the pattern."""
    other = reduce(lambda a, b: a | b, [F.contains(line, F.lit(c)) for c in ("  ", "\t", "\n", "\v", "\f", "\r")])
    return F.trim(F.when(other, F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")).otherwise(line))


def line_key(line: Column) -> Column:
    """128 bits of hash of a normalised line."""
    return F.unhex(F.md5(line))


def lines_of(docs: DataFrame, *keep: str) -> DataFrame:
    """A row per line: ``keep``, at (its number), line (normalised), key."""
    # Lines are normalised and hashed before they become rows: filters on rows would do it again.
    lines = F.transform(F.transform(F.split("text", "\n"), normal_line), lambda x: F.struct(x.alias("line"), line_key(x).alias("key")))
    rows = docs.where("text is not null").select(*keep, F.posexplode(lines).alias("at", "of"))
    return rows.select(*keep, "at", F.col("of.line").alias("line"), F.col("of.key").alias("key")).where("line != ''")


def widespread_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """key, sites (estimated, or exact near the threshold) of the lines on at least ``min_sites`` sites."""
    lines = lines_of(docs.select("text", F.col(site).alias("_site")), "_site").where("_site is not null").select("key", "_site")
    sketch = lines.groupBy("key").agg(F.hll_sketch_agg("_site", F.lit(LG_K)).alias("s"))
    sketch = sketch.select("key", F.hll_sketch_estimate("s").alias("sites")).where(F.col("sites") >= int(min_sites * (1 - BAND)))
    sketch = staged(sketch)
    near = F.col("sites") <= min_sites * (1 + BAND)
    exact = lines.join(small_side(sketch.where(near).select("key")), "key").distinct().groupBy("key").agg(F.count("*").alias("sites"))
    return staged(sketch.where(~near).unionByName(exact).where(F.col("sites") >= min_sites))


def _cuts(docs: DataFrame, wide: DataFrame, keep_share: float) -> DataFrame:
    """doc_id, text_key, cut (numbers of the boilerplate lines), __mostly (more than ``keep_share``), __docs (with the text, null for one)."""
    docs = docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key"), F.length("text").alias("chars"))
    hits = lines_of(docs, "doc_id", "text_key", "chars").join(small_side(wide.select("key")), "key")
    hits = hits.groupBy("doc_id", "text_key", "at").agg(F.max(F.length("line")).alias("n"), F.max("chars").alias("chars"))  # repeated rows: once
    mostly = (F.sum("n") > keep_share * F.max("chars")).alias("__mostly")
    cuts = staged(hits.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list("at")).alias("cut"), mostly))
    # Documents of one text have the same lines cut, so all of them are here.
    copied = staged(cuts.where("__mostly").groupBy("text_key").agg(F.count("*").alias("__docs")).where("__docs > 1"))
    return cuts.join(small_side(copied), "text_key", "left")


def text_key(text: Column) -> Column:
    return F.xxhash64(text, F.octet_length(text))


def drop_boilerplate(
    docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, keep_share: float = KEEP_SHARE, report: bool = False
) -> DataFrame:
    """``docs`` with the boilerplate lines taken out of ``text``; with ``report`` also n_lines and cut (numbers of the lines that went)."""
    wide = widespread_lines(docs, site, min_sites)
    cuts = _cuts(docs, wide, keep_share).select(F.col("doc_id").alias("__d"), F.col("text_key").alias("__k"), F.col("cut").alias("__c"), "__mostly", "__docs")
    rows = docs.join(cuts, docs["doc_id"].eqNullSafe(F.col("__d")) & (text_key(docs["text"]) == F.col("__k")), "left")
    whole = F.size("__c") == F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D][^\n]*"))  # every line with a character
    copy = F.when(F.col("__mostly"), F.col("__docs").isNotNull() | whole).otherwise(False)
    cut = F.when(F.col("__c").isNotNull() & ~copy, F.col("__c")).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("__lines", F.split("text", "\n")).withColumn("__cut", cut)
    rows = rows.withColumn("__count", F.when(F.col("text").isNull(), 0).otherwise(F.size("__lines")))
    left = F.array_except(F.sequence(F.lit(0), F.col("__count") - 1), F.col("__cut"))
    kept = F.transform(left, lambda i: F.get(F.col("__lines"), i))
    text = F.when(F.size("__cut") > 0, F.array_join(kept, "\n")).otherwise(F.col("text"))
    more = [F.col("__count").cast("long").alias("n_lines"), F.col("__cut").alias("cut")] if report else []
    return rows.withColumn("text", text).select(*docs.columns, *more)


def spread_digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines, n_cut, text_sha256 (of what is left; null for null)."""
    out = drop_boilerplate(docs.select("doc_id", "text", "source"), report=True)
    return out.select("doc_id", "n_lines", F.size("cut").cast("long").alias("n_cut"), F.sha2("text", 256).alias("text_sha256"))
