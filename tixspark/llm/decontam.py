"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

A window is 13 consecutive words of a benchmark item (an item of fewer words is one window).
The shingles of a window are its runs of ``SHINGLE`` words (fewer where the window is
shorter). For exact containment one prefix token is enough: the window's shingle that is
rarest in the documents, counted over all of them. Document shingles are joined with these
prefix tokens only; the place of the token in the window gives the one start that the window
can have (positional bound), which must leave room for the window (length bound); then the
words there are compared with the window's.

Defined results: null text has no words; documents and items without words match nothing; a
null item_id takes no part; repeated items and repeated documents count as one text each and
every document row is returned; empty tables give no hits; columns besides doc_id, item_id and
text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, staged

WINDOW, SHINGLE = 13, 3
#: A document is contaminated when at least 1 / SHARE of its words are hit.
SHARE = 20
#: Windows that are broadcast at once (each some 200 bytes); more are joined in several passes.
PASS_WINDOWS = 200_000
_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased; null: none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _BREAKS), "")


def item_windows(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row per distinct window: win (its words), m, width (of its shingles), items (ids as strings)."""
    w = items.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w"))
    w = w.where("size(w) > 0").withColumn("m", F.least(F.lit(window), F.size("w")))
    w = w.withColumn("at", F.explode(F.expr("sequence(0, size(w) - m)")))
    w = w.select("item", F.slice("w", F.col("at") + 1, F.col("m")).alias("win"), "m")
    return w.groupBy("win", "m").agg(F.collect_set("item").alias("items")).withColumn("width", F.least("m", F.lit(shingle)))


def _shingles(df: DataFrame, array: str, width: int, at: str) -> DataFrame:
    """A row for each run of ``width`` words in ``array``: its place ``at`` and its hash ``h``.

    Zipping the array with itself shifted keeps the work in generated code.
    """
    shifted = [F.slice(array, i + 1, F.greatest(F.lit(0), F.size(array) - (width - 1))).alias(f"_{i}") for i in range(width)]
    df = df.where(F.size(array) >= width).select("*", F.posexplode(F.arrays_zip(*shifted)).alias(at, "_z"))
    return df.withColumn("h", F.xxhash64(F.lit(width), *[F.col(f"_z._{i}") for i in range(width)])).drop("_z")


def find_windows(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Occurrences of item windows: doc_id, text_key, start, length, items.

    ``docs`` has doc_id and text; text_key is a hash of the text that tells apart rows of one id.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), words(F.col("text")).alias("w"))
    wins = staged(item_windows(items, window, shingle).withColumn("part", F.monotonically_increasing_id()))
    schema = "doc_id {}, text_key bigint, start int, length int, items array<string>".format(docs.schema["doc_id"].dataType.simpleString())
    n, widths = wins.agg(F.count("*"), F.array_sort(F.collect_set("width"))).first()
    if not n:
        return spark.createDataFrame([], schema)

    # Rarity of the shingles, over all documents.
    tokens = staged(reduce(DataFrame.unionByName, [_shingles(wins.where(F.col("width") == k), "win", k, "off") for k in widths]))
    passes = -(-n // PASS_WINDOWS)

    def joined(texts: DataFrame, side: DataFrame) -> Iterator[DataFrame]:
        for i in range(passes):
            part = F.broadcast(side.where(F.pmod("h", F.lit(passes)) == i))
            for k in widths:
                yield _shingles(texts, "w", k, "pos").join(part, "h")

    vocabulary = staged(tokens.select("h").distinct())
    counts = [x.groupBy("h").agg(F.count("*").alias("df")) for x in joined(docs.select("w"), vocabulary)]
    counts = reduce(DataFrame.unionByName, counts)
    rarest = Window.partitionBy("part").orderBy("df", "h", "off")
    prefix = (
        tokens.join(counts, "h", "left")
        .withColumn("df", F.coalesce("df", F.lit(0)))
        .withColumn("rank", F.row_number().over(rarest))
        .where("rank = 1 and df > 0")  # a window with a shingle that no document has occurs nowhere
    )
    prefix = prefix.groupBy("h").agg(F.collect_list(F.struct("off", "m", "win", "items")).alias("wins"))
    prefix = staged(prefix)

    fits = F.filter(
        "wins",
        lambda x: (F.col("pos") >= x["off"])
        & (F.col("pos") - x["off"] + x["m"] <= F.size("w"))
        & (F.slice("w", F.greatest(F.lit(1), F.col("pos") - x["off"] + 1), x["m"]) == x["win"]),
    )
    found = reduce(DataFrame.unionByName, list(joined(docs, prefix)))
    return found.select("doc_id", "text_key", "pos", F.explode(fits).alias("x")).select(
        "doc_id", "text_key", (F.col("pos") - F.col("x.off")).alias("start"), F.col("x.m").alias("length"), F.col("x.items").alias("items")
    )


def text_key(text: Column) -> Column:
    return F.xxhash64(text, F.octet_length(text))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = SHARE, keys: bool = False) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; with ``keys`` also text_key."""
    spans = find_windows(docs, items, window)
    # Words covered by the spans of a text: sorted by start, each adds what reaches beyond those before.
    covered = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", "length"))),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["start"] + s["length"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(acc["end"], s["start"]))).alias("n"),
        ),
        lambda acc: acc["n"],
    )
    per_doc = spans.groupBy("doc_id", "text_key").agg(
        covered.cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )
    base = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    hit = per_doc.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k"), "n_hit", "items")
    out = base.join(hit, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_k")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    ids = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", *(["text_key"] if keys else []), "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the contaminated rows, all columns kept."""
    bad = contamination(docs, items, keys=True).where("contaminated").select(F.col("doc_id").alias("__d"), F.col("text_key").alias("__k")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col("__d")) & (text_key(docs["text"]) == F.col("__k")), "left_anti")
