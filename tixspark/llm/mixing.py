"""Mixing sources to target weights, in DataFrame operations only.

The words of each source, in a pseudorandom order of its documents, are packed into blocks of
``block_words`` words (the last one may be shorter). Output shards have ``shard_slots`` slots;
the source of each slot is an independent categorical draw, so a shard's counts are
multinomial. Draws beyond a source's own number of slots are given to sources that were drawn
too seldom, so that each source comes out at its target. A source's slots, numbered through the
shards, are mapped to blocks by a pseudorandom permutation of the block indices, a new one for
each pass over the source, and joined with the blocks by index.

Defined results: null text has no words; a null ``source`` is a source of its own, last in
order; documents without words are never taken; repeated rows are rows of their own; an empty
table gives an empty result; columns other than doc_id, text and source are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, running_start, staged

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Words of the mix as a share of all words, and the most passes over one source.
TOTAL_SHARE, MAX_PASSES = 1.5, 2
BLOCK_WORDS, SHARD_SLOTS, SEED = 1024, 1024, 20240


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACES}]+")), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = TOTAL_SHARE, passes: int = MAX_PASSES
) -> DataFrame:
    """(skey, source_size, target): ``share`` of all words by weight, no target above ``passes`` times its source.

    A source is full when its share at the water level would be above its cap. With the sources
    in order of cap / weight, whether one is full depends only on those before it. The windows
    without keys run over one row per source.
    """
    src = sizes.groupBy("skey").agg(F.sum("size").alias("source_size"))
    w = F.array(*[F.lit(float(x)) for x in weights])
    rank = F.row_number().over(Window.orderBy("skey"))
    src = src.withColumn("w", F.element_at(w, (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int")))
    src = src.withColumn("cap", F.col("source_size") * float(passes))
    every = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("w"), "skey").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    src = src.withColumn("total", F.sum("source_size").over(every) * float(share))
    src = src.withColumn("rest", F.col("total") - F.coalesce(F.sum("cap").over(before), zero))
    src = src.withColumn("rest_w", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), zero))
    src = src.withColumn("full", F.col("rest") * F.col("w") >= F.col("cap") * F.col("rest_w"))
    full = F.col("full")
    src = src.withColumn("left", F.col("total") - F.sum(F.when(full, F.col("cap")).otherwise(zero)).over(every))
    src = src.withColumn("left_w", F.sum(F.when(full, zero).otherwise(F.col("w"))).over(every))
    target = F.when(full, F.col("cap")).otherwise(
        F.least(F.col("cap"), F.greatest(zero, F.col("left")) * F.col("w") / F.col("left_w"))
    )
    return src.select("skey", "source_size", target.alias("target"))


def permuted(x: Column, n: Column, *seed: Column) -> Column:
    """A pseudorandom permutation of 0..n-1 at ``x``: a Feistel network on a grid of a x b >= n cells.

    A value outside is put through again until it is inside; fewer than a of the a*b cells are
    outside, so 64 rounds always do for n up to 4096, and else fail with a chance below 2^-384.
    """
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n / a).cast("long")

    def step(v: Column) -> Column:
        left, right = F.floor(v / b).cast("long"), F.pmod(v, b)
        for i in range(2):
            left = F.pmod(left + F.pmod(F.xxhash64(F.lit(2 * i), right, *seed), a), a)
            right = F.pmod(right + F.pmod(F.xxhash64(F.lit(2 * i + 1), left, *seed), b), b)
        return left * b + right

    first = step(x)
    again = F.aggregate(F.sequence(F.lit(1), F.lit(64)), first, lambda v, _: F.when(v < n, v).otherwise(step(v)))
    y = F.when(first < n, first).otherwise(again)
    return F.when(y < n, y).otherwise(F.raise_error(F.lit("permutation did not end")))


def _cells(intervals: DataFrame, width: int) -> DataFrame:
    """One row per cell of ``width`` numbers that an interval [lo, hi) meets."""
    return intervals.where("hi > lo").withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width)))
    )


@dataclass
class Mix:
    documents: DataFrame  # doc_id, skey, size, start: where the document's words are in its source
    sources: DataFrame  # skey, source_size, target
    pieces: DataFrame  # shard, skey, slot, epoch, block, doc_id, start, word_from, word_to


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = TOTAL_SHARE,
    passes: int = MAX_PASSES,
    block_words: int = BLOCK_WORDS,
    shard_slots: int = SHARD_SLOTS,
    seed: int = SEED,
) -> Mix:
    spark = docs.sparkSession
    sizes = docs.select(
        "doc_id",
        F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), "source")).alias("skey"),
        word_count(F.col("text")).alias("size"),
    )
    sizes = staged(sizes)
    placed = staged(running_start(sizes, "skey", "size", ["doc_id", "size"], "start", seed))
    sources = staged(source_targets(sizes, weights, share, passes))

    # Slots of each source: whole passes, then as many blocks as the rest of the target needs.
    plan = (
        sources.where("source_size > 0")
        .withColumn("words", F.round("target").cast("long"))
        .withColumn("whole", F.expr(f"source_size div {block_words}"))
        .withColumn("blocks", F.expr(f"whole + if(source_size % {block_words} > 0, 1, 0)"))
        .withColumn("rest", F.expr("words % source_size"))
        .withColumn("n", F.expr(f"(words div source_size) * blocks + (rest + {block_words - 1}) div {block_words}"))
        .where("n > 0")
        .withColumn("hi", F.sum("n").over(Window.orderBy("skey").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("lo", F.col("hi") - F.col("n"))
    )
    plan = staged(plan.select("skey", "source_size", "words", "whole", "blocks", "n", "lo", "hi"))
    slots, n_sources = plan.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()

    # A categorical draw per slot: the interval of slot counts in which a random number falls.
    width = max(1, slots // max(1, n_sources))
    drawn = spark.range(0, slots).select(
        F.floor(F.col("id") / shard_slots).alias("shard"),
        F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), "id"), F.lit(max(1, slots))).alias("v"),
    )
    drawn = drawn.withColumn("cell", F.floor(F.col("v") / width)).join(
        _cells(plan.select("skey", "lo", "hi"), width), "cell"
    )
    counts = drawn.where("v >= lo and v < hi").groupBy("skey", "shard").agg(F.count("*").alias("c"))
    counts = staged(counts)
    got = counts.groupBy("skey").agg(F.sum("c").alias("got"))
    # Number a source's draws through the shards; groups of 256 shards keep each window short.
    counts = counts.withColumn("g", F.floor(F.col("shard") / 256))
    prior = Window.unboundedPreceding
    zero = F.lit(0).cast("long")
    group = counts.groupBy("skey", "g").agg(F.sum("c").alias("gc"))
    group = group.select(
        "skey", "g", F.coalesce(F.sum("gc").over(Window.partitionBy("skey").orderBy("g").rowsBetween(prior, -1)), zero).alias("g0")
    )
    within = Window.partitionBy("skey", "g").orderBy("shard").rowsBetween(prior, -1)
    counts = counts.withColumn("c0", F.coalesce(F.sum("c").over(within), zero)).join(group, ["skey", "g"])
    counts = counts.withColumn("t0", F.col("g0") + F.col("c0")).drop("g", "g0", "c0")

    # Draws over a source's number of slots go, in order, to the sources that got too few.
    balance = plan.join(got, "skey", "left").withColumn("got", F.coalesce("got", zero))
    by_key = Window.orderBy("skey").rowsBetween(prior, -1)
    balance = (
        balance.withColumn("over", F.greatest(zero, F.col("got") - F.col("n")))
        .withColumn("short", F.greatest(zero, F.col("n") - F.col("got")))
        .withColumn("over0", F.coalesce(F.sum("over").over(by_key), zero))
        .withColumn("short0", F.coalesce(F.sum("short").over(by_key), zero))
    )
    balance = staged(balance)
    facts = ["skey", "source_size", "words", "whole", "blocks"]
    counts = counts.join(balance.select(*facts, "n", "over0"), "skey")
    counts = counts.withColumn("kept", F.greatest(zero, F.least(F.col("c"), F.col("n") - F.col("t0"))))
    own = counts.where("kept > 0").withColumn("t", F.explode(F.expr("sequence(t0, t0 + kept - 1)")))
    spare = counts.where("c > kept").select(
        "shard", F.explode(F.expr("sequence(over0 + t0 + kept - n, over0 + t0 + c - 1 - n)")).alias("r")
    )
    n_short = balance.agg(F.coalesce(F.sum("short"), zero)).first()[0]
    cell = max(1, n_short // max(1, n_sources))
    needs = _cells(balance.withColumn("lo", F.col("short0")).withColumn("hi", F.col("short0") + F.col("short")), cell)
    moved = spare.withColumn("cell", F.floor(F.col("r") / cell)).join(needs, "cell").where("r >= lo and r < hi")
    moved = moved.withColumn("t", F.col("got") + F.col("r") - F.col("lo"))
    cols = ["shard", *facts, "t"]
    slot = own.select(*cols).unionByName(moved.select(*cols))

    # The block of a slot, and how many of its words the slot takes (fewer only in a source's last one).
    slot = (
        slot.withColumn("epoch", F.expr("t div blocks"))
        .withColumn("k", F.expr("t % blocks"))
        .withColumn(
            "block",
            F.when(F.col("k") < F.col("whole"), permuted(F.col("k"), F.col("whole"), F.lit(seed), F.col("skey"), F.col("epoch")))
            .otherwise(F.col("whole")),
        )
        .withColumn("take", F.least(F.lit(block_words).cast("long"), F.col("words") - F.col("epoch") * F.col("source_size") - F.col("k") * block_words))
        .select("shard", "skey", F.col("t").alias("slot"), "epoch", "block", "take")
    )
    parts = placed.where("size > 0").withColumn(
        "block",
        F.explode(F.expr(f"sequence(start div {block_words}, (start + size - 1) div {block_words})")),
    )
    first = F.greatest(F.col("start"), F.col("block") * block_words)
    parts = parts.select(
        "skey", "block", "doc_id", "start", "size", first.alias("from_"),
        F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words).alias("to_"),
    )
    pieces = slot.join(parts, ["skey", "block"])
    end = F.least(F.col("to_"), F.col("block") * block_words + F.col("take"))
    pieces = pieces.select(
        "shard", "skey", "slot", "epoch", "block", "doc_id", "start",
        (F.col("from_") - F.col("start")).alias("word_from"), (end - F.col("start")).alias("word_to"),
    ).where("word_to > word_from")
    return Mix(placed, sources, pieces)


def mix_digest(mix: Mix) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words the mix takes, repeats counted), source."""
    taken = mix.pieces.groupBy("skey", "start").agg(F.sum(F.expr("word_to - word_from")).alias("taken"))
    docs = mix.documents.withColumn("start", F.when(F.col("size") > 0, F.col("start")).otherwise(F.lit(-1)))
    out = docs.join(taken, ["skey", "start"], "left").join(mix.sources, "skey")
    source = F.when(F.col("skey") != "1", F.expr("substring(skey, 2)"))
    return out.select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), source.alias("source")
    )
