import pytest
from .helpers import DOCS, awkward, split5, with_clashes
from pyspark.sql import functions as F

from tixspark.llm import mixing
from tixspark.llm.common import table


def targets(sizes: dict, weights=(5, 2, 1), share=1.5, passes=2) -> dict:
    """Share by weight, cap, share the excess again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, free, rest = {}, set(names), share * sum(sizes.values())
    while free:
        level = rest / sum(w[s] for s in free)
        full = {s for s in free if level * w[s] > passes * sizes[s] + 1e-9}
        if not full:
            out |= {s: level * w[s] for s in free}
            break
        out |= {s: float(passes * sizes[s]) for s in full}
        rest -= sum(passes * sizes[s] for s in full)
        free -= full
    return out


def check(rows, docs):
    sizes, taken = {}, {}
    for r in docs:
        sizes[r.source] = sizes.get(r.source, 0) + len(split5(r.text))
    want = targets(sizes)
    assert len(rows) == len(docs)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], abs=1e-6)
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, n in taken.items():
        assert abs(n - want[s]) <= 0.51


def test_mix_of_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = mixing.mix_digest(mixing.mix_sources(docs, block_words=64, shard_slots=16)).collect()
    check(rows, docs.select("text", "source").collect())
    again = mixing.mix_digest(mixing.mix_sources(docs.repartition(7), block_words=64, shard_slots=16)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_spans_of_the_mix(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").limit(60)
    mix = mixing.mix_sources(docs, block_words=32, shard_slots=8)
    p = mix.pieces.toPandas()
    assert (p.word_to > p.word_from).all() and (p.word_from >= 0).all()
    slots = p.groupby(["skey", "slot"]).agg(n=("word_to", "sum"), f=("word_from", "sum"), shard=("shard", "nunique"), block=("block", "nunique"))
    assert (slots.n - slots.f <= 32).all() and (slots.shard == 1).all() and (slots.block == 1).all()
    one_pass = p.drop_duplicates(["skey", "slot"])
    assert not one_pass.duplicated(["skey", "epoch", "block"]).any()  # a permutation in each pass


def test_permutation(spark):
    for n in (1, 2, 3, 7, 64, 1000):
        x = mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit("s"))
        got = [r[0] for r in spark.range(n).select(x).collect()]
        assert sorted(got) == list(range(n))
    assert got != list(range(n))


def test_awkward_rows(spark):
    docs = with_clashes(spark.createDataFrame(awkward(), DOCS))
    rows = mixing.mix_digest(mixing.mix_sources(docs)).collect()
    check(rows, docs.collect())
    assert mixing.mix_digest(mixing.mix_sources(docs.limit(0))).collect() == []
    none = docs.where("text is null")
    assert all(r.taken == 0 and r.target == 0 for r in mixing.mix_digest(mixing.mix_sources(none)).collect())
