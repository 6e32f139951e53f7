"""The pipeline against the operators' brute-force versions, stage by stage."""

import re

import corpus_pipeline
from pyspark.sql import functions as F
from .test_decontam import brute as windows
from .test_setjoin import brute as near

from tixspark.llm.common import staged, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "123 456", "en", "s", 7), (10**6 + 2, "", "en", "s", 0)], docs.schema)
    docs = staged(docs.unionByName(odd))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "ngram_join", "decontamination", "mixing"]
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(staged(stage(spark, tables[-1], SF)))
    ids = [[r.doc_id for r in t.select("doc_id").collect()] for t in tables]
    assert all(t.columns == docs.columns for t in tables[:-1])
    assert sorted(ids[1]) == sorted(r.doc_id for r in docs.collect() if r.text and re.search(r"[^\W\d_]", r.text))

    lines, where = {}, {}
    before = tables[1].collect()
    for r in before:
        for x in r.text.split("\n"):
            x = " ".join(re.findall(r"[^\x20\x09-\x0D]+", x))
            if x and r.source is not None:
                where.setdefault(x, set()).add(r.source)
    for r in before:
        norm = [" ".join(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in r.text.split("\n")]
        wide = [len(where.get(x, ())) >= 6 for x in norm]
        gone = any(wide) and sum(len(x) for x, w in zip(norm, wide, strict=True) if w) <= 0.5 * len(r.text)
        lines[r.doc_id] = "\n".join(x for x, w in zip(r.text.split("\n"), wide, strict=True) if not w) if gone else r.text
    assert {r.doc_id: r.text for r in tables[2].collect()} == lines
    assert sorted(ids[3]) == sorted(d for d, _, c in near(tables[2].collect()) if d == c)
    # After the copies went, what is still on six sites goes too.
    alone = [(r.doc_id, r.source, r.text) for r in tables[2].collect() if r.doc_id in set(ids[3])]
    left = {}
    for _, source, text in alone:
        for x in text.split("\n"):
            if (x := " ".join(re.findall(r"[^\x20\x09-\x0D]+", x))) and source is not None:
                left.setdefault(x, set()).add(source)
    wide = {x for x, sites in left.items() if len(sites) >= 6}
    cut = {d: "\n".join(x for x in text.split("\n") if " ".join(re.findall(r"[^\x20\x09-\x0D]+", x)) not in wide) for d, _, text in alone}
    assert {r.doc_id: r.text for r in tables[3].collect()} == cut
    bad = {w[0] for w in windows(tables[3].collect(), table(spark, SF, "benchmark").collect()) if w[-1]}
    assert sorted(ids[4]) == sorted(set(ids[3]) - bad)
    assert sorted(ids[5]) == sorted(ids[4])
    total = tables[5].agg(F.sum("taken"), F.sum("size")).first()
    assert abs(total[0] - 1.5 * total[1]) <= 25
    again = corpus_pipeline.STAGES[4][1](spark, tables[4].repartition(3), SF)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, tables[5].collect()))


def test_empty_input(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF))
    assert docs.count() == 0
