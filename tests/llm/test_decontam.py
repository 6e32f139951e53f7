import random
import re

from .helpers import DOCS, LOWER, awkward, sha, with_clashes, words

from tixspark.llm import decontam
from tixspark.llm.common import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, items):
    wins = {}
    for x in items:
        w = WORD.findall((x.text or "").translate(LOWER))
        if x.item_id is not None and w:
            m = min(13, len(w))
            for i in range(len(w) - m + 1):
                wins.setdefault(tuple(w[i : i + m]), set()).add(str(x.item_id))
    out = []
    for x in docs:
        w, hit, seen = WORD.findall((x.text or "").translate(LOWER)), set(), set()
        for m in {len(k) for k in wins}:
            for i in range(len(w) - m + 1):
                if got := wins.get(tuple(w[i : i + m])):
                    hit.update(range(i, i + m))
                    seen |= got
        out.append((x.doc_id, len(w), len(hit), len(seen), sha(",".join(sorted(seen))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def got(docs, items):
    return sorted(map(tuple, decontam.contamination(docs, items).collect()), key=repr)


def test_documents(spark):
    docs, items = (table(spark, "/root/testdata/sf0.001", t) for t in ("documents", "benchmark"))
    want = brute(docs.collect(), items.collect())
    assert got(docs, items) == want


def test_planted_windows_and_short_items(spark):
    rng = random.Random(1)
    items = [(i, words(rng, n, 30)) for i, n in enumerate((13, 14, 30, 40, 1, 2, 3, 5, 12, 12))]
    items += [(3, items[3][1]), (20, items[2][1]), (None, "the words of no item"), (21, None), (22, "..."), (23, "w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1")]
    rows = []
    for i in range(80):
        text = words(rng, rng.randint(0, 300), 30)
        for _ in range(rng.randint(0, 3)):
            w = items[rng.randrange(10)][1].split()
            a = rng.randrange(len(w))
            text += ", " + "--".join(w[a : a + rng.randint(1, 40)]).upper() + " " + words(rng, rng.randint(0, 20), 30)
        rows.append((i, text, None, None, None))
    rows += [(200, "w1 " * 60, None, None, None), *awkward()]
    docs, items = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs.collect(), items.collect())
    assert got(with_clashes(docs), with_clashes(items)) == want
    clean = decontam.clean_documents(with_clashes(docs), items)
    assert clean.columns == with_clashes(docs).columns
    assert clean.count() == sum(not w[-1] for w in want)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(awkward(), DOCS), spark.createDataFrame([], "item_id long, text string")
    assert all(r[2] == 0 and not r[5] for r in got(docs, items))
    assert got(docs.limit(0), items) == []


def test_several_passes(spark, monkeypatch):
    docs, items = (table(spark, "/root/testdata/sf0.001", t) for t in ("documents", "benchmark"))
    want = got(docs, items)
    monkeypatch.setattr(decontam, "PASS_WINDOWS", 200)
    assert got(docs, items) == want
