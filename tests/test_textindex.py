import pyarrow as pa

from tixspark.operators.textindex import TextIndex, grams_of, posting_lists
from tixspark.sources.store import FactStore


def brute(keys, columns):
    found = {}
    for i, key in enumerate(keys):
        for texts in columns:
            for g in grams_of(texts[i] or ""):
                found.setdefault(g, set()).add(key)
    return found


def lists(keys, columns):
    rows = posting_lists(pa.array(keys, pa.string()), [pa.array(c, pa.string()) for c in columns]).to_pylist()
    assert len({r["gram"] for r in rows}) == len(rows) and all(len(set(r["ticket_id"])) == len(r["ticket_id"]) for r in rows)
    return {r["gram"]: set(r["ticket_id"]) for r in rows}


def test_posting_lists_hold_every_gram_of_every_text():
    keys = ["b", "a", "b", None, "c"]  # versions of a ticket, a ticket without an id
    columns = [["abcabc", "ab", None, "xyz", "\n\n\n"], ["😀😀😀é", "ééé", "abc", "", "a\0b"]]
    assert lists(keys, columns) == brute(keys, columns)
    assert lists(["a"], [[""], [None]]) == {}
    # More characters and tickets than a key of 63 bits holds.
    wide = "".join(chr(c) for c in range(0x10000, 0x10000 + 200_000))
    names = [f"t{i}" for i in range(900)]
    texts = [wide, *["abc"] * 899]
    got = lists(names, [texts])
    assert got["abc"] == set(names[1:]) and len(got) == 200_000 - 2 + 1 and got[wide[:3]] == {"t0"}


def test_postings_are_stored_as_lists(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "s"), buckets=2)
    store.append("t", spark.createDataFrame([(f"k{i:03d}", "the same words") for i in range(300)], "ticket_id string, body string").coalesce(1), 0)
    index = TextIndex(store, "t", ("body",))
    index.advance()
    grams = len(grams_of("the same words"))
    assert store.read("t.grams").count() == 300 * grams
    assert spark.read.parquet(f"{store.root}/t.grams").count() <= 2 * grams  # a row per gram and task, not per gram and ticket
    assert index.candidates("same").count() == 300
    again = FactStore(spark, store.root)  # the listed column is known after a restart
    spark.sql(f"drop table {store.name_of('t.grams')}")
    assert again.read("t.grams").where("gram = 'ame'").count() == 300
