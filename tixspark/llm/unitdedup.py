"""Substring dedup by hashing sentences and lines.

A unit is a sentence (up to one of ``MARKS`` or a line feed; in Thai, Lao, Khmer and Burmese also
to white space, which ends a phrase there) or, where that has fewer than ``UNIT_WORDS``
words, it and what follows in its line until there are as many. A sentence of ``LONG`` words or more is cut
further, after words chosen by their hash, so that its parts are the same wherever they stand. Units are normalised (lower case, words
joined by one space, marks at the end dropped) and hashed to 128 bits; equal digests are grouped over all
documents. The earliest occurrence, by doc_id and then by place, stays. Of the others, those
that stand next to each other are one passage. A passage is then grown, word by word into the units
before and after it, as far as it agrees with what surrounds the occurrence that stays; passages that
meet are one. Passages of at least ``MIN_WORDS`` words are spans to remove, with the offsets they have
in the original text. Text that is written without white space counts by its characters: two of Han or kana, five of Thai, Lao,
Khmer or Burmese are a word.

Defined results: null texts have no units; shorter repeats are never removed; repeated rows are
one document, whose units are not repeats of each other; rows with a null doc_id come last in
the order; an empty table gives an empty result; other columns are kept as they are (names that
begin with two underscores are the operator's own).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_hot, staged

MIN_WORDS, UNIT_WORDS = 20, 5
#: Words of a sentence that is cut further, on average every CUT words after the first UNIT_WORDS of a part.
LONG, CUT = 40, 16
#: Rows of texts worked on at once.
ROWS = 256
#: What ends a sentence.
MARKS = ".!?…‼⁇⁈⁉。！？．｡؟۔।॥።։"
_HAN, _PHRASED = "぀-ヿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ\U00020000-\U0003ffff", "฀-໿က-႟ក-៿"
_SENTENCE = re.compile(r"[^.!?]*[.!?]+|[^.!?]+")
_MARKED = re.compile(f"[^{MARKS}]*[{MARKS}]+|[^{MARKS}]+")
_PHRASE = re.compile(f"[^{MARKS}]*?(?:[{MARKS}]+|(?<=[{_PHRASED}])\\s+(?=[{_PHRASED}])|$)")
_WORD = re.compile(r"\S+")
_HAS_HAN, _HAS_PHRASED, _UNSPACED = re.compile(f"[{_HAN}]"), re.compile(f"[{_PHRASED}]"), re.compile(f"[{_HAN}{_PHRASED}]")
#: What passages grow by: words, or characters of text without white space.
_STEP = re.compile(f"[{_HAN}{_PHRASED}]|[^\\s{_HAN}{_PHRASED}]+")


def n_words(words: list[str]) -> int:
    """Words by white space, or by characters where text is written without it."""
    text = "".join(words)
    spaced = sum(not _UNSPACED.search(w) for w in words)
    return max(len(words), spaced + len(_HAS_HAN.findall(text)) // 2 + len(_HAS_PHRASED.findall(text)) // 5)


def _parts(sentence: str) -> Iterator[tuple[int, str]]:
    """(begin, text) of the parts of a sentence."""
    if sentence.count(" ") < LONG or len(words := list(_WORD.finditer(sentence))) < LONG:
        yield 0, sentence
        return
    at, n = 0, 0
    for w in words:
        n += 1
        if n >= UNIT_WORDS and zlib.crc32(w[0].lower().rstrip(MARKS).encode("utf-8", "replace")) % CUT == 0:
            yield at, sentence[at : w.end()]
            at, n = w.end(), 0
    if n:
        yield at, sentence[at:]


def units(text: str | None) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(number, begin, end, words, digest) of the units of a text; offsets in characters."""
    number, at = 0, 0
    for line in (text or "").split("\n"):
        begin, words = 0, []
        sentence, count = _SENTENCE, len
        if not line.isascii():
            sentence = _PHRASE if _HAS_PHRASED.search(line) else _MARKED
            count = n_words if _UNSPACED.search(line) else len
        for start, part in ((m.start() + b, p) for m in sentence.finditer(line) for b, p in _parts(m[0])):
            more = part.split()
            if more and not words:
                begin = start + len(part) - len(part.lstrip())
            words += more
            n = count(words)
            if n >= UNIT_WORDS:
                yield number, at + begin, at + start + len(part.rstrip()), n, _digest(words)
                number, words = number + 1, []
        if words:
            yield number, at + begin, at + len(line.rstrip()), count(words), _digest(words)
            number += 1
        at += len(line) + 1


def _digest(words: list[str]) -> bytes:
    return xxhash.xxh3_128_digest(" ".join(words).lower().rstrip(MARKS + " ").encode("utf-8", "replace"))


def document_units(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, number, start, stop, n_words, digest, and before, after: where the unit before begins and the one after stops, -1 if there is none."""
    names = ("number", "start", "stop", "n_words", "digest", "before", "after")
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found = []
                for i, t in enumerate(part.column("text").to_pylist()):
                    us = list(units(t))
                    found += [(i, (*u, b, a)) for u, b, a in zip(us, [-1, *[x[1] for x in us]], [*[x[2] for x in us[1:]], -1], strict=False)]
                own = pa.array([i for i, _ in found], pa.int64())
                columns = [pa.array([u[k] for _, u in found], kind) for k, kind in enumerate(kinds)]
                ids = [part.column(c).take(own) for c in ("doc_id", "text_key")]
                yield pa.RecordBatch.from_arrays([*ids, *columns], names=["doc_id", "text_key", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text", F.octet_length("text")).alias("text_key"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, text_key long, number int, start int, stop int, n_words int, digest binary, before int, after int")


def grown(own: str, kept: str, left: bool) -> tuple[int, int, int, int]:
    """(characters of ``own``, words, characters of ``kept``, words of all ``own``) by which a passage grows into its surroundings on one side."""
    a, b = list(_STEP.finditer(own)), list(_STEP.finditer(kept))
    if left:
        a.reverse()
        b.reverse()
    n = 0
    for i, (x, y) in enumerate(zip(a, b, strict=False)):
        if x[0] != y[0] and x[0].lower().rstrip(MARKS) != y[0].lower().rstrip(MARKS):
            break
        if x[0].strip(MARKS):  # a mark alone is no step of its own
            n = i + 1
    count = n_words if _UNSPACED.search(own) else len
    every = count(own.split())
    if not n:
        return 0, 0, 0, every
    x, y = a[n - 1], b[n - 1]
    part = own[x.start() :] if left else own[: x.end()]
    return len(part), count(part.split()), len(kept) - y.start() if left else y.end(), every


def surroundings(docs: DataFrame, ends: DataFrame) -> DataFrame:
    """doc_id, text_key, number, side, around: the text from a to b, which is that after a unit (side 1) or before it (-1), empty if one is -1."""
    wanted = ends.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("number", "side", "a", "b")).alias("ends"))
    wanted = wanted.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                text = batch.column("text")[row].as_py()
                out = [(e["number"], e["side"], text[e["a"] : e["b"]] if min(e["a"], e["b"]) >= 0 else "") for e in batch.column("ends")[row].as_py()]
                own = pa.array([row] * len(out), pa.int64())
                columns = [pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(own) for c in ("doc_id", "text_key")), *columns], names=["doc_id", "text_key", "number", "side", "around"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.xxhash64("text", F.octet_length("text")).alias("text_key"), "text")
    rows = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k"))).select("doc_id", "text_key", "text", "ends")
    out = rows.mapInArrow(run, f"doc_id {kind}, text_key long, number int, side int, around string")
    return out.dropDuplicates(["doc_id", "text_key", "number", "side"])  # repeated rows


def _place(doc_id: str, text_key: str, number: str, side: int) -> str:
    return f"concat_ws('/', coalesce(cast({doc_id} as string), '?'), {text_key}, {number}, {side})"


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Spans to remove: doc_id, text_key, start, stop, n_words, and where the first unit of each is kept."""
    found = staged(document_units(docs))  # read twice below
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "start", "text_key", "number", "stop", "before", "after")
    first = found.groupBy("digest").agg(F.min(place).alias("kept"), F.max(place).alias("top"))
    first = first.where("kept != top")  # more than one occurrence, repeated rows aside
    first = staged(first.select("digest", *[F.col(f"kept.{c}").alias(f"kept_{c}") for c in ("doc_id", "start", "text_key", "number", "stop", "before", "after")]))
    rows = found.join(first, "digest")
    same = F.col("doc_id").eqNullSafe(F.col("kept_doc_id")) & (F.col("start") == F.col("kept_start")) & (F.col("text_key") == F.col("kept_text_key"))
    rows = rows.where(~same).dropDuplicates(["doc_id", "text_key", "number"])
    # Neighbouring repeats of a document: their numbers less their ranks are the same.
    rank = F.row_number().over(Window.partitionBy("doc_id", "text_key").orderBy("number"))
    runs = rows.withColumn("run", F.col("number") - rank).groupBy("doc_id", "text_key", "run")
    at = F.struct("number", "before", "after", *[f"kept_{c}" for c in ("doc_id", "start", "text_key", "number", "stop", "before", "after")])
    runs = runs.agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("n_words").alias("n_words"), F.min(at).alias("a"), F.max(at).alias("b"))
    kept = [f"{x}.kept_{c} as {x}_{c}" for x in ("a", "b") for c in ("doc_id", "text_key", "number")]
    around = ["a.before as l_from", "start as l_to", "stop as r_from", "b.after as r_to", "a.kept_before as lk_from", "a.kept_start as lk_to", "b.kept_stop as rk_from", "b.kept_after as rk_to"]
    runs = staged(runs.selectExpr("doc_id", "text_key", "start", "stop", "n_words", "a.number as first", "b.number as last", "a.kept_start", *kept, *around))
    runs = _grow(docs, runs)
    spans = runs.groupBy("doc_id", "text_key", "passage").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("n_words").alias("n_words"), F.min(F.struct("start", "a_doc_id", "kept_start")).alias("h"))
    spans = spans.where(F.col("n_words") >= min_words)
    return spans.select("doc_id", "text_key", "start", "stop", "n_words", F.col("h.a_doc_id").alias("kept_doc_id"), F.col("h.kept_start").alias("kept_start"))


def _grow(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """``runs`` grown on both sides, with the number of the passage that those which meet make."""
    sides = {"l": ("a", "first", -1), "r": ("b", "last", 1)}
    places = [(f"{s}_own", "doc_id", "text_key", n, side, s) for s, (_, n, side) in sides.items()]
    places += [(f"{s}_kept", f"{x}_doc_id", f"{x}_text_key", f"{x}_number", side, f"{s}k") for s, (x, _, side) in sides.items()]
    ends = None
    for _, d, k, n, side, s in places:
        some = runs.selectExpr(f"{d} as doc_id", f"{k} as text_key", f"{n} as number", f"{side} as side", f"{s}_from as a", f"{s}_to as b")
        ends = some if ends is None else ends.unionByName(some)
    ends = ends.groupBy("doc_id", "text_key", "number", "side", "a", "b").agg(F.count("*").alias("rows"))
    near = staged(surroundings(docs, ends).selectExpr(f"{_place('doc_id', 'text_key', 'number', 'side')} as place", "around"))
    ends = ends.selectExpr(f"{_place('doc_id', 'text_key', 'number', 'side')} as place", "rows")
    near = staged(near.join(ends, "place"))
    runs = runs.drop(*[f"{s}_{e}" for *_, s in places for e in ("from", "to")])
    # The surroundings of a unit that is kept may be asked for by very many passages.
    for name, d, k, n, side, _ in places:
        named = near.withColumnsRenamed({"place": f"{name}_at", "around": name})
        runs = join_hot(runs.withColumn(f"{name}_at", F.expr(_place(d, k, n, side))), named, f"{name}_at", "rows").drop(f"{name}_at")

    def by(left: bool):
        @F.pandas_udf("chars int, words int, kept int, every int")
        def run(own: pd.Series, kept: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([grown(x, y, left) for x, y in zip(own, kept, strict=True)], columns=["chars", "words", "kept", "every"])

        return run

    runs = runs.withColumn("l", by(True)("l_own", "l_kept")).withColumn("r", by(False)("r_own", "r_kept"))
    runs = staged(runs.drop("l_own", "l_kept", "r_own", "r_kept"))
    # Two passages with one unit between them may both grow into it: the later one takes what is left.
    w = Window.partitionBy("doc_id", "text_key").orderBy("start")
    before = F.lag(F.struct("last", "stop", F.col("r.chars").alias("chars"), F.col("r.words").alias("words"))).over(w)
    runs = runs.withColumn("before", before).withColumn("gap", F.when(F.col("before.last") == F.col("first") - 2, F.col("start") - F.col("before.stop")))
    meet = F.coalesce(F.col("before.chars") + F.col("l.chars") >= F.col("gap") - 1, F.lit(False)) & (F.col("before.chars") + F.col("l.chars") > 0)
    runs = runs.withColumn("meet", meet)
    passage = F.sum((~F.col("meet")).cast("int")).over(w)
    chars = F.when(F.col("meet"), F.col("gap") - F.col("before.chars")).otherwise(F.col("l.chars"))
    words = F.when(F.col("meet"), F.greatest(F.lit(0), F.least(F.col("l.words"), F.col("l.every") - F.col("before.words")))).otherwise(F.col("l.words"))
    return runs.select(
        "doc_id", "text_key", passage.alias("passage"), (F.col("start") - chars).alias("start"), (F.col("stop") + F.col("r.chars")).alias("stop"),
        (F.col("n_words") + words + F.col("r.words")).alias("n_words"), "a_doc_id", (F.col("kept_start") - F.col("l.kept")).alias("kept_start"))


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the repeated spans (and the character after each if it is white space) taken out of ``text``."""
    spans = repeated_spans(docs, min_words).groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("__spans"))
    spans = spans.select(F.col("doc_id").alias("__d"), F.col("text_key").alias("__k"), "__spans")
    key = F.xxhash64("text", F.octet_length("text"))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def one(text, gone):
            if text is None or gone is None:
                return text
            out, at = [], 0
            for s in gone:
                out.append(text[at : s["start"]])
                at = s["stop"] + text[s["stop"] : s["stop"] + 1].isspace()
            return "".join([*out, text[at:]])

        return pd.Series([one(t, s) for t, s in zip(texts, spans, strict=True)], dtype="object")

    rows = docs.join(spans, docs["doc_id"].eqNullSafe(F.col("__d")) & (key == F.col("__k")), "left")
    return rows.withColumn("text", cut("text", "__spans")).drop("__d", "__k", "__spans")


def repeats_digest(docs: DataFrame) -> DataFrame:
    """Per span removed: doc_id, start, stop, n_words, kept_doc_id, kept_start."""
    return repeated_spans(docs).select("doc_id", "start", "stop", "n_words", "kept_doc_id", "kept_start")
