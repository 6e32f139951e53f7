"""Language, lines, repeated units and token counts."""

import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from .helpers import DOCS, awkward, with_clashes

from tixspark.llm import langmix, linespread, tokencount, unitdedup
from tixspark.llm.common import table

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    docs = table(spark, SF, "documents")
    model = langmix.fit(docs.where("pmod(crc32(cast(cast(doc_id as string) as binary)), 4) != 2"))
    rows = langmix.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    en, fr = (next(d.text for d in docs.where(f"lang = '{x}' and length(text) between 1500 and 4000").orderBy("doc_id").collect()) for x in ("en", "fr"))
    lang, share, langs, shares = langmix.predict(en + " " + fr[: len(en) // 2], model, langmix.letter_table())
    assert lang == "en" and set(langs) == {"en", "fr"} and 0.5 < share < 0.8 and abs(sum(shares) - 1) < 1e-9


def test_language_awkward_rows(spark):
    docs = with_clashes(spark.createDataFrame(awkward(), DOCS))
    model = langmix.fit(docs)
    got = {(r.doc_id, r.lang_pred) for r in langmix.identify(docs, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (9, "und"), (None, "und")} <= got
    assert len(langmix.reject_unknown(docs, model).collect()) == 8
    empty = langmix.fit(docs.limit(0))
    assert {r.lang_pred for r in langmix.identify(docs, empty).collect()} == {"und"}
    assert langmix.identify(docs.limit(0), model).collect() == []


def test_only_letters_make_a_language(spark):
    docs = spark.createDataFrame([(1, "words of the one language", "en", "s", 0), (2, "des mots de l'autre langue", "fr", "s", 0)], DOCS)
    model, letters = langmix.fit(docs), langmix.letter_table()
    for text in ("😀😀", "𝟏𝟐", "\U0001f000", "123 456", "\U000e0041", "＋１"):
        assert langmix.predict(text, model, letters)[:2] == ("und", 0.0)
    for text in ("𐐀", "𠀀", "é", "words 😀"):
        assert langmix.predict(text, model, letters)[0] in ("en", "fr")


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(langmix, "LANGUAGES", 1)
    docs = spark.createDataFrame([(1, "a", "en", "s", 0), (2, "b", "fr", "s", 0)], DOCS)
    with pytest.raises(ValueError):
        langmix.fit(docs)
    assert langmix.fit(docs.where("lang = 'en'")).languages == ["en"]


def test_languages_against_every_set(spark):
    """The set of languages chosen along the proportions is the best of all sets by the penalised likelihood."""
    docs = table(spark, SF, "documents")
    model, letters = langmix.fit(docs), langmix.letter_table()
    texts = [r.text for r in docs.where("length(text) between 300 and 3000").orderBy("doc_id").limit(40).collect()]
    texts += [a[:900] + " " + b[:600] for a, b in zip(texts[:10], texts[20:30], strict=True)]

    def best_set(text):
        b = langmix._buckets(langmix._codes(text, letters))
        cuts = np.arange(0, len(b), langmix.RUN)
        score, size = np.add.reduceat(model.weights[b], cuts, axis=0).astype(float), np.diff(np.append(cuts, len(b))).astype(float)
        like = np.exp(np.maximum(score - score.max(1, keepdims=True), -60))
        cost, found = langmix.PENALTY * np.log(len(like) + 1), []
        for k in range(1, like.shape[1] + 1):
            for some in itertools.combinations(range(like.shape[1]), k):
                fit = langmix._mixture(like[:, some], size, langmix.ROUNDS)[1] if k > 1 else float(np.log(like[:, some[0]]).sum())
                found.append((fit - cost * k, some))
        return {model.languages[i] for i in max(found)[1]}

    assert all(set(langmix.predict(t, model, letters)[2]) == best_set(t) for t in texts)


def test_document_in_many_languages(spark):
    rng = random.Random(4)

    def text(i, n=400):  # a language of six letters of its own
        return " ".join("".join(chr(0x430 + 6 * i + rng.randrange(6)) for _ in range(5)) for _ in range(n))

    names = [f"l{i}" for i in range(7)]
    docs = spark.createDataFrame([(i, text(i, 3000), x, "s", 0) for i, x in enumerate(names)], DOCS)
    lang, share, langs, shares = langmix.predict(" ".join(text(i, 800 if i == 2 else 400) for i in range(6)), langmix.fit(docs), langmix.letter_table())
    assert lang == "l2" and set(langs) == set(names[:6]) and abs(share - 2 / 7) < 0.02
    assert all(abs(s - (2 if x == "l2" else 1) / 7) < 0.02 for x, s in zip(langs, shares, strict=True))


def test_line_spread(spark):
    rows = [(i, f"unique start {i}\n  Shared   line here\nmore {i}\n{'near' if i < 5 else 'far'} line\nend {i}", "en", f"s{i % 8}", 0) for i in range(40)]
    rows += [(100 + i, "whole copy of a text\nin two lines", "en", f"s{i % 8}", 0) for i in range(9)]
    rows += awkward()
    docs = spark.createDataFrame(rows, DOCS)
    out = {(r.doc_id, r.text): r for r in linespread.drop_boilerplate(with_clashes(docs)).collect()}
    assert (7, f"unique start 7\nmore 7\nend 7") in out and (3, "unique start 3\nmore 3\nnear line\nend 3") in out
    assert (104, "whole copy of a text\nin two lines") in out
    assert len(out) == len({(r[0], r[1]) for r in rows})
    assert linespread.drop_boilerplate(docs, min_sites=9).where("doc_id < 40 and text like '%Shared%' and text not like 'w%'").count() == 40
    assert linespread.spread_digest(docs.limit(0)).collect() == []


def test_line_spread_of_short_pages(spark):
    header, footer = "The header that every page has", "A footer \t that every page has as well"
    rows = [(i, f"{header}\nonly {i}\n \n{footer}", "en", f"s{i % 8}", 0) for i in range(20)]
    rows += [(100 + i, f"{header}\n\n{footer}\n", "en", f"s{i % 8}", 0) for i in range(2)]  # nothing else
    rows += [(200 + i, f"{header}\nthe same\n{footer}", "en", f"s{i % 8}", 0) for i in range(2)]  # copies
    rows += [(300, f"{header}\ntwice\n{footer}", "en", "s1", 0)] * 2  # one document
    docs = spark.createDataFrame(rows, DOCS)
    out = sorted((r.doc_id, r.text) for r in linespread.drop_boilerplate(with_clashes(docs)).collect())
    want = [(i, f"only {i}\n ") for i in range(20)] + [(r[0], r[1]) for r in rows[20:24]] + [(300, "twice")] * 2
    assert out == want


def brute_spans(rows, min_words=20):
    """Split into units, find the first of each, join neighbouring repeats, grow them word by word into the units beside, join those that meet."""
    docs = {(d is None, d, t): list(unitdedup.units(t)) for d, t in rows}
    first = {}
    for key in docs:
        for u in docs[key]:
            place = (key[0], key[1] or 0, u[1])
            if u[4] not in first or place < first[u[4]][0]:
                first[u[4]] = place, key, u[0]
    out = set()

    def words(text, a, b):
        return [(m[0].lower().rstrip(unitdedup.MARKS), a + m.start(), a + m.end()) for m in re.finditer(r"\S+", text[a:b])]

    for key, us in docs.items():
        text = key[2]
        repeat = [first[u[4]][1:] != (key, u[0]) and first[u[4]][0] != (key[0], key[1] or 0, u[1]) for u in us]
        taken = set()  # places and words of what goes
        for i, u in enumerate(us):
            if not repeat[i]:
                continue
            taken.add((u[1], u[2], u[3]))
            _, (_, _, other), n = first[u[4]]
            there = docs[first[u[4]][1]]
            for side in (-1, 1):
                if not (0 <= i + side < len(us)) or repeat[i + side] or not (0 <= n + side < len(there)):
                    continue
                a, b = us[i + side], there[n + side]
                mine, kept = words(text, a[1], a[2])[::side], words(other, b[1], b[2])[::side]
                for x, y in zip(mine, kept, strict=False):
                    if x[0] != y[0]:
                        break
                    taken.add((*x[1:], 1))
        group = []
        for w in [*sorted(taken), None]:
            if group and (w is None or text[group[-1][1] : w[0]].strip()):
                if sum(g[2] for g in group) >= min_words:
                    out.add((key[1], group[0][0], group[-1][1], sum(g[2] for g in group)))
                group = []
            if w:
                group.append(w)
    return out


def test_repeated_units(spark):
    rng = random.Random(2)

    def passage(n):
        w = [f"u{rng.randrange(99)}" for _ in range(n)]
        for i in range(7, n, 9):
            w[i] += rng.choice(".!?")
        return " ".join(w)

    long, line, short = passage(60), "\n".join(passage(30) for _ in range(2)), passage(19)
    rows = [
        (5, f"intro\n{long}\n{short}", None, None, None), (3, f"Words before {long.upper()} and words after.\n\nkeep é {line}", None, None, None),
        (9, f"{line}\n{short}\nnew words that stand here alone\nthis is. {long} tail", None, None, None), (8, f"{short} x", None, None, None),
        (9, f"{line}\n{short}\nnew words that stand here alone\nthis is. {long} tail", None, None, None), *awkward(),
    ]
    docs = with_clashes(spark.createDataFrame(rows, DOCS))
    got = {(r.doc_id, r.start, r.stop, r.n_words) for r in unitdedup.repeated_spans(docs).collect()}
    assert got == brute_spans({(r[0], r[1]) for r in rows}) and {g[0] for g in got} == {5, 7, 9}  # 7 is 6 and a word
    text = {r[0]: r[1] for r in rows[:3]}
    assert any(long[60:140] in text[5][a:b] for d, a, b, _ in got if d == 5)
    left = {r.doc_id: r.text for r in unitdedup.without_repeats(docs).collect() if r.doc_id in (3, 5) and (r.text or "").count("u") > 5 or "here alone" in (r.text or "")}
    assert left[3] == text[3] and short in left[5] and long[60:140] not in left[5] and long[60:140] not in left[9] and "stand here alone" in left[9]
    assert len(unitdedup.without_repeats(docs).collect()) == len(rows) and unitdedup.repeats_digest(docs.limit(0)).collect() == []


def test_passages_to_their_real_ends(spark):
    """Passages that begin and end inside sentences, that no mark cuts, that meet, and that a letter follows."""
    w = [f"w{i}" for i in range(200)]
    middle = " ".join(w[:15]) + ". " + " ".join(w[15:32]) + ". " + " ".join(w[32:47])  # 47 words
    plain = " ".join(w[60:115])
    close = " ".join(w[120:139]) + ". " + " ".join(w[140:150]) + "."
    rows = [
        (1, f"Before one it said {middle} and so it went on.", "en", "s", 0), (2, f"Another text that has {middle} in it too.", "en", "s", 0),
        (3, f"first {plain} end", "en", "s", 0), (4, f"second text {plain} other words", "en", "s", 0),
        (5, close, "en", "s", 0), (6, f"x {close}Xavier says no", "en", "s", 0),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    text = {r[0]: r[1] for r in rows}
    got = {r.doc_id: (text[r.doc_id][r.start : r.stop], r.n_words, r.kept_doc_id, text[r.kept_doc_id][r.kept_start :][:10]) for r in unitdedup.repeats_digest(docs).collect()}
    assert got == {2: (middle, 47, 1, middle[:10]), 4: (plain, 55, 3, plain[:10]), 6: (close, 29, 5, close[:10])}
    left = {r.doc_id: r.text for r in unitdedup.without_repeats(docs).collect()}
    assert left[6] == "x Xavier says no" and left[2] == "Another text that has in it too." and left[1] == text[1]


def test_repeated_units_without_spaces(spark):
    rng = random.Random(7)

    def letters(first, n):
        return "".join(chr(first + rng.randrange(40)) for _ in range(n))

    han = "".join(letters(0x4E00, 30) + mark for mark in "。！？")
    thai = " ".join(letters(0x0E01, 60) for _ in range(4))
    hindi = " ".join(" ".join(letters(0x0905, 4) for _ in range(12)) + "।" for _ in range(3))
    rows = [(10 * i + j, f"{' '.join(letters(a, 30) for _ in range(n))}{end}{p}{letters(a, 30)}", None, None, None)
            for i, (p, a, end, n) in enumerate([(han, 0x4E00, "。", 1), (thai + " ", 0x0E01, " ", 1), (hindi + " ", 0x0905, "। ", 5)]) for j in range(2)]
    rows += [(90 + i, f"{letters(0x4E00, 30)}。短{han[:8]}。{letters(0x4E00, 30)}", None, None, None) for i in range(2)]  # too short
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: (r.start, r.stop) for r in unitdedup.repeated_spans(docs).collect()}
    assert got == {d: (t.index(p), t.index(p) + len(p)) for (d, t, *_), p in zip(rows[1:6:2], (han, thai, hindi), strict=True)}


def test_repeated_units_of_documents(spark):
    docs = table(spark, SF, "documents")
    rows = {(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}
    got = {(r.doc_id, r.start, r.stop, r.n_words) for r in unitdedup.repeats_digest(docs).collect()}
    assert got == brute_spans(rows) and len(got) > 50


def test_tokens_as_the_library_counts(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = tokencount.Encoder(path)
    whole = lambda t: len(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids)
    rng = random.Random(1)
    parts = ["ab", "A", " ", "\n", "<|endoftext|>", "é", "é", "　", "12", "'s", "'", "...", "<|end", "中", "́", "\x0b", "ΣΑΣ", "b.", "OK,"]
    for _ in range(200):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 400)))
        assert tokencount.count_tokens(t, encoder, chunk=50, overlap=8) == whole(t) == tokencount.count_tokens(t, encoder)
    assert tokencount.count_tokens("x" * 5000, encoder, chunk=64, overlap=8) == whole("x" * 5000)  # no stable boundary at all
    long_text = awkward()[8][1]
    assert tokencount.spliced_count(long_text, encoder, 5000, 64) == whole(long_text)
    docs = with_clashes(spark.createDataFrame(awkward(), DOCS))
    want = sorted(((r[0], len((r[1] or "").encode()), whole(r[1])) for r in awkward()), key=repr)
    got = tokencount.token_digest(docs, path).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=repr) == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got) and tokencount.token_digest(docs.limit(0), path).collect() == []
    other = tokencount.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not other.by_piece
    assert tokencount.count_tokens(long_text, other, chunk=3000) == len(other.tokenizer.encode(long_text, add_special_tokens=False).ids)


def test_texts_without_white_space_take_time_in_proportion():
    encoder = tokencount.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    read = []
    tokens = encoder.tokens
    encoder.tokens = lambda text, at: read.append(len(text)) or tokens(text, at)
    rng = random.Random(5)
    base64 = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=1 << 20))
    assert tokencount.count_tokens(base64, encoder) == len(tokens(base64, 0))
    assert sum(read) < 1.3 * len(base64)
    read.clear()
    letters = "".join(rng.choices("abcdefgh", k=200_000))  # one pre-token: stretches double
    assert tokencount.count_tokens(letters + "1 2 3", encoder) == len(tokens(letters + "1 2 3", 0))
    assert sum(read) < 16 * len(letters)
    signs = "".join(rng.choices("<'s1.é́", k=100_000))
    assert tokencount.count_tokens(signs, encoder) == len(tokens(signs, 0))


def test_remembered_pieces_are_bounded(monkeypatch):
    encoder = tokencount.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    monkeypatch.setattr(tokencount, "MEMO_BYTES", 100_000)
    rng = random.Random(3)
    for n in range(300):
        text = " ".join("".join(rng.choices("abcdefgh", k=rng.choice([5, 90, 400]))) for _ in range(40))
        assert encoder.count(text) == len(encoder.tokenizer.encode(text, add_special_tokens=False).ids)
        assert sum(len(p) + tokencount.ENTRY for p in [*encoder.known, *encoder.cores]) < 130_000
        assert all(len(p) <= tokencount.PIECE for p in encoder.known)
