"""Token counts of whole texts, huge ones by overlap resynchronisation.

A text of up to ``CHUNK`` characters is counted at once. A longer one is encoded in stretches with
offsets, each of which begins ``OVERLAP`` characters before the end of the one before. The two are spliced at
a place in the overlap where both begin a pre-token (the unit that the tokenizer encodes without regard to
others). There they agree for good: the splitter goes from left to right, so from a place where it begins
anew on nothing before it matters, provided that the normaliser does not join the characters on both
sides, which is checked; the next ``RUN`` tokens (places and ids) are compared as well. The tokens of
the left stretch before the place and those of the right one after it are the text's. Where there is no such place
the overlap is doubled; where that reaches the begin of the left stretch, the stretch is made twice as long and encoded again,
so the count is always that of the text encoded at once, and the work grows with the text's length.

In texts of up to CHUNK, a tokenizer that drops white space encodes what stands between two spaces without regard to
the rest. For such a one (checked on probes when it is loaded) the library encodes each distinct
piece of up to ``PIECE`` characters once for a task and its tokens are looked up after that; a task keeps
``MEMO_BYTES`` of such pieces before it begins anew.

Defined results: null and empty texts have no tokens; repeated rows are counted each; a text
without white space is spliced like any other; an empty table gives an empty result; columns besides
doc_id and text are not looked at.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK, OVERLAP, RUN, LIMIT = 1 << 15, 1 << 10, 8, 2048
#: Longest piece that is remembered, bytes of remembered pieces, bytes of one besides its characters.
PIECE, MEMO_BYTES, ENTRY = 128, 192 << 20, 160
_PIECE = re.compile(r"[^ \n]+")
#: Letters with a stop or comma that lower-case tokenizers take as the letters, lower-cased, and the stop.
_PLAIN = re.compile(r"([A-Za-z]+)([.,]?)", re.ASCII)
_LOWER_PROBES = ("Hello.", "WORLD,", "aB.", "Z,", "DONT.")
#: Texts for which the tokens of the whole must be the tokens of the parts.
_PROBES = ("a b", " a", "a\n\nb ", "Don't stop, 12 ab12", "x 's é ß́ ́", "<|a b|> ... ## 中文 z")


class Encoder:
    """Tokens (id, begin, end) of a text by the library's tokenizer of a vocabulary file."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, int] = {}
        self.cores: dict[str, int] = {}
        self.held = 0
        self.by_piece = all(self._ids(p) == [i for m in _PIECE.findall(p) for i in self._ids(m)] for p in _PROBES)
        self.lower_case = self.by_piece and all(self._ids(p) == self._ids(p[:-1].lower()) + self._ids(p[-1]) for p in _LOWER_PROBES)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def count(self, text: str) -> int:
        if not self.by_piece:
            return len(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0])
        pieces = _PIECE.findall(text)
        known = self.known
        fresh = {p for p in pieces if p not in known}
        long = [p for p in fresh if len(p) > PIECE]
        if self.held > MEMO_BYTES:
            known.clear()
            self.cores.clear()
            self.held, fresh = 0, set(pieces)
        self._learn([p for p in fresh if len(p) <= PIECE])
        if not long:
            return sum(map(known.__getitem__, pieces))
        once = dict(zip(long, map(len, self.tokenizer.encode_batch_fast(long, add_special_tokens=False)), strict=True))
        return sum(known[p] if p in known else once[p] for p in pieces)

    def _learn(self, fresh: list[str]) -> None:
        """Count the tokens of pieces. Those alike but for A-Z and a full stop or comma at the end are encoded once."""
        if not fresh:
            return
        cores = self.cores
        parts = [self._parts(p) for p in fresh]
        new = list({c for both in parts for c in both if c and c not in cores})
        cores.update(zip(new, map(len, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)), strict=True))
        self.known.update((p, cores[a] + (cores[b] if b else 0)) for p, (a, b) in zip(fresh, parts, strict=True))
        self.held += sum(len(p) + ENTRY for p in fresh) + sum(len(p) + ENTRY for p in new)

    def _parts(self, piece: str) -> tuple[str, str]:
        if self.lower_case and (m := _PLAIN.fullmatch(piece)):
            return m[1].lower(), m[2]
        return piece, ""

    def tokens(self, text: str, at: int) -> list[Token]:
        """(begin, end, id, whether it begins a pre-token) of the tokens, ``at`` added to the places."""
        e = self.tokenizer.encode(text, add_special_tokens=False)
        words = e.word_ids
        heads = [i == 0 or words[i] is None or words[i] != words[i - 1] for i in range(len(words))]
        return [(a + at, b + at, i, h) for (a, b), i, h in zip(e.offsets, e.ids, heads, strict=True)]


Token = tuple[int, int, int, bool]


def apart(before: str, after: str) -> bool:
    """Whether normalisation leaves two neighbouring characters to themselves."""
    normal = unicodedata.normalize
    return before.isascii() and after.isascii() or not unicodedata.combining(after) and all(
        normal(f, before + after) == normal(f, before) + normal(f, after) for f in ("NFC", "NFKC"))


def splice(left: list[Token], right: list[Token], text: str, run: int = RUN) -> tuple[int, int] | None:
    """(i, j): ``right`` may take over from ``left`` at right[j], which is left[i]; None if there is no such place."""
    place = {t: i for i, t in enumerate(left) if t[3]}
    for j, t in enumerate(right):
        i = place.get(t) if t[3] and j else None  # the first token begins where the stretch was cut
        if i and i + run <= len(left) and left[i : i + run] == right[j : j + run] and apart(text[t[0] - 1], text[t[0]]):
            return i, j
    return None


def spliced_count(text: str, encoder: Encoder, chunk: int = CHUNK, overlap: int = OVERLAP, run: int = RUN) -> int:
    """The number of tokens of a text, encoded a stretch at a time."""
    begin, end, total = 0, chunk, 0
    left = encoder.tokens(text[:end], 0)
    while end < len(text):
        wide, found = overlap, None
        while found is None and end - wide > begin:
            right = encoder.tokens(text[end - wide : end + chunk], end - wide)
            found = splice(left, right, text, run)
            wide *= 2
        if found is None:
            # No place to go on from: the stretch itself becomes twice as long.
            end += max(chunk, end - begin)
            left = encoder.tokens(text[begin:end], begin)
            continue
        i, j = found
        total += i
        left, begin, end = right[j:], right[j][0], end + chunk
    return total + len(left)


def count_tokens(text: str | None, encoder: Encoder, chunk: int = CHUNK, overlap: int = OVERLAP, run: int = RUN) -> int:
    if not text:
        return 0
    return encoder.count(text) if len(text) <= chunk else spliced_count(text, encoder, chunk, overlap, run)


def token_counts(texts: Column, path: str) -> Column:
    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(path)
        for batch in batches:
            yield pd.Series([count_tokens(t, encoder) for t in batch], dtype="int64")

    return run(texts)


def token_digest(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit."""
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    out = docs.select("doc_id", n_bytes.alias("n_bytes"), token_counts(F.col("text"), path).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
