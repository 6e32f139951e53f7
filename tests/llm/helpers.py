"""Small tables with the awkward rows that every operator has to take."""

from __future__ import annotations

import hashlib
import random
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{int(rng.paretovariate(0.7)) % vocabulary}" for _ in range(n))


def awkward() -> list[tuple]:
    """Nulls in every column, empty texts, repeated rows, a very long text."""
    rng = random.Random(5)
    long_text = words(rng, 30_000, 5_000)
    return [
        (1, None, "en", "a", None), (2, "", "en", None, 0), (3, " \t\n\r ", None, "a", 5), (4, "one two", "en", "b", 7),
        (4, "one two", "en", "b", 7), (5, "One TWO", None, "b", None), (None, "no id here at all, but some words", "en", "c", 3), (None, None, None, None, None),
        (6, long_text, "en", "a", len(long_text)), (7, long_text + " end", "en", "c", None), (8, "É ß 中文 ①", "de", "a", 6),
        (9, "### 12 $$$", "en", "b", 10), (9, "another text with the same id as the one before it", "en", "b", 10),
    ]


def with_clashes(docs):
    """The same rows with columns whose names operators might use inside."""
    from pyspark.sql import functions as F

    for name in ("size", "start", "block", "target", "key", "set_id", "n", "cut", "n_lines", "pos", "h", "w", "at", "line", "score", "_l", "_d", "_k", "text_key", "label"):
        docs = docs.withColumn(name, F.lit("x"))
    return docs


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def split5(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
