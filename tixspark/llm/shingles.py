"""Word shingles of texts as sorted arrays of 64-bit hashes, for use in tasks (numpy over many texts at once)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

WIDTH = 5
#: Bytes of text hashed at once; bounds the working memory whatever the lengths of texts.
PIECE = 1 << 18
_P = 0x9E3779B97F4A7C15 | 1
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2^64, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> None:
        if len(self.up) < n:
            for name, base in (("up", _P), ("down", pow(_P, -1, 1 << 64))):
                a = np.full(n, base, np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))


def _word_hashes(buf: bytes, powers: _Powers) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of ``buf``."""
    raw = np.frombuffer(buf, np.uint8)
    space = np.concatenate(([True], _SPACE[raw], [True]))
    edge = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edge[0::2], edge[1::2]
    powers.to(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers.up[: len(raw)], out=total[1:])
    return starts, mix((total[ends] - total[starts]) * powers.down[starts])


def _cut(data: bytes) -> Iterator[bytes]:
    """``data`` in parts of about PIECE bytes that end at white space (a longer word stays whole)."""
    at = 0
    while at < len(data):
        end = at + PIECE
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        yield data[at:end]
        at = end


def _shingles(words: np.ndarray, counts: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text, given all texts' word hashes in a row and their counts."""
    n = len(words)
    full = np.zeros(max(0, n - width + 1), np.uint64)
    for j in range(width if len(full) else 0):
        full = full * np.uint64(_P) + words[j : n - width + 1 + j]
    full = mix(full)
    at = 0
    for c in counts.tolist():
        if c >= width:
            s = np.sort(full[at : at + c - width + 1])
            if len(s) > 1 and not (new := s[1:] != s[:-1]).all():
                s = s[np.concatenate(([True], new))]
        elif c:
            h = np.uint64(c)
            for w in words[at : at + c]:
                h = h * np.uint64(_P) + w
            s = mix(np.array([h ^ np.uint64(0x5851F42D4C957F2D)], np.uint64))
        else:
            s = np.zeros(0, np.uint64)
        yield s
        at += c


def shingle_sets(texts: Sequence[str | None], width: int = WIDTH) -> Iterator[np.ndarray]:
    """The set of each text. A-Z lower-cased; fewer than ``width`` words: the sequence as one; none: empty."""
    powers, group, size = _Powers(), [], 0

    def flush() -> Iterator[np.ndarray]:
        nonlocal group, size
        if group:
            begin = np.cumsum([0, *[len(g) + 1 for g in group]])
            starts, hashes = _word_hashes(b"\n".join(group), powers)
            yield from _shingles(hashes, np.diff(np.searchsorted(starts, begin)), width)
        group, size = [], 0

    with np.errstate(over="ignore"):
        for text in texts:
            data = (text or "").encode("utf-8", "replace").translate(_LOWER)
            if len(data) > PIECE:
                yield from flush()
                words = np.concatenate([_word_hashes(p, powers)[1] for p in _cut(data)])
                yield from _shingles(words, np.array([len(words)]), width)
                continue
            if size + len(data) > PIECE:
                yield from flush()
            group.append(data)
            size += len(data) + 1
        yield from flush()


def set_id(s: np.ndarray) -> int:
    """A 64-bit digest of a set, the same for equal sets."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])
