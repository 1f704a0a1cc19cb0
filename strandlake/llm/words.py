"""Words of texts as 64-bit numbers, computed for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import regex

#: Characters that are handled at once; longer texts are cut between words.
BLOCK = 1_000_000

_BASE = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@cache
def word_characters() -> np.ndarray:
    """For each code point whether it is a letter or a digit."""
    table = np.zeros(0x110000, bool)
    for low, high in ((0, 0xD800), (0xE000, 0x110000)):
        for m in regex.finditer(r"[\p{L}\p{N}]+", "".join(map(chr, range(low, high)))):
            table[low + m.start() : low + m.end()] = True
    return table


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    both = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(n, b, np.uint64)
        steps[0] = 1
        both.append(np.cumprod(steps, dtype=np.uint64))
    return both[0], both[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def _hashed(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of a stretch of characters, and where they start."""
    inside = word_characters()[codes]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    size = BLOCK
    while size < len(codes) + 1:
        size *= 2
    power, inverse = _powers(size)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _M2 * power[: len(codes)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), starts


def _stretches(text: str) -> Iterator[str]:
    """A text in stretches of about BLOCK characters, none of which ends within a word."""
    low = 0
    while len(text) - low > BLOCK:
        high = low + BLOCK
        while high < len(text) and (text[high].isalnum() or text[high - 1].isalnum()):
            high += 1
        yield text[low:high]
        low = high
    yield text[low:]


def word_hashes(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (word hash, number of its text) over lower-cased texts, in order; no text is torn apart
    between two blocks."""
    held: list[str] = []
    of: list[int] = []
    size = 0

    def block() -> tuple[np.ndarray, np.ndarray]:
        hashes, owners = [], []
        group: list[str] = []
        group_of: list[int] = []
        n = 0

        def flush() -> None:
            codes = np.frombuffer("\n".join(group).encode("utf-32-le", "surrogatepass"), np.uint32)
            h, starts = _hashed(codes)
            firsts = np.cumsum([0, *(len(t) + 1 for t in group)])
            hashes.append(h)
            owners.append(np.asarray(group_of)[np.searchsorted(firsts, starts, "right") - 1] if len(h) else np.zeros(0, int))

        for i, text in zip(of, held, strict=True):
            for part in _stretches(text):
                if n + len(part) > BLOCK and group:
                    flush()
                    group, group_of, n = [], [], 0
                group.append(part)
                group_of.append(i)
                n += len(part)
        if group:
            flush()
        return np.concatenate(hashes), np.concatenate(owners)

    with np.errstate(over="ignore"):
        for i, text in enumerate(texts):
            if not text:
                continue
            text = text.lower()
            if held and size + len(text) > BLOCK:
                yield block()
                held, of, size = [], [], 0
            held.append(text)
            of.append(i)
            size += len(text)
        if held:
            yield block()


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of `n` words."""
    with np.errstate(over="ignore"):
        h = np.zeros(max(0, len(words) - n + 1), np.uint64)
        for k in range(n if len(h) else 0):
            h = h * np.uint64(_BASE) + words[k : k + len(h)]
        return mix(h)
