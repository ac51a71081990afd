"""Vectorised word splitting and hashing of many texts at once.

A block of UTF-8 texts is one byte buffer; word boundaries and 64-bit word
hashes are found with array operations, so no Python object is made per word.
Memory is about 40 bytes per text byte of one block (``BLOCK`` bytes, or one
text if that is longer; a text is cut only between words).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 20
MIX1, MIX2, GOLD = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads every input bit over the whole word."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * GOLD)
_POWER_BASE = np.uint64(0xD1342543DE82EF95)
_powers = np.ones(64, dtype=np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        _powers = np.cumprod(np.full(size, _POWER_BASE, dtype=np.uint64))
    return _powers


_power_table(65)


def byte_class(separators: bytes | None = None, letters_digits: bool = False) -> np.ndarray:
    """256 flags: which bytes belong to words.

    ``separators``: every other byte is a word byte.  ``letters_digits``:
    ASCII letters and digits and every byte of a non-ASCII character.
    """
    flags = np.zeros(256, dtype=bool)
    if letters_digits:
        flags[0x30:0x3A] = flags[0x41:0x5B] = flags[0x61:0x7B] = True
        flags[0x80:] = True
    else:
        flags[:] = True
        flags[list(separators or b"")] = False
    return flags


WHITE = b" \t\n\x0b\x0c\r"
BY_SPACE = byte_class(separators=WHITE)
BY_LETTER = byte_class(letters_digits=True)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def hashed(buf: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, start bytes, end bytes) of one lower-cased buffer."""
    flags = is_word[buf]
    at = np.flatnonzero(flags)
    if not len(at):
        none = np.empty(0, dtype=np.int64)
        return np.empty(0, dtype=np.uint64), none, none
    edge = np.flatnonzero(np.diff(at) > 1) + 1
    first = np.concatenate(([0], edge))
    last = np.concatenate((edge, [len(at)]))
    sizes = last - first
    place = np.arange(len(at)) - np.repeat(first, sizes)
    powers = _power_table(int(sizes.max()) + 1)
    h = np.add.reduceat(_BYTE[_LOWER[buf[at]]] * powers[place], first)
    return mix(h ^ (sizes.astype(np.uint64) * GOLD)), at[first], at[last - 1] + 1


def blocks(texts: list[str | None], is_word: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]]:
    """(text index of each word, hashes, starts, ends, buffer) block by block.

    Texts are joined by a newline, which is in no word class used here; a
    block ends between texts, so the words of a text are never divided.
    """
    part: list[bytes] = []
    ids: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "replace")
        part.append(b)
        ids.append(i)
        size += len(b) + 1
        if size >= BLOCK:
            yield _block(part, ids, is_word)
            part, ids, size = [], [], 0
    if part:
        yield _block(part, ids, is_word)


def _block(part, ids, is_word):
    raw = b"\n".join(part)
    buf = np.frombuffer(raw, dtype=np.uint8)
    h, start, end = hashed(buf, is_word)
    edges = np.cumsum([len(b) + 1 for b in part])
    owner = np.asarray(ids, dtype=np.int64)[np.searchsorted(edges, start, side="right")]
    return owner, h, start, end, raw


def grams(h: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``n`` consecutive words of one text and their first places."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    g = np.zeros(m, dtype=np.uint64)
    for k in range(n):
        g = mix(g * GOLD + h[k:k + m])
    at = np.flatnonzero(owner[:m] == owner[n - 1:])
    return g[at], at
