"""Pre-token boundaries of whole blocks of UTF-8 text, found with array operations.

The boundaries are those of the public pattern for byte-level BPE::

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

Runs of one character class are cut first; then a single space moves to the run
after it, white space keeps its last character apart, and contractions split.
"""

from __future__ import annotations

import functools
import sys

import numpy as np
import regex

LETTER, NUMBER, SPACE, OTHER = range(4)


@functools.cache
def classes() -> np.ndarray:
    """The class of each code point."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            out[a : b + 1] = kind
    return out


def byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of the character that each byte belongs to."""
    points = classes()
    low = np.full(256, OTHER, np.uint8)
    low[:128] = points[:128]
    kind = np.frombuffer(bytearray(data.tobytes().translate(low.tobytes())), np.uint8)
    lead = np.flatnonzero(data >= 0xC0)
    if lead.size:
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        b0, b1, b2, b3 = (padded[lead + k].astype(np.int32) for k in range(4))
        three, four = b0 >= 0xE0, b0 >= 0xF0
        cp = ((b0 & 0x1F) << 6) | (b1 & 0x3F)
        cp = np.where(three, ((b0 & 0x0F) << 12) | ((b1 & 0x3F) << 6) | (b2 & 0x3F), cp)
        cp = np.where(four, ((b0 & 0x07) << 18) | ((b1 & 0x3F) << 12) | ((b2 & 0x3F) << 6) | (b3 & 0x3F), cp)
        of = points[cp]
        for k, chosen in ((0, slice(None)), (1, slice(None)), (2, three), (3, four)):
            kind[lead[chosen] + k] = of[chosen]
    return kind


def starts(data: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Byte offsets at which pre-tokens begin. ``docs``: offsets of the texts, the end included."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind = byte_classes(data)
    fresh = np.empty(n, bool)
    fresh[0] = True
    np.not_equal(kind[1:], kind[:-1], out=fresh[1:])
    begins = np.zeros(n + 1, bool)
    begins[docs] = True
    begins = begins[:n]
    fresh |= begins
    run = np.flatnonzero(fresh)
    of, first = kind[run], begins[run]
    end = np.append(run[1:], n)
    after = np.zeros(len(run), bool)  # white space of the same text stands before
    after[1:] = (of[:-1] == SPACE) & ~first[1:]
    joined = after & (data[run - 1] == 0x20) & (of != SPACE)
    out = np.zeros(n, bool)
    out[run - joined] = True
    last = run[after & ~joined & (of != SPACE)] - 1
    for _ in range(3):
        last = np.where((data[last] & 0xC0) == 0x80, last - 1, last)
    out[last] = True
    mark = np.flatnonzero(of[:-1] == OTHER)
    mark = mark[(data[run[mark]] == 0x27) & (end[mark] - run[mark] == 1) & ~joined[mark]]
    mark = mark[(of[mark + 1] == LETTER) & ~first[mark + 1]]
    if mark.size:
        at, size = run[mark + 1], end[mark + 1] - run[mark + 1]
        one, two = data[at], np.where(size > 1, data[np.minimum(at + 1, n - 1)], 0)
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        cut = np.where(short, 1, np.where(long, 2, 0))
        hit = cut > 0
        out[at[hit]] = False
        rest = hit & (size > cut)
        out[at[rest] + cut[rest]] = True
    return np.flatnonzero(out)


def starts_by_steps(data: np.ndarray, docs: np.ndarray, step: int = 2 << 20) -> np.ndarray:
    """As ``starts``, some texts at a time, so that its arrays stay small beside the block."""
    parts, a = [], 0
    while a < len(docs) - 1:
        b = max(a + 1, int(np.searchsorted(docs, docs[a] + step, "right")) - 1)
        parts.append(starts(data[docs[a] : docs[b]], docs[a : b + 1] - docs[a]) + docs[a])
        a = b
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)
