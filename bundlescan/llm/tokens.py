"""Word hashes of many texts at once: bytes are mapped, split and hashed with numpy.

A word's hash is a polynomial over a fixed 64-bit value for each byte, modulo 2^64, read off one
running sum, so no Python object is made for a word. ASCII letters and separators are single bytes
in UTF-8, so lower-casing A-Z and splitting at ASCII separators need no decoding.
"""

from __future__ import annotations

import numpy as np

_M = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_MI = pow(_M, -1, 1 << 64)
_PIECE = 1 << 18

#: Words are runs of anything but ASCII white space.
SPACED = bytes(32 if i in (9, 10, 11, 12, 13, 32) else i + 32 if 65 <= i <= 90 else i for i in range(256))
#: Words are runs of ASCII letters, digits and anything beyond ASCII.
ALNUM = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of MurmurHash3 for 64 bits."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_M))
_powers: tuple[np.ndarray, np.ndarray] | None = None


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_M and its inverse to the powers 0 to n."""
    global _powers
    if _powers is None or len(_powers[0]) <= n:
        size = max(n, _PIECE) + 1
        both = []
        for base in (_M, _MI):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        if n > 4 * _PIECE:  # a huge word: not worth keeping
            return both[0], both[1]
        _powers = (both[0], both[1])
    return _powers


class Words:
    """The words of a list of texts (None: no words).

    data: the mapped bytes of all texts, one space after each; start, end: of each word in data;
    code: its hash; first: of each text, the number of its first word (and one more entry).
    at: of each text, its first byte in data.
    """

    def __init__(self, texts: list[str | None], table: bytes):
        raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
        sizes = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
        self.data = b" ".join([*raw, b""]).translate(table)
        self.at = np.concatenate([[0], np.cumsum(sizes)])
        bytes_ = np.frombuffer(self.data, np.uint8)
        edge = np.flatnonzero(np.diff(np.concatenate([[True], bytes_ == 32, [True]]).view(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        self.code = _codes(bytes_, self.start, self.end)
        self.first = np.searchsorted(self.start, self.at)

    def text_of(self) -> np.ndarray:
        """Of each word, the number of its text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words, over pieces of about _PIECE bytes that end with a word."""
    out = np.empty(len(start), np.uint64)
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + _PIECE, "right")))
        a, b = int(start[lo]), int(end[hi - 1])
        up, down = powers(b - a)
        run = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_BYTE[data[a:b]] * up[:b - a], out=run[1:])
        s, e = start[lo:hi] - a, end[lo:hi] - a
        out[lo:hi] = mix((run[e] - run[s]) * down[s])
        lo = hi
    return out


def grams(code: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n successive codes; empty if there are fewer."""
    if len(code) < n:
        return np.empty(0, np.uint64)
    last = len(code) - n + 1
    h = np.full(last, n, np.uint64)
    for j in range(n):
        h *= np.uint64(_M)
        h += code[j:j + last]
    return mix(h)


def groups(texts: list[str | None], size: int = 1 << 20):
    """(first, texts) for runs of texts of about size characters."""
    first, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t) if t else 0
        if total >= size:
            yield first, texts[first:i + 1]
            first, total = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]
