"""Numpy kernels over many texts at once: one byte buffer, word and line bounds, and hashes of words, lines and n-grams.

Prefix hashes are held for STRETCH bytes at a time, so a very long text costs some ten bytes of memory a byte, most of them for
its words; hashes depend on the bytes alone, not on where a stretch begins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_Q = np.uint64(0xD6E8FEB86659FD93)
_TABLE = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes whose prefix hashes are held at once, and keys that are sorted at once.
STRETCH, AT_ONCE = 1 << 20, 1 << 21
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, 1 << 16)
        a, b = np.full(size, _P), np.full(size, _PINV)
        a[0] = b[0] = 1
        _pow, _inv = np.cumprod(a), np.cumprod(b)
    return _pow, _inv


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves about half of the output bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Texts:
    """Texts joined into one buffer, each followed by a line feed, with the bounds of their words."""

    def __init__(self, texts: list[str | bytes | None]):
        raw = [x if isinstance(x, bytes) else (x or "").encode("utf-8", "surrogatepass") for x in texts]
        self.n = len(raw)
        self.size = np.fromiter(map(len, raw), np.int64, self.n)
        self.start = np.concatenate([[0], np.cumsum(self.size + 1)]).astype(np.int64)
        self.buf = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
        edge = self._edges()
        self.w0, self.w1 = edge[0::2], edge[1::2]
        self.wdoc = self.of(self.w0)
        self.n_words = np.bincount(self.wdoc, minlength=self.n)
        self._prefix: np.ndarray | None = None

    def of(self, at: np.ndarray) -> np.ndarray:
        """The text at each place of the buffer."""
        return np.zeros(len(at), np.int32) if self.n == 1 else (np.searchsorted(self.start, at, "right") - 1).astype(np.int32)

    def _edges(self) -> np.ndarray:
        """Where words begin and end, in turn."""
        small = np.int32 if len(self.buf) < 1 << 31 else np.int64
        out, before = [np.zeros(0, small)], np.ones(1, bool)
        for a in range(0, len(self.buf), STRETCH):
            part = self.buf[a : a + STRETCH]
            sep = np.concatenate([before, (part == 32) | ((part - np.uint8(9)) < 5)])
            out.append((np.flatnonzero(sep[1:] != sep[:-1]) + a).astype(small))
            before = sep[-1:]
        return np.concatenate(out)

    def count_bytes(self, table: np.ndarray) -> np.ndarray:
        """Bytes of each text that the table (of 256 flags) marks."""
        out = np.zeros(self.n, np.int64)
        for a in range(0, len(self.buf), STRETCH):
            at = np.flatnonzero(table[self.buf[a : a + STRETCH]]) + a
            out += np.bincount(self.of(at), minlength=self.n)[: self.n]
        return out

    @staticmethod
    def _stretches(begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Runs [i, j) of ranges (begin in order) that together span [a, b), two stretches at most, or one longer range alone."""
        i = 0
        while i < len(begin):
            a = int(begin[i])
            j = int(np.searchsorted(begin, a + STRETCH, "left"))
            long = np.flatnonzero(end[i:j] - begin[i:j] > STRETCH)
            if len(long):
                j = i + max(1, int(long[0]))
            yield i, j, a, max(a, int(end[i:j].max()))
            i = j

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Polynomial hashes of the byte ranges [begin, end), begin in order: prefix differences moved to a common origin."""
        out = np.empty(len(begin), np.uint64)
        if len(self.buf) <= 2 * STRETCH:  # one prefix serves all calls
            p, inv = _powers(len(self.buf) + 1)
            if self._prefix is None:
                self._prefix = np.zeros(len(self.buf) + 1, np.uint64)
                np.cumsum(_TABLE[self.buf] * p[: len(self.buf)], out=self._prefix[1:])
            return mix((self._prefix[end] - self._prefix[begin]) * inv[begin] + (end - begin).astype(np.uint64))
        for i, j, a, b in self._stretches(begin, end):
            p, inv = _powers(2 * STRETCH + 1)
            if b - a > 2 * STRETCH:
                total, scale = 0, 1
                for s in range(a, b, STRETCH):
                    part = self.buf[s : min(b, s + STRETCH)]
                    total += int((_TABLE[part] * p[: len(part)]).sum()) * scale
                    scale = scale * pow(int(_P), STRETCH, 1 << 64) % (1 << 64)
                out[i] = total % (1 << 64)
                continue
            h = np.zeros(b - a + 1, np.uint64)
            np.cumsum(_TABLE[self.buf[a:b]] * p[: b - a], out=h[1:])
            x = begin[i:j] - a
            out[i:j] = (h[end[i:j] - a] - h[x]) * inv[x]
        out += (end - begin).astype(np.uint64)
        return mix(out)

    def words(self) -> np.ndarray:
        return self.hashes(self.w0, self.w1)

    def word_points(self) -> np.ndarray:
        """Code points of each word."""
        out = np.empty(len(self.w0), np.int32)
        for i, j, a, b in self._stretches(self.w0, self.w1):
            if b - a > 2 * STRETCH:
                out[i] = sum(np.count_nonzero((self.buf[s : min(b, s + STRETCH)] & 0xC0) != 0x80) for s in range(a, b, STRETCH))
                continue
            c = np.concatenate([[0], np.cumsum((self.buf[a:b] & 0xC0) != 0x80, dtype=np.int32)])
            out[i:j] = c[self.w1[i:j] - a] - c[self.w0[i:j] - a]
        return out

    def lines(self) -> tuple[np.ndarray, ...]:
        """Begin, end and text of each LF-split line that holds a word, and the numbers of its first word and of the one after its last."""
        end = np.concatenate([np.flatnonzero(self.buf[a : a + STRETCH] == 10) + a for a in range(0, len(self.buf), STRETCH)] or [np.zeros(0, np.int64)])
        begin = np.concatenate([[0], end[:-1] + 1]).astype(np.int64)[: len(end)]
        first, last = np.searchsorted(self.w0, begin), np.searchsorted(self.w0, end)
        keep = last > first
        begin, end = begin[keep], end[keep]
        return begin, end, self.of(begin), first[keep], last[keep]


def ngrams(words: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hashes of n consecutive words, and which windows stay inside one document."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    h = words[:m].copy()
    for j in range(1, n):
        h *= _Q
        h += words[j : j + m]
    return mix(h), doc[:m] == doc[n - 1 :]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which entries have a value that occurs twice or more; very many are worked in parts by their leading bits."""
    out = np.zeros(len(keys), bool)
    if len(keys) > AT_ONCE:
        for part in range(16):
            at = np.flatnonzero(keys >> np.uint64(60) == part)
            out[at] = _repeated(keys[at])
        return out
    return _repeated(keys)


def _repeated(keys: np.ndarray) -> np.ndarray:
    s = np.sort(keys)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    twice = twice[np.concatenate([[True], twice[1:] != twice[:-1]])]
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of total words lie in a window of n words that begins at one of starts."""
    d = np.zeros(total + 1, np.int32)
    d[starts] += 1
    np.subtract.at(d, starts + n, 1)
    return np.cumsum(d[:-1], dtype=np.int32) > 0
