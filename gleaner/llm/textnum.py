"""Whole-batch text hashing with numpy.

Arrow batches of texts become one array of Unicode code points; words, k-gram hashes and winnowing then run as array
passes over millions of characters at a time, so the Python side costs tens of nanoseconds a character.
All hashes depend on content only, never on the batch, the position or the machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U64(pow(int(_BASE), -1, 1 << 64))
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_NONE = U64(0xFFFFFFFFFFFFFFFF)
#: Code points per array pass; a longer single text makes a longer pass of its own.
PASS_CHARS = 1 << 20

_powers: dict[str, np.ndarray] = {}
_alnum: np.ndarray | None = None


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U64(30))) * _M1
    x = (x ^ (x >> U64(27))) * _M2
    return x ^ (x >> U64(31))


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, PASS_CHARS + 1)
        a = np.full(size, base, dtype=U64)
        a[0] = 1
        have = _powers[name] = np.multiply.accumulate(a)
    return have[:n]


def is_word_char(cps: np.ndarray) -> np.ndarray:
    """True for Unicode letters and digits."""
    global _alnum
    if _alnum is None:
        _alnum = np.fromiter((chr(i).isalnum() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _alnum[cps]


def passes(items: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of ``items`` of about PASS_CHARS characters each."""
    start = total = 0
    for i, s in enumerate(items):
        if total and total + len(s) > PASS_CHARS:
            yield start, i
            start, total = i, 0
        total += len(s)
    if start < len(items):
        yield start, len(items)


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of ``texts``, one after another, and the bounds of each text (length + 1 numbers)."""
    cps = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    bounds = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)), out=bounds[1:])
    return cps, bounds


def _prefix(cps: np.ndarray) -> np.ndarray:
    v = mix(cps.astype(U64) + U64(0x1D8E4E27C47D124F))
    p = np.zeros(len(cps) + 1, dtype=U64)
    np.cumsum(v * _power("base", _BASE, len(cps)), out=p[1:])
    return p


def char_grams(cps: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k characters that begin at each position; the largest number where the text ends before that."""
    n = len(cps)
    out = np.full(n, _NONE, dtype=U64)
    if n >= k:
        p = _prefix(cps)
        out[: n - k + 1] = mix((p[k:] - p[:-k]) * _power("inverse", _BASE_INV, n + 1)[: n - k + 1])
        for e in bounds[1:]:
            out[max(0, e - k + 1) : e] = _NONE
    return out


class Words:
    """The words of a batch: maximal runs of letters and digits of the lower-cased texts."""

    def __init__(self, texts: list[str]):
        self.lowered = [t.lower() for t in texts]
        cps, self.bounds = codepoints(self.lowered)
        self.n_texts = len(texts)
        flag = np.zeros(len(cps) + 2, dtype=np.int8)
        flag[1:-1] = is_word_char(cps)
        starts = (flag[1:] == 1) & (flag[:-1] == 0)
        ends = (flag[1:] == 0) & (flag[:-1] == 1)
        inner = self.bounds[1:-1]
        cut = inner[(flag[inner + 1] == 1) & (flag[inner] == 1)] if len(inner) else inner  # a word never joins two texts
        starts[cut] = True
        ends[cut] = True
        self.start, self.end = np.flatnonzero(starts[:-1]), np.flatnonzero(ends)
        self.text_of = np.searchsorted(self.bounds, self.start, side="right") - 1
        p = _prefix(cps)
        self.hash = mix((p[self.end] - p[self.start]) * _power("inverse", _BASE_INV, len(cps) + 1)[self.start])
        self.first = np.searchsorted(self.text_of, np.arange(self.n_texts + 1))

    def grams(self, k: int) -> np.ndarray:
        """The hash of the k words from each word on; the largest number where the text ends before that."""
        n = len(self.hash)
        out = np.full(n, _NONE, dtype=U64)
        if n >= k:
            h, m = np.zeros(n - k + 1, dtype=U64), U64(1)
            for j in range(k):
                h += self.hash[j : n - k + 1 + j] * m
                m = U64((int(m) * int(_M1)) & 0xFFFFFFFFFFFFFFFF)
            whole = self.text_of[: n - k + 1] == self.text_of[k - 1 :]
            out[: n - k + 1] = np.where(whole, np.minimum(mix(h), _NONE - U64(1)), _NONE)
        return out

    def words(self, lo: int, hi: int) -> list[str]:
        """The words lo to hi - 1 themselves."""
        out = []
        for i in range(lo, hi):
            t = self.text_of[i]
            b = self.bounds[t]
            out.append(self.lowered[t][self.start[i] - b : self.end[i] - b])
        return out


def _sliding(a: np.ndarray, w: int, op: np.ufunc, pad: np.uint64) -> np.ndarray:
    """op over a[i : i + w] for every i, in three passes whatever w is."""
    n = len(a)
    rows = (n + 2 * w - 1) // w
    b = np.full(rows * w, pad, dtype=U64)
    b[:n] = a
    b = b.reshape(rows, w)
    ahead = op.accumulate(b, axis=1).ravel()
    back = op.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[:n], ahead[w - 1 : n + w - 1])


def winnow(grams: np.ndarray, w: int) -> np.ndarray:
    """Positions whose hash is the least in some window of w consecutive positions.

    Any w consecutive k-grams that two texts share thus give both the same selected hash. Equal least hashes are all
    selected. Windows that reach over the end of a text may select more, never less.
    """
    if not len(grams):
        return np.zeros(0, dtype=np.int64)
    least = _sliding(grams, w, np.minimum, _NONE)
    # the largest of the window minima over all windows that hold a position
    front = np.concatenate([np.zeros(w - 1, dtype=U64), least])
    opened = _sliding(front, w, np.maximum, U64(0))[: len(grams)]
    return np.flatnonzero((opened == grams) & (grams != _NONE))
