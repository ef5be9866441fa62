"""Vectorised word and shingle hashing over batches of texts.

Words are runs of bytes outside a separator set; A-Z count as a-z. Each word
gets a 64-bit hash from byte-wise polynomial prefix sums, so that a batch of
texts costs a fixed number of numpy passes and no Python loop over words.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_SEGMENT = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x.astype(U64, copy=True)
        x ^= x >> U64(30)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


def _seeded(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


def ascii_space() -> np.ndarray:
    """Separators of the near-duplicate operators: space and U+0009 to U+000D."""
    sep = np.zeros(256, bool)
    sep[[0x20, *range(0x09, 0x0E)]] = True
    return sep


def not_alnum() -> np.ndarray:
    """Separators of decontamination: all of ASCII but digits and letters."""
    sep = np.zeros(256, bool)
    sep[:0x80] = True
    for a, b in (("0", "9"), ("a", "z"), ("A", "Z")):
        sep[ord(a) : ord(b) + 1] = False
    return sep


class Hasher:
    """Word hashes for one separator set."""

    def __init__(self, separators: np.ndarray) -> None:
        self.sep = separators
        self.codes = _seeded(256, 0x1234567)
        self.codes[65:91] = self.codes[97:123]
        self._grow(_SEGMENT + 1)

    def _grow(self, n: int) -> None:
        with np.errstate(over="ignore"):
            p = np.full(n, U64(0x9E3779B97F4A7C15))
            p[0] = 1
            self.pow = np.multiply.accumulate(p)
            inverse = pow(0x9E3779B97F4A7C15, -1, 1 << 64)
            p[1:] = U64(inverse)
            self.inv = np.multiply.accumulate(p)

    def _piece(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(buf) >= len(self.pow):
            self._grow(len(buf) + 1)
        edge = np.empty(len(buf) + 2, np.int8)
        edge[0] = edge[-1] = 1
        edge[1:-1] = self.sep[buf]
        turns = np.flatnonzero(np.diff(edge))
        starts, ends = turns[0::2], turns[1::2]
        with np.errstate(over="ignore"):
            acc = np.zeros(len(buf) + 1, U64)
            np.cumsum(self.codes[buf] * self.pow[: len(buf)], out=acc[1:])
            h = (acc[ends] - acc[starts]) * self.inv[starts]
            h += (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93)
        return mix(h), starts, ends

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words of all texts, and where each text's words begin (one more than texts)."""
        hashes, counts, group, size = [], [], [], 0

        def flush() -> None:
            nonlocal group, size
            if not group:
                return
            begin = np.cumsum([0, *(len(t) + 1 for t in group)])
            h, starts, _ = self._piece(np.frombuffer(b" ".join(group), np.uint8))
            hashes.append(h)
            counts.append(np.diff(np.searchsorted(starts, begin)))
            group, size = [], 0

        for t in texts:
            if len(t) > _SEGMENT:
                flush()
                parts = [self._piece(np.frombuffer(part, np.uint8))[0] for part in self._cut(t)]
                hashes.append(np.concatenate(parts))
                counts.append(np.array([sum(map(len, parts))]))
                continue
            if size + len(t) > _SEGMENT:
                flush()
            group.append(t)
            size += len(t) + 1
        flush()
        if not counts:
            return np.zeros(0, U64), np.zeros(1, np.int64)
        return np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(counts))])

    def _cut(self, text: bytes) -> list[bytes]:
        """A very long text in pieces that end at separators."""
        out, at, is_sep = [], 0, self.sep[np.frombuffer(text, np.uint8)]
        while at < len(text):
            to = min(len(text), at + _SEGMENT)
            if to < len(text):
                found = np.flatnonzero(is_sep[at:to])
                if len(found):
                    to = at + int(found[-1]) + 1
                else:
                    rest = np.flatnonzero(is_sep[to:])
                    to = to + int(rest[0]) + 1 if len(rest) else len(text)
            out.append(text[at:to])
            at = to
        return out

    def spans(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Byte offsets of the words of one text."""
        edge = np.empty(len(text) + 2, np.int8)
        edge[0] = edge[-1] = 1
        edge[1:-1] = self.sep[np.frombuffer(text, np.uint8)]
        turns = np.flatnonzero(np.diff(edge))
        return turns[0::2], turns[1::2]


def shingles(words: np.ndarray, begin: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word windows in order, and where each text's begin.

    A text of fewer words, but not none, is one window.
    """
    n = np.diff(begin)
    out_n = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    out_begin = np.concatenate([[0], np.cumsum(out_n)])
    salt = _seeded(width, 0xABCDEF) | U64(1)
    if len(words) == 0:
        return np.zeros(0, U64), out_begin
    with np.errstate(over="ignore"):
        full = np.zeros(max(0, len(words) - width + 1), U64)
        for k in range(width):
            full += words[k : k + len(full)] * salt[k]
        out = np.empty(int(out_begin[-1]), U64)
        long_docs = n >= width
        # positions of windows that lie inside one text
        first = np.repeat(begin[:-1][long_docs], out_n[long_docs])
        within = np.arange(len(first)) - np.repeat(np.cumsum(out_n[long_docs]) - out_n[long_docs], out_n[long_docs])
        to = np.repeat(out_begin[:-1][long_docs], out_n[long_docs]) + within
        out[to] = full[first + within]
        for d in np.flatnonzero((n > 0) & (n < width)):
            own = words[begin[d] : begin[d + 1]]
            out[out_begin[d]] = (own * salt[: len(own)]).sum(dtype=U64) + U64(int(n[d]) * 0x2545F4914F6CDD1D & (1 << 64) - 1)
    return mix(out), out_begin


def encode(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def sets(shingle: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    return [np.unique(shingle[a:b]) for a, b in zip(begin[:-1], begin[1:], strict=True)]
