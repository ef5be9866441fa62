"""Pre-tokens of many texts at once: where they are, which are distinct, how they were solved.

One white-space marker (a space, or the literal U+2581) is put in front of
every text that isn't empty. A pre-token ends where no piece of the vocabulary
has the next character after the last (``piecemodels.joins``). Pre-tokens of a
batch tile one buffer, so Arrow dictionary-encodes them without copies and
Python sees each distinct one once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from corpusloom.llm.piecemodels import MARK

_MARK_BYTES = MARK.encode()
#: Texts are taken together up to this size; a longer one alone.
GROUP_BYTES = 1 << 20


def groups(texts: list[bytes], most: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of bounded size."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        if k > at and size + len(t) > most:
            yield at, k
            at, size = k, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def split(texts: list[bytes], joined: np.ndarray) -> tuple[pa.BinaryArray, np.ndarray]:
    """All pre-tokens in order, markers as spaces, and where each text's begin (one more than texts)."""
    parts = [b" " + t.replace(_MARK_BYTES, b" ") if t else b"" for t in texts]
    starts = np.cumsum([0, *map(len, parts)])
    raw = b"".join(parts)
    buf = np.frombuffer(raw, np.uint8)
    turn = np.ones(len(buf), bool)
    turn[1:] = ~joined.ravel()[buf[:-1].astype(np.int32) * 256 + buf[1:]]
    turn[starts[:-1][np.diff(starts) > 0]] = True
    at = np.flatnonzero(turn)
    offsets = np.append(at, len(buf)).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)]), np.searchsorted(at, starts)


class Solved:
    """Numbers (one or several) remembered of distinct pre-tokens, in flat arrays.

    It is emptied, before a group is looked up, when it holds more than
    ``most`` entries or ``most_bytes`` bytes of pre-tokens; so all pre-tokens
    of the group at hand are known whatever its size.
    """

    def __init__(self, solve: Callable[[list[bytes]], list[np.ndarray]], known: dict[bytes, np.ndarray] | None = None, most: int = 400_000, most_bytes: int = 16 << 20) -> None:
        self.solve, self.first, self.most, self.most_bytes = solve, known or {}, most, most_bytes
        self._empty()

    def _empty(self) -> None:
        self.place: dict[bytes, int] = {}
        self.flat, self.offsets, self.size = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), 0
        self._add(list(self.first), list(self.first.values()))
        self.size = 0

    def _add(self, words: list[bytes], rows: list[np.ndarray]) -> None:
        if not words:
            return
        n, lengths = len(self.place), np.fromiter(map(len, rows), np.int64, len(rows))
        ends = self.offsets[n] + np.cumsum(lengths)
        if n + len(words) + 1 > len(self.offsets):
            self.offsets = np.concatenate([self.offsets, np.zeros(max(len(self.offsets), len(words) + 1), np.int64)])
        if ends[-1] > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), int(ends[-1])), np.int32)])
        self.flat[self.offsets[n] : ends[-1]] = np.concatenate(rows)
        self.offsets[n + 1 : n + 1 + len(words)] = ends
        self.place.update(zip(words, range(n, n + len(words)), strict=True))
        self.size += sum(map(len, words))

    def look_up(self, pretokens: pa.BinaryArray) -> np.ndarray:
        """The place of every pre-token; new ones are solved, each distinct one once."""
        if len(self.place) - len(self.first) > self.most or self.size > self.most_bytes:
            self._empty()
        coded = pretokens.dictionary_encode()
        words = coded.dictionary.to_pylist()
        fresh = [w for w in words if w not in self.place]
        if fresh:
            self._add(fresh, self.solve(fresh))
        place = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        return place[coded.indices.to_numpy()]

    def gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all ``places`` one after the other, and where each one's begin (one more than places)."""
        return take_slices(self.flat, self.offsets, places)


def take_slices(flat: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slices ``which`` of ``flat`` one after the other, and where each begins (one more than slices)."""
    first = offsets[which]
    begin = np.concatenate([[0], np.cumsum(offsets[which + 1] - first)])
    at = np.arange(begin[-1]) + np.repeat(first - begin[:-1], np.diff(begin))
    return flat[at], begin
