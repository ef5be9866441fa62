"""What is read from a SentencePiece model file, on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

MARK = "▁"


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        n = shift = 0
        while True:
            byte = raw[at]
            at += 1
            n |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return n

    while at < len(raw):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = number() if tag & 7 == 2 else {1: 8, 5: 4}[tag & 7]
            yield tag >> 3, raw[at : at + size]
            at += size


def settings(model_file: str) -> tuple[int, bool]:
    """The kind of a model (1 unigram, 2 merges), and whether it leaves characters as they are."""
    with open(model_file, "rb") as f:
        parts = dict((k, v) for k, v in fields(f.read()) if k in (2, 3))
    trainer, normalizer = dict(fields(parts.get(2, b""))), dict(fields(parts.get(3, b"")))
    return trainer.get(3, 1), not normalizer.get(2) and normalizer.get(1, b"identity") in (b"identity", b"")


def piece_bytes(sp) -> dict[int, bytes]:
    """Text pieces (no control, unknown, unused or byte pieces) by id, markers as spaces."""
    ids = range(sp.vocab_size())
    return {i: sp.id_to_piece(i).replace(MARK, " ").encode() for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}


def joins(pieces: list[bytes]) -> np.ndarray:
    """For each pair of bytes whether some piece has them side by side.

    The second byte of a pair that begins a character and never stands after
    the first inside a piece is where no piece, and so no merge, can cross.
    Bytes inside a character always belong together.
    """
    out = np.zeros((256, 256), bool)
    out[:, 0x80:0xC0] = True
    for p in pieces:
        b = np.frombuffer(p, np.uint8)
        out[b[:-1], b[1:]] = True
    return out
