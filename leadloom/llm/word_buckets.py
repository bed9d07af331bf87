"""Buckets of word runs of one or two, for many texts at once: CRC-32 of their bytes modulo the number of buckets.

Words are made of ASCII letters, lower-cased, digits and all characters beyond ASCII; everything else separates. The words of
a group of texts are hashed together, byte by byte; a run of two goes on from the first word's sum over a space.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np

#: Words of more bytes are hashed one by one.
LONG = 64
#: What each byte becomes: itself, its lower case, or 0 between words.
LOWER = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0 for b in range(256))


def crc_table() -> np.ndarray:
    """Remainders of all bytes by the reversed polynomial of CRC-32."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


TABLE = crc_table()


def crc32(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """CRC-32 of every (start, length) of ``data``, each going on from the sum ``before`` it."""
    state = ~(np.zeros(len(starts), np.uint32) if before is None else before)
    order = np.argsort(-lengths, kind="stable")
    first_short = int(np.searchsorted(-lengths[order], -LONG, "left"))
    short = order[first_short:]
    at, sizes, own = starts[short], lengths[short], state[short]
    for k in range(int(sizes[0]) if len(sizes) else 0):
        m = int(np.searchsorted(-sizes, -k, "left"))  # words of more than k bytes
        own[:m] = TABLE[(own[:m] ^ data[at[:m] + k]) & 255] ^ (own[:m] >> 8)
    state[short] = own
    for k in order[:first_short]:
        state[k] = ~np.uint32(zlib.crc32(data[starts[k]:starts[k] + lengths[k]], int(~state[k])))
    return ~state


def text_buckets(texts: Sequence[str], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, the text of each feature, the bucket of each feature)."""
    encoded = [t.encode().translate(LOWER) for t in texts]
    data = np.frombuffer(b"\0".join([b"", *encoded, b""]), np.uint8)
    inside = data != 0
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    lengths = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1 - starts
    ends = np.cumsum([len(e) + 1 for e in encoded])
    owner = np.searchsorted(ends, starts, "left")
    single = crc32(data, starts, lengths)
    pairs = np.flatnonzero(owner[1:] == owner[:-1])
    spaced = TABLE[(~single[pairs] ^ np.uint32(32)) & 255] ^ (~single[pairs] >> 8)
    double = crc32(data, starts[pairs + 1], lengths[pairs + 1], ~spaced)
    return (
        np.bincount(owner, minlength=len(texts)), np.concatenate([owner, owner[pairs]]),
        np.concatenate([single, double]).astype(np.int64) % buckets,
    )
