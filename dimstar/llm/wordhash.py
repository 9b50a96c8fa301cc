"""64-bit hashes of the words of many texts at once, in numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

#: Texts are taken together up to this many bytes; a longer one is taken alone.
BYTES_AT_ONCE = 1_000_000

#: Words up to this many bytes are hashed in numpy, 8 bytes at a time; longer ones by BLAKE2b.
SHORT = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits depend on all bits of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def groups(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, the texts as UTF-8) of runs of texts up to BYTES_AT_ONCE together; null counts as empty."""
    first, run, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "replace")
        if run and size + len(raw) > BYTES_AT_ONCE:
            yield first, run
            first, run, size = i, [], 0
        run.append(raw)
        size += len(raw) + 1
    if run:
        yield first, run


def word_hashes(raw: list[bytes], fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text the index of its first word (one more entry at the end).

    fold[byte] is what the byte counts as, 0 if it separates words; it has to be 0 for the space.
    """
    data = fold[np.frombuffer(b" ".join([*raw, b""]), np.uint8)] if raw else np.zeros(0, np.uint8)
    inside = np.concatenate([[False], data != 0])
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:]) - 0
    length = (ends - starts).astype(np.uint64)
    hashes = mix(length * np.uint64(0x9E3779B97F4A7C15))
    eights = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    for at in range(0, SHORT, 8):
        there = np.flatnonzero(length > at)
        if not len(there):
            break
        value = np.ascontiguousarray(eights[starts[there] + at]).view("<u8")[:, 0]
        beyond = np.maximum(0, at + 8 - length[there].astype(np.int64)).astype(np.uint64)  # bytes that belong to what follows the word
        value &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * beyond)
        hashes[there] = mix((hashes[there] ^ value) * np.uint64(0x9FB21C651E98DF25))
    for i in np.flatnonzero(length > SHORT).tolist():
        hashes[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    text_at = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    return hashes, np.searchsorted(starts, text_at)
