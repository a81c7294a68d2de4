"""Word shingles of whole texts as 64-bit fingerprints, computed over byte arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = U(0xD6E8FEB86659FD93)
#: Masks of the first k bytes of a little-endian block; longest word that is hashed block by block with all others.
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_BLOCKWISE = 128


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every output bit depends on every input bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _long_word(word: np.ndarray) -> np.uint64:
    blocks = np.frombuffer(word.tobytes() + bytes(-len(word) % 8), np.uint64)
    return mix(blocks ^ mix(np.arange(1, len(blocks) + 1, dtype=np.uint64))).sum(dtype=np.uint64)


def word_spans(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts and eight more, start and end of each word, first word of each text and the total).

    Words are runs without ASCII white space; they end with their text.
    """
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2] if len(texts) else None
    if data is None or offsets[0] == offsets[-1]:
        return np.zeros(8, np.uint8), np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    out = np.zeros(len(raw) + 8, np.uint8)
    out[: len(raw)] = _LOWER[raw] if lower else raw
    solid = ~_SPACE[raw]
    cuts = offsets[:-1][offsets[:-1] < len(raw)]
    head, tail = np.ones(len(raw), dtype=bool), np.ones(len(raw), dtype=bool)
    np.logical_not(solid[:-1], out=head[1:])
    np.logical_not(solid[1:], out=tail[:-1])
    head[cuts] = True
    tail[cuts[cuts > 0] - 1] = True
    starts = np.flatnonzero(head & solid)
    return out, starts, np.flatnonzero(tail & solid) + 1, np.searchsorted(starts, offsets)


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word; ``raw`` has eight bytes to spare."""
    blocks = np.ndarray((len(raw) - 7,), np.uint64, raw, strides=(1,))
    size = ends - starts
    out = mix((blocks[starts] & _MASK[np.minimum(size, 8)]) + size.astype(np.uint64) * _STEP)
    more, at = np.flatnonzero((size > 8) & (size <= _BLOCKWISE)), 8
    while len(more):
        left = np.minimum(size[more] - at, 8)
        out[more] = mix(out[more] * _STEP + (blocks[starts[more] + at] & _MASK[left]))
        at += 8
        more = more[size[more] > at]
    for k in np.flatnonzero(size > _BLOCKWISE):
        out[k] = mix(out[k : k + 1] ^ _long_word(raw[starts[k] : ends[k]]))[0]
    return out


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and the total): words are runs without ASCII white space."""
    raw, starts, ends, first = word_spans(texts, lower)
    return hash_spans(raw, starts, ends), first


def shingle_sets(texts: pa.Array, n: int = 5) -> list[np.ndarray]:
    """The sorted distinct ``n``-word shingles of each text.

    A text of fewer words has its whole sequence as the one shingle; one
    without words has none.
    """
    words, bounds = word_hashes(texts)
    if not len(words):
        return [np.empty(0, np.uint64)] * len(texts)
    runs = np.zeros(max(len(words) - n + 1, 0), dtype=np.uint64)
    for k in range(n):
        runs = mix(runs * _STEP + words[k : k + len(runs)] + U(k + 1))
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(runs[a : b - n + 1]))
        elif b > a:
            one = np.full(1, 0xA5A5A5A5A5A5A5A5 ^ (b - a), dtype=np.uint64)
            for w in words[a:b]:
                one = mix(one * _STEP + w + U(77))
            out.append(one)
        else:
            out.append(np.empty(0, np.uint64))
    return out
