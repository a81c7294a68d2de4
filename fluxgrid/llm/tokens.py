"""Token ids of whole texts with the ``tokenizers`` library, each distinct word encoded once.

The word tokenizer normalises and splits inside white-space-delimited runs, so
a text's ids are those of its runs in order.  Runs are found and hashed by array
(two runs of a worker share a 64-bit hash with a chance of about 1e-8 in all),
only new ones reach the tokenizer, and ids are gathered by array.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from fluxgrid.llm import common
from fluxgrid.llm.shingles import hash_spans, word_spans

#: Default vocabulary; every operator takes the path as a parameter.
VOCABULARY, END_ID = "word_bpe_49k.json", 1
#: Distinct runs that a worker remembers; when it has more, it starts anew (results do not depend on it).
CACHE_RUNS = 1_000_000
#: ASCII marks; behind an ASCII letter a run of them at a word's end is always a word of its own.
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
#: Texts that are encoded whole: with what may begin a special token, with white space that the library's normaliser may know and ours
#: may not, or the reverse, with letters beyond U+024F or one whose lower case is two characters.
_ALONE, _WHOLE = ("<|", "\x1c", "\x1d", "\x1e", "\x1f"), re.compile("[^\x00-ɏ]|[İ\x85\xa0]")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _word_ends(path: str) -> np.ndarray:
    """Whether an id is the last of its word."""
    ends = np.zeros(_tokenizer(path).get_vocab_size() + 1, bool)
    for piece, k in _tokenizer(path).get_vocab().items():
        ends[k] = piece.endswith("</w>")
    return ends


class Encoder:
    """Encodes lists of texts; remembers the ids of the runs that it has met, by hash."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.keys, self.codes = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.start, self.count = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64)

    def _store(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        n, total = len(self.keys), len(flat)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while n + len(sizes) > len(self.start):
            self.start, self.count = (np.concatenate([x, np.empty_like(x)]) for x in (self.start, self.count))
        self.flat[self.used : self.used + total] = flat
        self.count[n : n + len(sizes)] = sizes
        self.start[n : n + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.used += total

    def _gather(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the numbered runs, end to end; where each ends)."""
        count = self.count[code]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        return (self.flat[np.arange(total) + np.repeat(self.start[code] - (ends - count), count)] if total else np.empty(0, np.uint32)), ends

    def _each(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in _tokenizer(self.path).encode_batch_fast(runs, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each) of words of letters alone: encoded as one text and cut where a word ends."""
        ids = np.array(_tokenizer(self.path).encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(_word_ends(self.path)[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            return self._each(words)
        return ids, np.diff(ends, prepend=0)

    def _learned(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of new runs, ids of each, the runs' order in them): letters alone are encoded together, other runs apart."""
        letters = np.fromiter(map(str.isalpha, runs), bool, len(runs))
        order = [np.flatnonzero(letters), np.flatnonzero(~letters)]
        parts = []
        for rows, encode in zip(order, (self._together, self._each), strict=True):
            parts += [encode([runs[k] for k in rows[at : at + 5_000].tolist()]) for at in range(0, len(rows), 5_000)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate(order)

    def _codes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of each run, first run of each text and the total); marks behind a letter are runs of their own."""
        raw, starts, ends, first = word_spans(texts, lower=False)
        cut = ends.copy()
        at = np.arange(len(cut))
        while len(at := at[_MARK[raw[cut[at] - 1]]]):
            cut[at] -= 1
            at = at[cut[at] > starts[at]]
        split = (cut < ends) & (cut > starts) & _LETTER[raw[cut - 1]]
        number = np.cumsum(split + 1)
        starts, ends, second = np.repeat(starts, split + 1), np.repeat(ends, split + 1), number[split] - 1
        starts[second] = ends[second - 1] = cut[split]
        first = np.concatenate([[0], number])[first]
        own, at, back = np.unique(hash_spans(raw, starts, ends), return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, own)
        fresh = np.ones(len(own), bool)
        inside = place < len(self.keys)
        fresh[inside] = self.keys[place[inside]] != own[inside]
        new = np.flatnonzero(fresh)
        if len(new):
            data = raw.tobytes()
            flat, sizes, order = self._learned([data[a:b].decode() for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)])
            code = np.empty(len(new), np.int64)
            code[order] = np.arange(len(self.keys), len(self.keys) + len(new))
            self._store(flat, sizes)
            self.keys, self.codes = np.insert(self.keys, place[new], own[new]), np.insert(self.codes, place[new], code)
            place = np.searchsorted(self.keys, own)
        return self.codes[place][back], first

    def _plain(self, text: str) -> np.ndarray:
        return np.array(_tokenizer(self.path).encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, without any end id, in order; ids of each text)."""
        if len(self.keys) > CACHE_RUNS:
            self.__init__(self.path)
        values = texts.to_pylist()
        plain = {k: self._plain(t) for k, t in enumerate(values) if any(x in t for x in _ALONE) or not t.isascii() and _WHOLE.search(t)}
        code, first = self._codes(pa.array(["" if k in plain else t.lower() for k, t in enumerate(values)], pa.string()))
        ids, ends = self._gather(code)
        edges = np.concatenate([[0], ends])[first]
        sizes = np.diff(edges)
        if plain:
            parts, last = [], 0
            for k, own in sorted(plain.items()):
                parts += [ids[last : edges[k]], own]
                last, sizes[k] = edges[k], len(own)
            ids = np.concatenate([*parts, ids[last:]])
        return ids, sizes


_ENCODERS: dict[str, Encoder] = {}
common.WORKER_CACHES.append(_ENCODERS)


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary; it outlives tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded_chunks(batch: pa.RecordBatch, path: str, most: int):
    """(first row, ids of the chunk's rows with their end ids, ids of each row), in order."""
    text = common.as_string(batch, "text")
    for a, b in common.chunks(text, most):
        ids, sizes = encoder(path).encode(text.slice(a, b - a))
        out = np.full(len(ids) + len(sizes), END_ID, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes)] = ids
        yield a, out, sizes + 1


def encoded_documents(batch: pa.RecordBatch, path: str, most: int = common.CHUNK_BYTES):
    """(row, its ids with the end id) for each row of the batch, in order; about ``most`` bytes of text are encoded at once."""
    for a, ids, sizes in encoded_chunks(batch, path, most):
        at = 0
        for k, n in enumerate(sizes.tolist()):
            yield a + k, ids[at : at + n]
            at += n
