"""Vectorised word hashing over Arrow text columns.

Texts are taken as the UTF-8 bytes that Arrow already holds side by side, and
handled a few hundred kilobytes at a time, so that memory does not depend on
how many rows a batch has.  A word's hash takes in its bytes eight at a time
through a mixing function that is not linear (polynomials in wrapping arithmetic
have words, such as the Thue-Morse ones, that collide for every base); words
longer than ``LONG`` bytes get a keyed digest.  No Python object is made for a
shorter word.  Different seeds give independent hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
CHUNK = 1 << 19
#: Bytes of a word from which on it is digested by itself.
LONG = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift), applied to each element."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: By number of bytes: the mask that keeps them, of eight bytes read at once.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; behind the end stand zeros."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def span_hashes(data: np.ndarray, x: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of each span of ``data``; ``x`` are its eights."""
    size = ends - starts
    h = mix(size.astype(U) * U(0xD6E8FEB86659FD93) + U(0x1234567 + seed))
    live, at, left = slice(None), starts, size
    while len(at):
        h[live] = mix(h[live] ^ (x[at] & _KEEP[np.minimum(left, 8)]))
        more = np.flatnonzero((left > 8) & (left <= LONG))
        live = more if isinstance(live, slice) else live[more]
        at, left = at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=b"%d" % seed)
        h[i] = int.from_bytes(digest.digest(), "little")
    return h


def equal_spans(data: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes at places ``a`` and ``b`` are the same; of more than LONG only the first eight are compared."""
    same = np.ones(len(a), bool)
    live, left = np.arange(len(a)), size
    while len(live):
        same[live] = ((x[a] ^ x[b]) & _KEEP[np.minimum(left, 8)]) == 0
        more = np.flatnonzero((left > 8) & (left <= LONG) & same[live])
        live, a, b, left = live[more], a[more] + 8, b[more] + 8, left[more] - 8
    return same


#: Bytes as words have them: A-Z count as a-z.
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[65:91] += 32
#: Bytes of words: everything but space, tab, LF, VT, FF and CR.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, *range(9, 14)]] = False
#: Bytes of bare words: letters, digits and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


@dataclass
class Words:
    """Words of the rows ``first`` .. ``last`` of a batch."""

    first: int
    last: int
    data: np.ndarray  # bytes of the chunk
    starts: np.ndarray  # first byte of each word
    ends: np.ndarray  # one past its last byte
    at: np.ndarray  # at[i]:at[i+1] are the words of row first+i

    @cached_property
    def _folded(self) -> tuple[np.ndarray, np.ndarray]:
        folded = FOLDED[self.data]
        return folded, eights(folded)

    def span_hash(self, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
        return span_hashes(*self._folded, starts, ends, seed)

    @cached_property
    def hashes(self) -> np.ndarray:
        return self.span_hash(self.starts, self.ends)

    @property
    def rows(self) -> np.ndarray:
        """The row (from 0 within the chunk) of each word."""
        return np.repeat(np.arange(self.last - self.first), np.diff(self.at))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``size`` bytes; a longer text is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        j = min(j, n, i + 4096)
        yield i, j
        i = j


def words(texts: pa.Array, alphabet: np.ndarray = NOT_SPACE, apart: bool = False) -> Iterator[Words]:
    """Words of each text, a chunk at a time; ``alphabet`` marks the bytes of words.

    With ``apart`` every character of a script that is written without spaces
    (kana, Han, Thai, Lao) is a word of its own.
    """
    data, offsets = flat(texts)
    for i, j in chunks(offsets):
        part = data[offsets[i] : offsets[j]]
        bounds = offsets[i : j + 1] - offsets[i]
        yield split(part, bounds, i, j, alphabet, apart)


def split(part: np.ndarray, bounds: np.ndarray, i: int, j: int, alphabet: np.ndarray, apart: bool = False) -> Words:
    n = len(part)
    inside = alphabet[part]
    full = bounds[:-1] < bounds[1:]
    edge = np.zeros(n + 1, bool)
    edge[bounds[:-1][full]] = True
    edge[bounds[1:][full]] = True
    if apart:
        # such characters are three bytes long, and these bytes only begin characters
        lead = np.flatnonzero((part >= 0xE3) & (part <= 0xE9))
        thai = np.flatnonzero(part[:-1] == 0xE0)
        lead = np.concatenate([lead, thai[(part[thai + 1] >= 0xB8) & (part[thai + 1] <= 0xBB)]])
        edge[lead] = True
        edge[np.minimum(lead + 3, n)] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Words(i, j, part, starts, ends, np.searchsorted(starts, bounds))


def ragged(values: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[at[0]:at[0]+size[0]], values[at[1]:at[1]+size[1]], ... end to end."""
    stop = np.cumsum(size)
    total = int(stop[-1]) if len(stop) else 0
    return values[np.repeat(at - (stop - size), size) + np.arange(total)]


_STEP = U(0xA24BAED4963EE407 | 1)


def rolled(h: np.ndarray, m: int) -> np.ndarray:
    """One hash for every ``m`` words in a row."""
    if len(h) < m:
        return np.zeros(0, U)
    acc = np.full(len(h) - m + 1, m, U)
    for p in range(m):
        acc = acc * _STEP + h[p : len(h) - m + 1 + p]
    return mix(acc)


def shingle_sets(texts: pa.Array, k: int = 5, seed: int = 0) -> Iterator[np.ndarray]:
    """For each text its sorted distinct hashed ``k``-word shingles.

    A text of fewer words has one, its whole sequence; one without words none.
    """
    for w in words(texts):
        yield from sets_of(w, w.hashes if not seed else w.span_hash(w.starts, w.ends, seed), k)


def sets_of(w: Words, h: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The same for the texts of a chunk, from hashes ``h`` of its words."""
    each = rolled(h, k)
    for a, b in zip(w.at[:-1].tolist(), w.at[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(each[a : b - k + 1])
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
            yield s
        else:
            yield rolled(h[a:b], b - a) if b > a else np.zeros(0, U)
