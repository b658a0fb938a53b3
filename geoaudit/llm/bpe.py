"""Byte-level BPE encoding and decoding with a contiguous rank array per word.

A text is cut by the usual byte-level pattern; each distinct piece is merged
once per cache life.  For a short piece contiguous arrays hold the parts between
its boundaries and the rank of merging each with its neighbour; the least rank
is searched by a scan, the boundary there deleted, and the two neighbouring
ranks are looked up again.  Many short pieces are merged side by side, one per
row of a matrix.  For long pieces (letters without end) the scan would be
quadratic, so the same merges are then taken from a heap over linked parts; both
give the leftmost pair of least rank each time.

Defined results: a null text is an empty one (no ids, decoded to ""); the
strings of special tokens in a text become their ids, as the tokenizers library
does by default; ids that the vocabulary lacks and byte runs that are no UTF-8
decode to U+FFFD.  Columns of the input with the names of the outputs are
replaced.  Rows are handled one by one: ties, repeats and empty tables need no
care.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from geoaudit.llm._frames import append, col
from geoaudit.llm._words import LONG, chunks, eights, equal_spans, flat, ragged, span_hashes
from geoaudit.session import table

#: Pieces up to this many bytes are merged by scanning.
SCAN_LIMIT = 96
#: Distinct pieces that a worker remembers before it starts anew, and bytes of them.
CACHE = 400_000
CACHE_BYTES = 1 << 25
#: Classes of characters: letter, number, plain space, other white space, and 0 for the rest.
LETTER, NUMBER, BLANK, SPACE = 1, 2, 4, 5
#: The Unicode White_Space characters but the plain space.
SPACES = [*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Endings that the pattern splits off together with their apostrophe.
ENDINGS = [b"'s", b"'t", b"'re", b"'ve", b"'m", b"'ll", b"'d"]


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point."""
    out = np.array([{"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], 0) for c in range(sys.maxunicode + 1)], np.uint8)
    out[SPACES] = SPACE
    out[32] = BLANK
    return out


def piece_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the pieces of texts begin, as the usual byte-level pattern cuts them.

    The pattern takes, in this order: an apostrophe with one of seven endings;
    a run of letters, of numbers or of other signs, each with one plain space
    before it; white space up to the last one before something else; white
    space.  So a piece begins where the class changes, except behind a plain
    space, and at the last space of a run that something follows.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    head = (data & 0xC0) != 0x80
    lead = np.flatnonzero(head)  # first byte of each character
    first = data[lead].astype(np.int64)
    point = first.copy()
    wide = np.flatnonzero(first >= 0xC0)
    if len(wide):
        at, byte = lead[wide], first[wide]
        size = 2 + (byte >= 0xE0) + (byte >= 0xF0)
        value = byte & (0x7F >> size)
        for k in range(1, 4):
            more = k < size
            value = np.where(more, value << 6 | data[np.minimum(at + k, n - 1)] & 0x3F, value)
        point[wide] = value
    kind = classes()[point]
    begins = np.zeros(n + 1, bool)
    begins[bounds[:-1]] = True  # texts; an empty one marks where the next begins
    begins = begins[lead]
    ends = np.append(begins[1:], True)
    before = np.append(np.uint8(0), kind[:-1])
    after = np.append(kind[1:], np.uint8(0))
    start = np.where(kind < BLANK, (before != kind) & (before != BLANK), (before < BLANK) | ((after < BLANK) & ~ends)) | begins
    quote = np.flatnonzero((point == 39) & start & ~ends)
    if len(quote):
        text_end = bounds[np.searchsorted(bounds, lead[quote], "right")]
        for ending in ENDINGS:
            room = lead[quote] + len(ending) <= text_end
            q = quote[room]
            hit = np.ones(len(q), bool)
            for k in range(1, len(ending)):
                hit &= data[lead[q] + k] == ending[k]
            q = q[hit]
            start[q + 1] = False
            q = q + len(ending)
            start[q[q < len(start)]] = True
    return lead[start]


def _packed(items: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(x) for x in items])
    return np.frombuffer(b"".join(items), np.uint8), np.cumsum(size) - size, size


@lru_cache(1)
def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Printable bytes stand for themselves; the others take the code points from
    256 on, in order.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def distinct_pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct pieces, and which one each piece is.

    Pieces are grouped by a hash, and every piece is then compared, byte by byte,
    with the first of its group; one that differs after all is told by itself.
    """
    x = eights(data)
    hashes = span_hashes(data, x, starts, ends)
    _, example, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    size = ends - starts
    first = example[inverse]
    same = (size == size[first]) & equal_spans(data, x, starts, starts[first], np.minimum(size, size[first]))
    raw = data.tobytes()
    found = [raw[a:b] for a, b in zip(starts[example].tolist(), ends[example].tolist(), strict=True)]
    for i in np.flatnonzero(size > LONG).tolist():
        same[i] &= raw[starts[i] : ends[i]] == found[inverse[i]]
    if not same.all():
        number = {p: k for k, p in enumerate(found)}
        for i in np.flatnonzero(~same).tolist():
            inverse[i] = number.setdefault(raw[starts[i] : ends[i]], len(number))
        found = list(number)
    return found, inverse


class Vocabulary:
    """Token ids, merge ranks and special tokens of a byte-level BPE file."""

    def __init__(self, spec: str):
        held = json.loads(spec)
        letters = byte_letters()
        model = held["model"]
        ids = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in held.get("added_tokens", [])}
        self.size = max([*ids.values(), *self.special.values()]) + 1
        self.tokens = [b"\xef\xbf\xbd"] * self.size
        for t, i in ids.items():
            self.tokens[i] = bytes(letters[c] for c in t)
        for t, i in self.special.items():
            self.tokens[i] = t.encode()
        self.token_bytes = _packed([*self.tokens, b"\xef\xbf\xbd"])
        self.number_bytes = _packed([b"%d," % i for i in range(self.size)])
        self.byte_ids = np.array([ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])])
        #: By rank: the id that a merge makes.  By pair of ids: the rank.
        self.made = np.array([ids[x + y] for x, y in merges] or [0])
        self.never = len(merges)
        self.rank = {ids[x] * self.size + ids[y]: r for r, (x, y) in reversed(list(enumerate(merges)))}
        order = np.array(sorted(self.rank), np.int64)
        self.pair_keys = np.append(order, np.iinfo(np.int64).max)
        self.pair_ranks = np.array([self.rank[k] for k in order.tolist()] + [self.never])
        self.forget()

    def forget(self) -> None:
        """Empty the cache: slots by piece; ids of all slots, and where each slot's are."""
        self.slots: dict[bytes, int] = {}
        self.held = 0
        self.ids = np.zeros(1 << 16, np.int32)
        self.at = np.zeros(1 << 14, np.int64)
        self.count = np.zeros(1 << 14, np.int64)
        self.used = 0

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of merging each pair of ids; ``never`` where there is none or an id is -1."""
        keys = np.where((left < 0) | (right < 0), np.int64(-1), left * self.size + right)
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], self.never)

    def merge_short(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of short pieces, all at once.

        Row i of ``ranks`` is the contiguous rank array of piece i, and row i of
        ``parts`` tells what stands between its boundaries.  Each round scans
        every row for its least rank, takes out the boundary there by moving
        what follows one place left, and looks up the two ranks beside it.
        """
        length = np.array([len(p) for p in pieces])
        width = int(length.max(initial=1))
        column = np.arange(width)
        parts = np.full((len(pieces), width + 1), -1, np.int64)
        inside = column < length[:, None]
        parts[:, :width][inside] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = np.full((len(pieces), width + 1), self.never, np.int64)
        ranks[:, :width] = self.ranks_of(parts[:, :-1], parts[:, 1:])
        ends = np.append(column[1:], [width, width])
        done: list[list[int]] = [[]] * len(pieces)
        live = np.arange(len(pieces))
        while len(live):
            at = ranks.argmin(1)
            row = np.arange(len(live))
            least = ranks[row, at]
            over = least >= self.never
            if over.any():
                for i, p in zip(live[over].tolist(), parts[over].tolist(), strict=True):
                    done[i] = p[: p.index(-1)]
                go = ~over
                live, at, least, parts, ranks = live[go], at[go], least[go], parts[go], ranks[go]
                row = np.arange(len(live))
                if not len(live):
                    break
            moved = np.arange(width + 1) >= at[:, None]
            ranks = np.where(moved, ranks[:, ends], ranks)
            moved[row, at] = False
            parts = np.where(moved, parts[:, ends], parts)
            parts[row, at] = self.made[least]
            ranks[:, width] = self.never
            parts[:, width] = -1
            ranks[row, at] = self.ranks_of(parts[row, at], parts[row, np.minimum(at + 1, width)])
            inner = at > 0
            r, c = row[inner], at[inner]
            ranks[r, c - 1] = self.ranks_of(parts[r, c - 1], parts[r, c])
        return done

    def merge_long(self, piece: bytes) -> list[int]:
        """Ids of a long piece: the same merges, taken from a heap over linked parts."""
        n, get = len(piece), self.rank.get
        part = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := get(part[i] * self.size + part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, left, right = heapq.heappop(heap)
            j = after[i]
            if part[i] != left or j >= n or part[j] != right:
                continue  # one of the parts has changed since
            part[i], part[j], k = int(self.made[r]), -1, after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if (r := get(part[i] * self.size + part[k])) is not None:
                    heapq.heappush(heap, (r, i, part[i], part[k]))
            if (h := before[i]) >= 0 and (r := get(part[h] * self.size + part[i])) is not None:
                heapq.heappush(heap, (r, h, part[h], part[i]))
        return [p for p in part if p >= 0]

    def learn(self, pieces: list[bytes]) -> None:
        """Put the ids of pieces into the cache, short ones by groups of like length."""
        found: list = [None] * len(pieces)
        groups: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            groups.setdefault(next((m for m in (8, 12, 16, 24, 40, SCAN_LIMIT) if len(p) <= m), 0), []).append(i)
        for width, members in groups.items():
            for k in range(0, len(members), 8192):
                some = members[k : k + 8192]
                raw = [pieces[i] for i in some]
                for i, got in zip(some, self.merge_short(raw) if width else map(self.merge_long, raw), strict=True):
                    found[i] = got
        first = len(self.slots)
        size = np.array([len(x) for x in found])
        last, used = first + len(found), self.used + int(size.sum())
        while len(self.at) < last:
            self.at, self.count = np.resize(self.at, 2 * len(self.at)), np.resize(self.count, 2 * len(self.count))
        while len(self.ids) < used:
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.used : used] = np.fromiter((i for x in found for i in x), np.int32, used - self.used)
        self.at[first:last] = self.used + np.cumsum(size) - size
        self.count[first:last] = size
        self.used = used
        self.slots.update(zip(pieces, range(first, last), strict=True))
        self.held += sum(map(len, pieces))

    def _encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without special tokens, and how many each has."""
        starts = piece_starts(data, bounds)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(bounds) - 1, np.int64)
        ends = np.append(starts[1:], len(data))
        pieces, inverse = distinct_pieces(data, starts, ends)
        slots = [self.slots.get(p) for p in pieces]
        if new := [p for p, x in zip(pieces, slots, strict=True) if x is None]:
            if len(self.slots) + len(new) > CACHE or self.held > CACHE_BYTES:
                self.forget()
                new = pieces
            self.learn(new)
            slots = [self.slots[p] for p in pieces]
        slot = np.array(slots)[inverse]
        count = self.count[slot]
        stop = np.append(0, np.cumsum(count))
        return ragged(self.ids, self.at[slot], count), np.diff(stop[np.searchsorted(starts, bounds)])

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts one after the other, and how many each has; null counts as empty."""
        data, offsets = flat(texts)
        ids, counts = [], []
        for i, j in chunks(offsets):
            part, bounds = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            raw = part.tobytes() if self.special else b""
            cuts = [(m, m + len(t), self.special[t]) for t in self.special for m in _places(raw, t.encode(), bounds)]
            if not cuts:
                got, n = self._encode(part, bounds)
            else:
                got, n = self._encode_around(part, bounds, sorted(cuts, key=lambda c: (c[0], c[0] - c[1])))
            ids.append(got)
            counts.append(n)
        return (np.concatenate(ids), np.concatenate(counts)) if ids else (np.zeros(0, np.int32), np.zeros(0, np.int64))

    def _encode_around(self, data: np.ndarray, bounds: np.ndarray, cuts: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """The same, where special tokens stand at ``cuts`` (from, to, id): each is a text by itself."""
        kept, edge = [], 0
        for c in cuts:
            if c[0] >= edge:
                kept.append(c)
                edge = c[1]
        edges = np.unique(np.concatenate([bounds, [c[0] for c in kept], [c[1] for c in kept]]))
        plain = np.ones(len(data), bool)
        for x, y, _ in kept:
            plain[x:y] = False
        before = np.append(0, np.cumsum(plain))
        got, n = self._encode(data[plain], before[edges])
        own = dict((c[0], c[2]) for c in kept)
        blocks = np.split(got, np.cumsum(n)[:-1]) if len(n) else []
        blocks = [np.array([own[x]], np.int32) if x in own else b for x, b in zip(edges[:-1].tolist(), blocks, strict=True)]
        size = np.append(0, np.cumsum([len(b) for b in blocks]))
        return np.concatenate([np.zeros(0, np.int32), *blocks]), np.diff(size[np.searchsorted(edges, bounds)])

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        return self.encode_column(pa.array([text]))[0].tolist()

    def decode_column(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The texts, in UTF-8, of lists of ids that stand one after the other."""
        values, at, size = self.token_bytes
        ids = np.where((ids < 0) | (ids >= self.size), self.size, ids)
        raw = ragged(values, at[ids], size[ids]).tobytes()
        stop = np.append(0, np.cumsum(size[ids]))[np.append(0, np.cumsum(counts))].tolist()
        return [raw[x:y].decode("utf-8", "replace").encode() for x, y in zip(stop, stop[1:], strict=False)]

    def decode(self, ids: list[int]) -> str:
        """The text of a list of ids."""
        return self.decode_column(np.array(ids, np.int64), np.array([len(ids)]))[0].decode()

    def decimals(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Each list of ids as decimal numbers joined by commas."""
        values, at, size = self.number_bytes
        raw = ragged(values, at[ids], size[ids]).tobytes()
        stop = np.append(0, np.cumsum(size[ids]))[np.append(0, np.cumsum(counts))].tolist()
        return [raw[x : max(x, y - 1)] for x, y in zip(stop, stop[1:], strict=False)]


def _places(raw: bytes, token: bytes, bounds: np.ndarray) -> list[int]:
    """Where ``token`` stands within a text."""
    out, at = [], raw.find(token)
    while at >= 0:
        if at + len(token) <= bounds[np.searchsorted(bounds, at, "right")]:
            out.append(at)
            at = raw.find(token, at + len(token))
        else:
            at = raw.find(token, at + 1)
    return out


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(ids, pa.int32()))


@lru_cache(2)
def vocabulary(spec: str) -> Vocabulary:
    """The vocabulary of a file's content, made once per worker."""
    return Vocabulary(spec)


def _mapped(df: DataFrame, spec: str, taken: str, added: list[tuple[str, T.DataType]], f: Callable[[Vocabulary, pa.Array], list[pa.Array]]) -> DataFrame:
    """Append columns made from column ``taken`` batch by batch."""
    spec_of = df.sparkSession.sparkContext.broadcast(spec)  # one vocabulary file, some MB whatever the input
    return append(df, taken, T.StructType([T.StructField(n, t) for n, t in added]), lambda column: f(vocabulary(spec_of.value), column), 256)


def encode(df: DataFrame, spec: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Append ``ids`` (array of int): the ids of each whole text.

    ``spec`` is the content of a byte-level vocabulary file.
    """

    def f(v: Vocabulary, column: pa.Array) -> list[pa.Array]:
        return [_lists(*v.encode_column(column))]

    return _mapped(df, spec, text, [(ids, T.ArrayType(T.IntegerType()))], f)


def decode(df: DataFrame, spec: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Append ``text``: what a column of ids stands for, special tokens included."""

    def f(v: Vocabulary, column: pa.Array) -> list[pa.Array]:
        counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        flat_ids = pc.fill_null(column.flatten(), -1).to_numpy(zero_copy_only=False)
        return [pa.array([x.decode() for x in v.decode_column(flat_ids, counts)], pa.string())]

    return _mapped(df, spec, ids, [(text, T.StringType())], f)


def digests(df: DataFrame, spec: str, text: str = "text") -> DataFrame:
    """Encode every text and decode it again, in one pass; only digests stay.

    Replaces the text by ``n_tokens``, ``ids_sha256`` (of the decimal ids joined
    by commas) and ``decoded_sha256`` (of the decoded text in UTF-8).
    """

    def f(v: Vocabulary, column: pa.Array) -> list[pa.Array]:
        ids, counts = v.encode_column(column)
        sha = lambda parts: pa.array([hashlib.sha256(x).hexdigest() for x in parts], pa.string())
        return [pa.array(counts, pa.int64()), sha(v.decimals(ids, counts)), sha(v.decode_column(ids, counts))]

    made = _mapped(df, spec, text, [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())], f)
    return made.select(*(col(c) for c in made.columns if c != text))


def public_spec(name: str = "byte_bpe_50k.json") -> str:
    """Content of a vocabulary file of the public tokenizers package."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode all of ``documents``; digests of both."""
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"), public_spec())
