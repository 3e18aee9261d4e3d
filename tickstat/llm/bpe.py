"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A rank file gives the merges. The texts of a batch are cut into pieces by the
usual pattern (vectorised over code points), equal pieces are folded by hash,
and all new pieces of the batch are encoded together: one flat array holds
their symbols, an inverted index lists the positions of each symbol pair, and
the merges are replayed in rank order over the whole array. A merge touches
only its positions and their two neighbours, whose pairs are looked up again.
The pieces' ids then fill the texts by one gather.

The index is built for one band of ranks at a time (so that it follows the
pairs that merges make), and inside a band new pairs join their rank's list.
Merges of one rank are made left to right. Where a merge makes a pair of lower
rank than its own, that piece alone is encoded again pair by pair, so every
piece gets exactly the ids of the rank file, whatever its order. A piece that
is itself a token is that token, as the library has it.

Scale: nothing is shuffled. A task holds one part of about ``PART`` bytes of
text at a time: parts are whole rows, and a longer text is cut where a piece
surely ends (``parts``), so that one very long text needs no more memory than
many short ones; only a single piece is never cut. New pieces are replayed
``REPLAY`` bytes at a time. The encoded pieces kept between parts are bounded by
``CACHE`` pieces and ``CACHE_IDS`` ids. Pieces are known by a hash and told
apart by a second one; where that differs, the piece is encoded by itself.
Rows of ids leave in batches of about ``OUT`` bytes of text (one row at least).

Null texts count as empty: no ids, and the digests of no bytes. Texts are
encoded whole. Repeated rows give equal rows, empty tables empty results,
further columns are ignored by ``encode``.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, functions as F

from . import blocks as B

RANKS = "byte_bpe_multi_50k.tiktoken"
PART = 1 << 20
REPLAY = 1 << 20
CACHE = 600_000
CACHE_IDS = 2 << 20
OUT = 2 << 20
NONE = np.int32(2**31 - 1)

_OTHER, _LETTER, _NUMBER, _SPACE, _LIMIT = range(5)
#: Between rows; a code point that no text holds.
_BREAK = 0x110000


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point, as the pattern's \\p{L}, \\p{N} and \\s see it."""
    out = np.zeros(_BREAK + 1, np.uint8)
    for lo in range(0, _BREAK, 1 << 12):  # in small parts, as workers keep the memory of large ones
        if 0xD800 <= lo < 0xE000:
            continue
        part = "".join(map(chr, range(lo, lo + (1 << 12))))
        for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\p{White_Space}+")):
            for m in regex.finditer(pattern, part):
                out[lo + m.start() : lo + m.end()] = kind
    out[_BREAK] = _LIMIT
    return out


def cut(points: np.ndarray) -> np.ndarray:
    """Places where pieces start, over the code points of rows that each end with ``_BREAK``.
    The break is a piece of its own."""
    kind = _classes()[points]
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    space = kind == _SPACE
    run = np.flatnonzero(start & space)
    end = np.flatnonzero(space & np.concatenate([~space[1:], [True]])) + 1
    inner = kind[np.minimum(end, n - 1)] != _LIMIT
    run, end = run[inner], end[inner]
    # the last white space of a run is apart; a plain space goes to what follows
    start[end - 1] = True
    plain = points[end - 1] == 0x20
    start[end[plain]] = False
    # contractions: an apostrophe alone at a start, with the letters s, t, m, d, re, ve or ll
    at = np.flatnonzero((points == 0x27) & start)
    at = at[(at + 2 < n)]
    at = at[kind[at + 1] == _LETTER]
    one, two = points[at + 1], points[at + 2]
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    for sel, size in ((short, 2), (long & ~short, 3)):
        p = at[sel]
        start[p + 1] = False
        q = p + size
        start[q[kind[q] == _LETTER]] = True
    return np.flatnonzero(start)


class Ranks:
    """A rank file: tokens, and the rank of every pair of tokens whose bytes together are a token."""

    def __init__(self, path: str):
        self.tokens: list[bytes] = []
        with open(path, "rb") as file:
            for line in file:
                if line.strip():
                    token, rank = line.split()
                    self.tokens += [b""] * (int(rank) + 1 - len(self.tokens))
                    self.tokens[int(rank)] = base64.b64decode(token)
        self.rank = {t: r for r, t in enumerate(self.tokens) if t}
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        keys, merged = array("q"), array("i")  # flat, as workers keep the memory of many small objects
        for r, t in enumerate(self.tokens):
            for i in range(1, len(t)):
                a, b = self.rank.get(t[:i]), self.rank.get(t[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    merged.append(r)
        order = np.argsort(np.frombuffer(keys, np.int64)) if keys else np.zeros(0, np.int64)
        self.keys, self.merged = np.array(keys, np.int64)[order], np.array(merged, np.int32)[order]
        # open addressing table for the lookups
        size = 1 << max(4, (4 * len(self.keys)).bit_length())
        self.mask = size - 1
        self.slot_key, self.slot_rank = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        todo, at = np.arange(len(self.keys)), self._slot(self.keys)
        while len(todo):
            free = self.slot_key[at] == -1
            _, first = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.slot_key[at[put]], self.slot_rank[at[put]] = self.keys[todo[put]], self.merged[todo[put]]
            rest = np.ones(len(todo), bool)
            rest[put] = False
            todo, at = todo[rest], (at[rest] + 1) & self.mask
        lengths = np.array([len(t) for t in self.tokens])
        self.ends = np.concatenate([[0], np.cumsum(lengths)])
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        codes = self.bytes
        h = _piece_hash(codes, self.ends[:-1], self.ends[1:])
        order = np.argsort(h)
        self.whole_hash, self.whole_id = h[order], order.astype(np.int32)
        self.whole_check = _check_hash(codes, self.ends[:-1], self.ends[1:])[order]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (B.mix(keys.view(np.uint64)) & np.uint64(self.mask)).astype(np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where its bytes are no token."""
        key = a.astype(np.int64) << 32 | b
        out = np.full(len(key), NONE, np.int32)
        at, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            found = self.slot_key[at]
            hit = found == key[todo]
            out[todo[hit]] = self.slot_rank[at[hit]]
            go = ~hit & (found != -1)
            todo, at = todo[go], (at[go] + 1) & self.mask
        return out

    def plain(self, piece: bytes) -> list[int]:
        """Ids of one piece, pair by pair: the pair of lowest rank first, the leftmost of equal ones."""
        n = len(piece)
        end = list(range(1, n + 1))  # where the part that starts here ends; 0 once it's merged away
        before = list(range(-1, n - 1))
        rank = lambda i: self.rank.get(piece[i : end[end[i]]]) if end[i] < n else None
        heap = [(r, i, end[end[i]]) for i in range(n - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not end[i] or end[i] >= n or end[end[i]] != stop:
                continue  # one of the two parts has changed since
            gone = end[i]
            end[i], end[gone] = stop, 0
            if stop < n:
                before[stop] = i
            for j in (before[i], i):
                if j >= 0 and (r := rank(j)) is not None:
                    heapq.heappush(heap, (r, j, end[end[j]]))
        out, i = [], 0
        while i < n:
            out.append(self.rank[piece[i : end[i]]])
            i = end[i]
        return out


@lru_cache(maxsize=1)
def ranks(path: str) -> Ranks:
    return Ranks(path)


def _piece_hash(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return B.mix(B.span_hashes(codes, start, end) + (end - start).astype(np.uint64))


#: Another order of the bytes, for the second hash.
_OTHER_BYTES = np.random.default_rng(77).permutation(256).astype(np.uint8)


def _check_hash(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return _piece_hash(_OTHER_BYTES[codes], start, end)


def _last_cut(points: np.ndarray) -> int:
    """The last place of a text's part where a piece starts whatever stands
    before or behind the part; 0 if there is none. Such a place lies between two
    classes, not behind white space (which may join what follows) and not
    between an apostrophe and a letter (a contraction)."""
    kind = _classes()[points]
    sure = (kind[1:] != kind[:-1]) & (kind[:-1] != _SPACE) & ~((points[:-1] == 0x27) & (kind[1:] == _LETTER))
    at = np.flatnonzero(sure)
    return int(at[-1]) + 1 if len(at) else 0


def parts(raw: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """A text's bytes in parts of about ``limit`` bytes; pieces never cross them."""
    lo, size = 0, limit
    while len(raw) - lo > size:
        hi = lo + size
        while raw[hi] & 0xC0 == 0x80:
            hi -= 1
        for tail in (1 << 12, size):  # a short look at the end, then the whole part
            a = max(lo, hi - tail)
            while raw[a] & 0xC0 == 0x80:
                a += 1
            points = np.frombuffer(raw[a:hi].tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
            found = _last_cut(points)
            if found or a == lo:
                break
        if not found:
            size *= 2
            continue
        hi -= len(points[found:].tobytes().decode("utf-32-le").encode("utf-8"))
        yield raw[lo:hi]
        lo, size = hi, limit
    yield raw[lo:]


def replay(data: np.ndarray, limits: np.ndarray, table: Ranks, bands: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """(ids, limits) of pieces given as bytes; the merges of the rank file in order, over all pieces at once."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int32), np.zeros(len(limits), np.int64)
    tok = table.byte[data]
    nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    ends = limits[1:][limits[1:] > limits[:-1]] - 1
    last = np.zeros(n + 1, bool)
    last[ends] = True
    nxt[ends] = n
    prv[limits[:-1][limits[1:] > limits[:-1]]] = -1
    pair = np.full(n + 1, NONE, np.int32)
    inner = np.flatnonzero(~last[:n])
    pair[inner] = table.pair(tok[inner], tok[inner + 1])
    alive = np.ones(n, bool)
    odd = np.zeros(n, bool)  # positions beside a merge out of order
    ranks_here = pair[pair != NONE]
    cuts = np.unique(np.concatenate([np.quantile(ranks_here, np.linspace(0, 1, bands), method="lower") if len(ranks_here) else np.zeros(0), [0, len(table.tokens)]])).astype(np.int64)
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        at = np.flatnonzero((pair >= lo) & (pair < hi))
        if not len(at):
            continue
        # the inverted index of this band: rank -> positions
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(where: np.ndarray) -> None:
            r = pair[where]
            order = np.argsort(r, kind="stable")
            where, r = where[order], r[order]
            first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            for k, group in zip(r[first].tolist(), np.split(where, first[1:])):
                if k in index:
                    index[k].append(group)
                else:
                    index[k] = [group]
                    heapq.heappush(heap, k)

        add(at)
        while heap:
            rank = heapq.heappop(heap)
            groups = index.pop(rank)
            p = groups[0] if len(groups) == 1 else np.unique(np.concatenate(groups))
            p = p[pair[p] == rank]
            if not len(p):
                continue
            if len(p) > 1:  # neighbours share a symbol: left to right, every other one of a run
                touch = nxt[p[:-1]] == p[1:]
                if touch.any():
                    head = np.flatnonzero(np.concatenate([[True], ~touch]))
                    p = p[(np.arange(len(p)) - np.repeat(head, np.diff(np.append(head, len(p))))) % 2 == 0]
            right = nxt[p]
            after = nxt[right]
            tok[p] = rank
            alive[right] = False
            pair[right] = NONE
            nxt[p] = after
            inside = after < n
            prv[after[inside]] = p[inside]
            new = np.full(len(p), NONE, np.int32)
            new[inside] = table.pair(tok[p[inside]], tok[after[inside]])
            pair[p] = new
            left = prv[p]
            has = left >= 0
            left = left[has]
            before = table.pair(tok[left], tok[p[has]])
            pair[left] = before
            low = new < rank
            if low.any():
                odd[p[low]] = True
            low = before < rank
            if low.any():
                odd[left[low]] = True
            more = np.concatenate([p[(new < hi)], left[before < hi]])
            if len(more):
                add(np.unique(more))
    which = np.searchsorted(limits, np.flatnonzero(odd), side="right") - 1
    kept = np.flatnonzero(alive)
    counts = np.diff(np.searchsorted(kept, limits))
    ids = tok[kept]
    if len(which):
        parts, out = np.split(ids, np.cumsum(counts)[:-1]), []
        again = set(which.tolist())
        for i, part in enumerate(parts):
            out.append(np.array(table.plain(data[limits[i] : limits[i + 1]].tobytes()), np.int32) if i in again else part)
        ids, counts = np.concatenate(out), np.array([len(x) for x in out])
    return ids, np.concatenate([[0], np.cumsum(counts)])


def gather(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[start[i] : start[i] + size[i]] one after another."""
    total = np.cumsum(size)
    if not len(total) or not total[-1]:
        return values[:0]
    return values[np.arange(total[-1]) + np.repeat(start - np.concatenate([[0], total[:-1]]), size)]


class Encoder:
    """Encodes parts of texts; keeps the pieces seen, up to a bound."""

    def __init__(self, table: Ranks):
        self.table = table
        self._empty()

    def _empty(self) -> None:
        self.hash = self.check = np.zeros(0, np.uint64)
        self.start, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _learn(self, codes: np.ndarray, h: np.ndarray, check: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Adds pieces that are not known yet; h is in ascending order."""
        own, counts = [], []
        size = end - start
        group = np.cumsum(size) // REPLAY
        for which in np.split(np.arange(len(h)), np.flatnonzero(np.diff(group)) + 1):
            ids, limits = replay(gather(codes, start[which], size[which]), np.concatenate([[0], np.cumsum(size[which])]), self.table)
            first, count = limits[:-1].copy(), np.diff(limits)
            at = np.minimum(np.searchsorted(self.table.whole_hash, h[which]), len(self.table.whole_hash) - 1)
            token = np.flatnonzero(self.table.whole_hash[at] == h[which])
            token = token[self.table.whole_check[at[token]] == check[which[token]]]
            ids = np.concatenate([ids, self.table.whole_id[at[token]]])
            first[token], count[token] = len(ids) - len(token) + np.arange(len(token)), 1
            own.append(gather(ids, first, count))
            counts.append(count)
        count = np.concatenate(counts)
        at = np.searchsorted(self.hash, h)
        self.start = np.insert(self.start, at, len(self.ids) + np.cumsum(count) - count)
        self.size = np.insert(self.size, at, count)
        self.check = np.insert(self.check, at, check)
        self.hash = np.insert(self.hash, at, h)
        self.ids = np.concatenate([self.ids, *own])

    def encode(self, data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, limits of the rows) of rows lo..hi; a longer block goes by parts."""
        ids, limits = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        done = 0
        for a, b in B.row_blocks(offsets[lo : hi + 1], PART):
            a, b = a + lo, b + lo
            raw = data[int(offsets[a]) : int(offsets[b])]
            for part in parts(raw, PART) if b == a + 1 else (raw,):
                ends = offsets[a + 1 : b + 1] - offsets[a] if b > a + 1 else np.array([len(part)])
                own, own_limits = self._part(part, ends)
                ids.append(own)
                if b > a + 1:
                    limits.append(done + own_limits[1:])
                done += len(own)
            if b == a + 1:
                limits.append(np.array([done]))
        return np.concatenate(ids), np.concatenate(limits)

    def _part(self, raw: np.ndarray, row_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, limits of the rows) of one part; its rows end at the given bytes."""
        rows = len(row_ends)
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
        byte_at = np.zeros(len(points) + 1, np.int32)
        np.cumsum(width, out=byte_at[1:])
        row_end = np.searchsorted(byte_at, row_ends)
        start = cut(np.insert(points, row_end, _BREAK))
        n_points = len(points)
        del points, width
        # back to places without the breaks
        breaks = row_end + np.arange(rows)
        start = start[~np.isin(start, breaks)]
        start = start - np.searchsorted(breaks, start)
        limits = np.searchsorted(start, np.concatenate([[0], row_end]))
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(rows + 1, np.int64)
        b0, b1 = byte_at[start].astype(np.int64), byte_at[np.concatenate([start[1:], [n_points]])].astype(np.int64)
        del byte_at, start
        h, check = _piece_hash(raw, b0, b1), _check_hash(raw, b0, b1)
        distinct, first, which = np.unique(h, return_index=True, return_inverse=True)
        del h
        known = np.isin(distinct, self.hash, assume_unique=True)
        if len(self.hash) and (len(self.hash) + (~known).sum() > CACHE or len(self.ids) > CACHE_IDS):
            self._empty()
            known[:] = False
        new = first[~known]
        if len(new):
            self._learn(raw, distinct[~known], check[new], b0[new], b1[new])
        at = np.searchsorted(self.hash, distinct)[which]
        size = self.size[at]
        other = np.flatnonzero(self.check[at] != check)
        del which, check, distinct, first
        if not len(other):
            ends = np.concatenate([[0], np.cumsum(size)])
            return gather(self.ids, self.start[at], size), ends[limits]
        # pieces whose first hash is another piece's: each by itself
        place, more, n = self.start[at], [], len(self.ids)
        for i in other.tolist():
            piece = raw[b0[i] : b1[i]].tobytes()
            own = [self.table.rank[piece]] if piece in self.table.rank else self.table.plain(piece)
            place[i], size[i] = n, len(own)
            more += own
            n += len(own)
        ends = np.concatenate([[0], np.cumsum(size)])
        return gather(np.concatenate([self.ids, np.array(more, np.int32)]), place, size), ends[limits]


def decode(ids: np.ndarray, table: Ranks) -> np.ndarray:
    """Bytes of ids."""
    return gather(table.bytes, table.ends[ids], table.ends[ids + 1] - table.ends[ids])


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One encoder for each worker process, so that pieces stay known between its tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(ranks(path))
    return _ENCODERS[path]


def encode(docs: DataFrame, *, doc_id="doc_id", text="text", path: str | None = None, digests: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (array<int>); or, with
    ``digests``, the SHA-256 of the ids and of the decoded bytes in their place."""
    path = path or public_tokenizers.path(RANKS)
    key_type = docs.schema[doc_id].dataType.simpleString()

    def digest(coder: Encoder, data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, str, str]]:
        """(number of ids, digest of the ids, digest of the decoded bytes) of each row, part by part."""
        for a, b in B.row_blocks(offsets[lo : hi + 1], PART):
            raw = data[int(offsets[lo + a]) : int(offsets[lo + b])]
            long = b == a + 1
            n, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()
            for part in parts(raw, PART) if long else (raw,):
                ids, limits = coder._part(part, np.array([len(part)]) if long else offsets[lo + a + 1 : lo + b + 1] - offsets[lo + a])
                ends = np.concatenate([[0], np.cumsum(coder.table.ends[ids + 1] - coder.table.ends[ids])])[limits]
                packed, back = ids.astype("<u4").tobytes(), decode(ids, coder.table).tobytes()
                if long:
                    n += len(ids)
                    of_ids.update(packed)
                    of_bytes.update(back)
                else:
                    sha = lambda x: hashlib.sha256(x).hexdigest()
                    for i in range(b - a):
                        yield int(limits[i + 1] - limits[i]), sha(packed[4 * limits[i] : 4 * limits[i + 1]]), sha(back[ends[i] : ends[i + 1]])
            if long:
                yield n, of_ids.hexdigest(), of_bytes.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(path)
        for batch in batches:
            data, offsets = B.text_bytes(batch.column(1))
            for lo, hi in B.row_blocks(offsets, OUT):
                key = batch.column(0).slice(lo, hi - lo)
                if digests:
                    n, a, b = zip(*digest(coder, data, offsets, lo, hi))
                    yield pa.RecordBatch.from_arrays([key, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                    continue
                ids, limits = coder.encode(data, offsets, lo, hi)
                yield pa.RecordBatch.from_arrays([key, pa.array(np.diff(limits)), pa.ListArray.from_arrays(pa.array(limits, pa.int32()), pa.array(ids, pa.int32()))], names=["doc_id", "n_tokens", "ids"])
                del ids, limits
                B.release()

    rest = "ids array<int>" if not digests else "ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(doc_id), F.col(text).cast("string")).mapInArrow(B.released(run), f"doc_id {key_type}, n_tokens bigint, {rest}")


def decoded(encoded: DataFrame, *, path: str | None = None) -> DataFrame:
    """doc_id and text of encoded rows (ids null: an empty text)."""
    path = path or public_tokenizers.path(RANKS)
    key_type = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks(path)
        for batch in batches:
            texts = [decode(np.array(x.as_py() or [], np.int64), table).tobytes().decode("utf-8", "replace") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {key_type}, text string")
