"""N-gram Jaccard join: blocked sparse product of the document by n-gram
incidence matrix, with bounds from the set sizes.

A document's row is its set of distinct word n-gram hashes (64 bits). Two
documents link when |A and B| / |A or B| is at least the threshold. The result
is exact: the bounds below only discard what cannot link.

1. Equal rows are collapsed to their smallest id (partial aggregation, so a
   group of copies shrinks before the shuffle).
2. The columns are cut by hash into blocks of about 32 to 64 columns of a row
   (a power of two of blocks, chosen by the row's size; rows close under the
   next power are also cut for that one, so any two rows that may link have
   one cut in common). If two rows reach the threshold as a whole, they reach
   it inside one block at least. In that block they share one of the first
   n - ceil(t n) + 1 columns of each, so only those are dealt out by column.
   A dealt entry carries the block's size and a 128-bit parity map of the
   block's columns: the maps of two rows differ in at most as many bits as the
   blocks differ in columns, so pairs beyond the size-derived bound go.
   A column shared by many rows is handled in order with leaders: a row belongs
   to a leader very near to it and joins all leaders within its bound plus that
   nearness, which keeps all rows that may link connected without looking at
   all pairs.
3. The connected groups of these candidates get their whole rows. Each row's
   overlap with the group's smallest row is counted; that settles copies of one
   text in one pass. Where rows stay apart, the group is cut into row blocks
   and each pair of blocks gets its overlap counts as a sum of products of
   incidence blocks.
4. The links found give the components by contraction.

Nothing is capped, sampled or collected: groups of any size go through the
same steps, split by row blocks that are bounded in rows and in columns; rows of
a large group meet its smallest row in parts. Only tables of a checked number of
rows are broadcast; beyond it they are joined by a shuffle.

Words are runs of anything but space and the controls 9 to 13, with ASCII
letters lower-cased. A text of fewer words than n has its whole word sequence
as its only n-gram; null, empty and blank texts have an empty set and link
with nothing. Rows repeated with one id and text count as copies. A null id is
kept in the result and gets the class of its copies, if any. Further columns
are ignored. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import blocks as B
from .components import components
from .store import sent, stored, told_apart, without

#: Columns of a row in one block: at least this many, under twice as many.
BLOCK = 32
#: Rows of a candidate group in one row block, and their columns (64 MB), on average.
ROWS = 1024
GRAMS = 8 << 20
#: Rows of a group that meet one copy of its smallest row.
SALTED = 64
#: Lists up to this length are compared pair by pair, longer ones by leaders.
SMALL_LIST = 32
#: Columns of one incidence block.
WIDTH = 1024
CHUNK = 1 << 14
#: Candidates a task gathers before it folds them into a spanning forest.
FOLD = 1 << 19
_SALT = np.uint64(0xD6E8FEB86659FD93)


def _sets(data, offsets, lo: int, hi: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes sorted within each row, limits of the rows)."""
    row, h, _, _ = B.words(data, offsets, lo, hi, B.SPACED)
    limits = B.row_limits(row, hi - lo)
    counts = np.diff(limits)
    g = B.grams(h, k)
    whole = row[: len(g)] == row[k - 1 :] if len(g) else np.zeros(0, bool)
    g, d = g[whole], row[: len(g)][whole]
    for m in range(1, k):  # shorter rows: the whole sequence
        short = np.flatnonzero(counts == m)
        if len(short):
            at = limits[:-1][short]
            g = np.concatenate([g, B.grams(h, m)[at]])
            d = np.concatenate([d, short])
    order = np.lexsort((g, d))
    g, d = g[order], d[order]
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
    return g[keep], np.searchsorted(d[keep], np.arange(hi - lo + 1))


def _sums(values: np.ndarray, limits: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[limits[1:]] - total[limits[:-1]]


def _parity_maps(g: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """128 bits for each range of hashes: bit b tells whether an odd number of them has the place b."""
    place = B.mix(g ^ _SALT) & np.uint64(127)
    out = np.empty((len(limits) - 1, 2), np.uint64)
    for half in (0, 1):
        total = np.zeros(len(g) + 1, np.uint64)
        own = (place >> np.uint64(6)) == half
        np.bitwise_xor.accumulate(np.where(own, np.uint64(1) << (place & np.uint64(63)), np.uint64(0)), out=total[1:])
        out[:, half] = total[limits[1:]] ^ total[limits[:-1]]
    return out


def _gap(maps: np.ndarray, other: np.ndarray) -> np.ndarray:
    """In how many bits parity maps differ; never more than the sets differ in members."""
    return np.bitwise_count(maps ^ other).sum(axis=-1, dtype=np.int64)


def _binaries(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One binary for each row: counts[i] values."""
    ends = np.concatenate([[0], np.cumsum(counts)]) * values.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())]).cast(pa.binary())


def _values(column, dtype) -> tuple[np.ndarray, np.ndarray]:
    """(all values, row limits) of a column of binaries."""
    column = pa.array(column).cast(pa.large_binary()) if not isinstance(column, pa.Array) else column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data.view(dtype), (ends - ends[0]) // np.dtype(dtype).itemsize


def _least(n: np.ndarray, num: int, den: int) -> np.ndarray:
    return -(-(n * num) // den)


def _block_entries(g: np.ndarray, limits: np.ndarray, num: int, den: int) -> tuple[np.ndarray, ...]:
    """What is dealt out of each row: (row of each block, block size, parity map, entries in the block), and the entries' keys."""
    n = np.diff(limits)
    level = np.zeros(len(n), np.int64)
    np.floor(np.log2(np.maximum(n, 1) / BLOCK), out=(raw := np.zeros(len(n))))
    level = np.maximum(raw, 0).astype(np.int64)
    out = []
    for extra in (0, 1):
        rows = np.flatnonzero((n > 0) if not extra else (n > 0) & (n * den >= num * (2 * BLOCK << level)))
        if not len(rows):
            continue
        lev = level[rows] + extra
        size = n[rows]
        ends = np.cumsum(size)
        pick = np.arange(ends[-1]) + np.repeat(limits[:-1][rows] - np.concatenate([[0], ends[:-1]]), size)
        own, e_level = g[pick], np.repeat(lev, size)
        block = np.where(e_level > 0, own >> (np.uint64(64) - np.maximum(e_level, 1).astype(np.uint64)), np.uint64(0)).astype(np.int64)
        first_block = np.concatenate([[0], np.cumsum(1 << lev)])
        at = np.repeat(first_block[:-1], size) + block
        counts = np.bincount(at, minlength=first_block[-1])
        stop = np.concatenate([[0], np.cumsum(counts)])
        maps = _parity_maps(own, stop)
        p = np.where(counts > 0, counts - _least(counts, num, den) + 1, 0)
        rank = np.arange(len(own)) - np.repeat(stop[:-1], counts)
        chosen = rank < np.repeat(p, counts)
        keys = B.mix(own[chosen] + e_level[chosen].astype(np.uint64) * _SALT)
        full = counts > 0
        out.append((np.repeat(rows, 1 << lev)[full], counts[full], maps[full], p[full], keys))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros((0, 2), np.uint64), z, z.astype(np.uint64)
    if len(out) == 1:
        return out[0]
    # blocks in row order, entries in block order
    row, size, maps, p, keys = (np.concatenate(x) for x in zip(*out))
    order = np.argsort(row, kind="stable")
    start = np.concatenate([[0], np.cumsum(p)])[:-1]
    total = np.cumsum(p[order])
    pick = np.arange(total[-1]) + np.repeat(start[order] - np.concatenate([[0], total[:-1]]), p[order])
    return row[order], size[order], maps[order], p[order], keys[pick]


def _digest(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Per document: id, set size, set fingerprint, and its entries to deal out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.text_bytes(batch.column(1))
            for lo, hi in B.row_blocks(offsets):
                g, limits = _sets(data, offsets, lo, hi, k)
                row, size, maps, p, keys = _block_entries(g, limits, num, den)
                blocks = np.bincount(row, minlength=hi - lo)
                per_row = np.bincount(row, weights=p, minlength=hi - lo).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(limits)), pa.array(_sums(B.mix(g), limits).view(np.int64)), pa.array(_sums(B.mix(g ^ _SALT), limits).view(np.int64)),
                     _binaries(size.astype(np.int16), blocks), _binaries(p.astype(np.int16), blocks), _binaries(maps.ravel(), 2 * blocks), _binaries(keys, per_row)],
                    names=["id", "n", "f1", "f2", "sizes", "dealt", "maps", "keys"])

    return docs.mapInArrow(B.released(run), "id bigint, n bigint, f1 bigint, f2 bigint, sizes binary, dealt binary, maps binary, keys binary")


def _deal(classes: DataFrame) -> DataFrame:
    """(key, id, map, map2, sizes) for each entry; sizes: the row's size times 65536 plus the block's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                ids, n = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                size, stop = _values(part.column(2), np.int16)
                p, _ = _values(part.column(3), np.int16)
                maps = _values(part.column(4), np.uint64)[0].reshape(-1, 2)
                keys, _ = _values(part.column(5), np.uint64)
                row = np.repeat(np.arange(len(ids)), np.diff(stop))
                packed = n[row] * 65536 + size
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(np.repeat(ids[row], p)), *(pa.array(np.repeat(maps[:, half], p).view(np.int64)) for half in (0, 1)), pa.array(np.repeat(packed, p))],
                    names=["key", "id", "map", "map2", "sizes"])

    return classes.select("id", "n", "sizes", "dealt", "maps", "keys").mapInArrow(B.released(run), "key bigint, id bigint, map bigint, map2 bigint, sizes bigint")


class _Lists:
    """Candidates among entries that come sorted by key. A list longer than a
    chunk is handled chunk by chunk; only its leaders stay in memory."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.key, self.leaders = None, None

    def _reach(self, size: np.ndarray) -> np.ndarray:
        """Most columns in which a block of this size differs from one it links with."""
        top = size * self.den // self.num
        return (size + top) * (self.den - self.num) // (self.den + self.num)

    def pairs(self, key, ids, maps, sizes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Short lists: all pairs within the bounds, by distance in the list."""
        n, size = sizes >> 16, sizes & 65535
        for step in range(1, SMALL_LIST):
            same = np.flatnonzero(key[step:] == key[:-step])
            if not len(same):
                return
            a, b = same, same + step
            num, den = self.num, self.den
            ok = np.minimum(n[a], n[b]) * den >= np.maximum(n[a], n[b]) * num
            ok &= _gap(maps[a], maps[b]) * (den + num) <= (size[a] + size[b]) * (den - num)
            yield ids[a[ok]], ids[b[ok]]

    def long(self, ids, maps, sizes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """A long list, or the next chunk of it; the leaders so far are used first."""
        size = sizes & 65535
        # a row belongs to a leader within a quarter of its reach; whatever links
        # with it lies within its own reach and that quarter of the leader
        reach = self._reach(size)
        near_by = reach // 4
        wide = reach + reach * self.den // (4 * self.num) + 1
        open_ = np.ones(len(ids), bool)
        label = np.arange(len(ids))  # rows already connected have one label
        lead_ids, lead_maps = self.leaders or (np.zeros(0, np.int64), np.zeros((0, 2), np.uint64))
        new_ids, new_maps = [], []

        def join(near: np.ndarray) -> np.ndarray:
            """Gives the rows one label; returns the labels they had."""
            own = label[near]
            if (own == own[0]).all():
                return own[:1]
            had = np.unique(own)
            label[np.isin(label, had)] = had[0]
            return had

        for i in range(len(lead_ids)):
            gap = _gap(maps, lead_maps[i])
            near = np.flatnonzero(gap <= wide)
            open_ &= gap > near_by
            if len(near):
                had = join(near)
                yield ids[had], np.full(len(had), lead_ids[i])
        while len(left := np.flatnonzero(open_)):
            at = left[0]
            gap = _gap(maps, maps[at])
            open_ &= gap > near_by
            open_[at] = False
            new_ids.append(ids[at])
            new_maps.append(maps[at])
            had = join(np.flatnonzero(gap <= wide))
            if len(had) > 1:
                yield ids[had[1:]], np.full(len(had) - 1, ids[had[0]])
        self.leaders = (np.concatenate([lead_ids, np.array(new_ids, np.int64)]), np.concatenate([lead_maps, np.array(new_maps, np.uint64).reshape(-1, 2)]))

    def feed(self, key, ids, maps, sizes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Whole lists (or, for the key kept open, a further chunk)."""
        if not len(key):
            return
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        counts = np.diff(np.concatenate([starts, [len(key)]]))
        big = counts > SMALL_LIST
        big[0] |= self.key is not None and key[0] == self.key
        for s, c in zip(starts[big], counts[big]):
            if self.key is None or key[s] != self.key:
                self.key, self.leaders = key[s], None
            yield from self.long(ids[s : s + c], maps[s : s + c], sizes[s : s + c])
        few = np.repeat(~big & (counts > 1), counts)
        yield from self.pairs(key[few], ids[few], maps[few], sizes[few])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same connected groups, one for each node but the smallest of its group."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    rest = label != np.arange(len(nodes))
    return nodes[rest], nodes[label[rest]]


def _candidates(entries: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) that keep connected whatever may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, rest = _Lists(num, den), None

        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out(found, last=False) -> Iterator[pa.RecordBatch]:
            nonlocal size
            for a, b in found:
                held.append((a, b))
                size += len(a)
                if size >= FOLD:
                    held[:] = [forest(*(np.concatenate(x) for x in zip(*held)))]
                    size = len(held[0][0])
                    if size >= FOLD // 2:
                        yield emit()
            if last and size:
                held[:] = [forest(*(np.concatenate(x) for x in zip(*held)))]
                yield emit()

        def emit() -> pa.RecordBatch:
            nonlocal size
            a, b = held.pop()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            key, ids, first, second, sizes = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            now = [key, ids, np.stack([first, second], axis=1).view(np.uint64), sizes]
            if rest is not None:
                now = [np.concatenate([r, x]) for r, x in zip(rest, now)]
            last = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
            if len(now[0]) - last > CHUNK:
                last = len(now[0])
                lists_key = now[0][-1]
            else:
                lists_key = None
            yield from out(lists.feed(*(x[:last] for x in now)))
            if lists_key is not None and lists.key != lists_key:
                raise AssertionError("an open list is a long one")
            rest = [x[last:] for x in now]
        yield from out(lists.feed(*rest) if rest is not None else (), last=True)

    return entries.repartition("key").sortWithinPartitions("key").mapInArrow(B.released(run), "a bigint, b bigint")


def _whole(docs: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """(id, n, grams) of the documents in ``groups``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.text_bytes(batch.column(1))
            for lo, hi in B.row_blocks(offsets):
                g, limits = _sets(data, offsets, lo, hi, k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(limits)), _binaries(g, np.diff(limits))], names=["id", "n", "grams"])

    return docs.join(sent(groups.select(F.col("node").alias("id"))), "id", "left_semi").select("id", "text").mapInArrow(B.released(run), "id bigint, n bigint, grams binary")


def _with_first(rows: DataFrame) -> DataFrame:
    """Overlap of each row with its group's smallest: adds ``shared``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, xs = _values(batch.column(4), np.uint64)
            y, ys = _values(batch.column(5), np.uint64)
            shared = np.array([np.isin(x[xs[i] : xs[i + 1]], y[ys[i] : ys[i + 1]], assume_unique=True).sum() for i in range(batch.num_rows)], np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(shared)], names=["comp", "id", "n", "first_n", "shared"])

    return rows.mapInArrow(B.released(run), "comp bigint, id bigint, n bigint, first_n bigint, shared bigint")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Overlap counts of all rows: the incidence matrix times its transpose, summed over column blocks."""
    sizes = np.array([len(s) for s in sets])
    columns, at, count = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    # a column of one row adds to no overlap but the row's own
    shared = count[at] > 1
    row, at = row[shared], (np.cumsum(count > 1) - 1)[at[shared]]
    columns = columns[count > 1]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    total = np.zeros((len(sets), len(sets)), np.float32)  # counts below 2 ** 24 are exact
    for lo in range(0, len(columns), WIDTH):
        a, b = np.searchsorted(at, [lo, lo + WIDTH])
        part = np.zeros((len(sets), WIDTH), np.float32)
        part[row[a:b], at[a:b] - lo] = 1
        total += part @ part.T
    np.fill_diagonal(total, sizes)
    return total


def _in_blocks(num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids = table["id"].to_numpy()
        values, limits = _values(table["grams"].combine_chunks() if table["grams"].num_chunks != 1 else table["grams"].chunk(0), np.uint64)
        n = np.diff(limits)
        shared = overlaps([values[limits[i] : limits[i + 1]] for i in range(len(ids))])
        linked = np.empty(shared.shape, bool)
        for i in range(len(ids)):  # |A and B| / |A or B| >= num / den, in integers
            linked[i] = shared[i].astype(np.int64) * (den + num) >= num * (n[i] + n)
        del shared
        label = np.arange(len(ids))
        while True:  # the smallest row reachable inside this block
            new = np.array([label[linked[i]].min(initial=label[i]) for i in range(len(ids))])
            new = new[new]
            if (new == label).all():
                break
            label = new
        keep = label != np.arange(len(ids))
        return pa.table({"a": ids[keep], "b": ids[label[keep]]})

    return run


def links(docs: DataFrame, digest: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(a, b): enough links of at least the threshold, between smallest ids of
    equal sets, to connect every linked pair."""
    entries = _deal(digest.where("n > 0 and id is not null").groupBy("n", "f1", "f2").agg(F.min("id").alias("id"), F.min_by(F.struct("sizes", "dealt", "maps", "keys"), "id").alias("e")).select("id", "n", "e.*"))
    groups = stored(components(_candidates(entries, num, den)), "groups")
    whole = _whole(docs, groups, k).join(sent(groups.withColumnRenamed("node", "id")), "id").select(F.col("component").alias("comp"), "id", "n", "grams")
    whole = stored(whole, "grams")
    # a large group's rows are dealt out, and its smallest row goes along to each part
    large = groups.groupBy("component").agg(F.ceil(F.count("*") / SALTED).cast("int").alias("salts")).where("salts > 1").withColumnRenamed("component", "comp")
    large = sent(stored(large, "large"))
    salted = whole.join(large, "comp", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    first = salted.where("id = comp").select("comp", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("n").alias("first_n"), F.col("grams").alias("first"))
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
    seen = stored(_with_first(salted.join(first, ["comp", "salt"]).select("comp", "id", "n", "first_n", "grams", "first")), "seen")
    seen = seen.withColumn("linked", F.expr(f"shared * {den} >= {num} * (n + first_n - shared)")).withColumn("gap", F.expr("1 - shared / (n + first_n - shared)"))
    # rows that the first row leaves open, and the settled ones near enough to link with one of them (the Jaccard distance is a metric)
    open_ = seen.where("not linked").groupBy("comp").agg(F.count("*").alias("n_open"), F.min("gap").alias("least"))
    near = seen.join(open_, "comp").where(f"id <> comp and (not linked or gap >= least - {1 - num / den + 1e-9})").select("comp", "id", "n")
    many = near.groupBy("comp").agg(F.count("*").alias("rows"), F.sum("n").alias("grams")).where("rows > 1")
    cut = near.join(many.withColumnRenamed("grams", "all"), "comp").select("comp", "id", F.ceil(F.greatest(F.col("rows") / ROWS, F.col("all") / GRAMS)).cast("int").alias("cuts"))
    dealt = cut.withColumn("own", F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int"))
    dealt = sent(stored(dealt, "cuts"))
    pairs = whole.select("id", "grams").join(dealt, "id").withColumn("other", F.explode(F.expr("sequence(0, cuts - 1)"))).select("comp", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "id", "grams")
    more = pairs.groupBy("comp", "p", "q").applyInArrow(_in_blocks(num, den), "a bigint, b bigint")
    return seen.where("linked and id <> comp").select(F.col("id").alias("a"), F.col("comp").alias("b")).union(more)


def jaccard_classes(docs: DataFrame, *, doc_id="doc_id", text="text", words: int = 5, similarity: tuple[int, int] = (8, 10)) -> DataFrame:
    """One row per document: id, n_shingles, component (the smallest id
    reachable by links; its own where it links with nothing)."""
    num, den = similarity
    docs = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    digest = stored(_digest(docs, words, num, den), "digest")
    found = components(links(docs, digest, words, num, den))
    classes = digest.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("id").alias("rep"))
    classes = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("n").alias("cn"), F.col("f1").alias("c1"), F.col("f2").alias("c2"), F.coalesce("component", "rep").alias("component"))
    out = digest.select("id", "n", "f1", "f2").join(classes, F.expr("n = cn and f1 = c1 and f2 = c2"), "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def without_copies(docs: DataFrame, *, doc_id="doc_id", text="text", **options) -> DataFrame:
    """One document of each class (the smallest id, null ids last), all columns
    as they are. Rows are told apart by id and text: of rows repeated with both
    one stays, and an id with several texts is a document for each of them."""
    rows, odd = told_apart(docs, doc_id, text, once=True)
    found = jaccard_classes(rows, doc_id="_key", text=text, **options).select(F.col("doc_id").alias("_key"), F.col("component_id").alias("_stays"))
    if odd:
        # classes with a hashed key: who stays is found by the ids themselves
        found = stored(found, "classes")
        ids = rows.select("_key", F.col(doc_id).cast("bigint").alias("_id"))
        hashed = stored(ids.where("not _key <=> _id"), "hashed")
        classes = stored(found.join(sent(hashed), "_key", "left_semi").select("_stays").distinct(), "odd-classes")
        order = F.expr("case when _id is not null then struct(false as none, _id as id, _key as key) when _hashed then struct(true as none, _key as id, _key as key) else struct(false as none, _key as id, _key as key) end")
        members = found.join(sent(classes), "_stays").join(sent(hashed.withColumn("_hashed", F.lit(True))), "_key", "left")
        first = stored(members.groupBy("_stays").agg(F.min(order)["key"].alias("_first")), "first")
        found = found.join(sent(first), "_stays", "left").select("_key", F.coalesce("_first", "_stays").alias("_stays"))
    return without(rows, "_key", found.where("_stays <> _key").select("_key").distinct()).drop("_key")
