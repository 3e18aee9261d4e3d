"""Benchmark decontamination by winnowing.

Both sides are cut into word 5-grams; of every 6 consecutive 5-gram hashes
(together one window of 10 words) the smallest is kept, the rightmost of equal
ones. Equal windows keep the same 5-gram at the same place, so every shared
span of 10 words or more has a fingerprint in common. Document and item
fingerprints meet in an equi-join, and each hit is extended word by word, five
words to either side, which is as far as a window that holds the 5-gram goes.
Longer spans hold further windows with fingerprints of their own.

Items of 1 to 9 words are one window; their whole hash is looked up at every
place of the documents. Items without words match nothing.

Scale: documents are read once and not shuffled. A bit table of fixed size
(2 MB) of the item fingerprints travels to the tasks and only drops
fingerprints that no item has, so what is shuffled is what hits (and the rare
false positive). The join's key carries a salt: the fingerprints of a passage
that a third of all documents hold are dealt to ``SALTS`` keys, and the items'
side, which is the small one, is repeated for each salt.

Defined results: null and empty texts have no words; an empty documents table
gives an empty result and an empty benchmark no hits; several rows with the
same document id count as one document (their hits are joined, ``n_words`` is
the largest); repeated items of one text all count; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import blocks as B
from .store import stored, told_apart, without

GRAM = 5
WINDOW = 10
SPREAD = WINDOW - GRAM
BITS = 24
SALTS = 16

_HIT = "struct<kind:int,hash:bigint,pos:int,before:array<bigint>,after:array<bigint>>"


def fingerprints(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Places of the kept 5-grams among the words of many rows."""
    m = len(h) - WINDOW + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    g = B.grams(h, GRAM)
    best, at = g[:m].copy(), np.arange(m)
    for o in range(1, SPREAD + 1):
        c = g[o : o + m]
        less = c <= best
        best[less] = c[less]
        at[less] = (np.arange(m) + o)[less]
    at = at[row[:m] == row[WINDOW - 1 :]]
    return at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at


def _context(h: np.ndarray, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words before (nearest first) and after each kept 5-gram; 0 beyond the text."""
    before, after = np.zeros((len(at), SPREAD), np.uint64), np.zeros((len(at), SPREAD), np.uint64)
    for j in range(SPREAD):
        p = at - 1 - j
        ok = (p >= 0) & (row[np.maximum(p, 0)] == row[at])
        before[ok, j] = h[p[ok]]
        p = at + GRAM + j
        ok = (p < len(h)) & (row[np.minimum(p, len(h) - 1)] == row[at])
        after[ok, j] = h[p[ok]]
    return before, after


def _found(h: np.ndarray, row: np.ndarray, limits: np.ndarray, short: list[int], items: bool) -> tuple[np.ndarray, ...]:
    """(place, kind, hash, before, after) of what may hit; kind 0: a kept 5-gram, m: a whole window of m < 10 words."""
    at = fingerprints(h, row)
    g = B.grams(h, GRAM)
    before, after = _context(h, row, at)
    parts = [(at, np.zeros(len(at), np.int32), g[at] if len(at) else np.zeros(0, np.uint64), before, after)]
    sizes = np.diff(limits)
    for m in short:
        w = B.grams(h, m)
        p = limits[:-1][sizes == m] if items else np.flatnonzero(row[: len(w)] == row[m - 1 :])
        none = np.zeros((len(p), SPREAD), np.uint64)
        parts.append((p, np.full(len(p), m, np.int32), w[p], none, none))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _rows(column, short: list[int], items: bool, bits: np.ndarray | None) -> Iterator[tuple]:
    data, offsets = B.text_bytes(column)
    for lo, hi in B.row_blocks(offsets):
        row, h, _, _ = B.words(data, offsets, lo, hi, B.ALNUM)
        limits = B.row_limits(row, hi - lo)
        at, kind, hashed, before, after = _found(h, row, limits, short, items)
        if bits is not None:
            keep = _has(bits, hashed, kind)
            at, kind, hashed, before, after = at[keep], kind[keep], hashed[keep], before[keep], after[keep]
        order = np.argsort(at, kind="stable")
        at, kind, hashed, before, after = at[order], kind[order], hashed[order], before[order], after[order]
        own = row[at] if len(at) else np.zeros(0, np.int64)
        yield lo, hi, np.diff(limits), own, (at - limits[own]).astype(np.int32), kind, hashed, before, after


def _slot(hashed: np.ndarray, kind: np.ndarray) -> np.ndarray:
    return B.mix(hashed + kind.astype(np.uint64)) >> np.uint64(64 - BITS)


def _has(bits: np.ndarray, hashed: np.ndarray, kind: np.ndarray) -> np.ndarray:
    slot = _slot(hashed, kind)
    return (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _arrow(schema: str, key: str, values, blocks: list[tuple]) -> pa.RecordBatch:
    """One row for each row read: key, n_words, hits."""
    sizes = np.concatenate([b[2] for b in blocks] or [np.zeros(0, np.int64)])
    per_row = np.concatenate([np.bincount(b[3], minlength=b[1] - b[0]) for b in blocks] or [np.zeros(0, np.int64)])
    pos, kind, hashed = (np.concatenate([b[i] for b in blocks] or [np.zeros(0, t)]) for i, t in ((4, np.int32), (5, np.int32), (6, np.uint64)))
    before, after = (np.concatenate([b[i] for b in blocks] or [np.zeros((0, SPREAD), np.uint64)]) for i in (7, 8))
    ends = lambda n: pa.array(np.arange(0, n * SPREAD + 1, SPREAD), pa.int32())
    longs = lambda x: pa.array(x.astype(np.uint64).view(np.int64).ravel())
    hits = pa.StructArray.from_arrays(
        [pa.array(kind), longs(hashed), pa.array(pos), pa.ListArray.from_arrays(ends(len(pos)), longs(before)), pa.ListArray.from_arrays(ends(len(pos)), longs(after))],
        names=["kind", "hash", "pos", "before", "after"],
    )
    found = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_row)]), pa.int32()), hits)
    return pa.RecordBatch.from_arrays([values, pa.array(sizes.astype(np.int64)), found], names=[key, "n_words", "hits"])


def _scan(df: DataFrame, key: str, text: str, short: list[int], items: bool, bits=None) -> DataFrame:
    """(key, n_words, hits) for each row."""
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(bits.value, np.uint8) if bits is not None else None
        for batch in batches:
            if batch.num_rows:
                yield _arrow(key_type, key, batch.column(0), list(_rows(batch.column(1), short, items, table)))

    return df.select(F.col(key), F.col(text).cast("string")).mapInArrow(B.released(run), f"`{key}` {key_type}, n_words bigint, hits array<{_HIT}>")


def _bit_table(prints: DataFrame) -> bytes:
    """Bits of all item fingerprints: 2 ** BITS bits whatever the size of the benchmark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = _slot(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), batch.column(1).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array((slot >> np.uint64(3)).astype(np.int32)), pa.array((1 << (slot & np.uint64(7)).astype(np.int64)).astype(np.int32))], names=["byte", "bit"])

    rows = prints.select("hash", "kind").mapInArrow(B.released(run), "byte int, bit int").groupBy("byte").agg(F.bit_or("bit").alias("bit")).toPandas()
    out = np.zeros(1 << (BITS - 3), np.uint8)
    out[rows["byte"].to_numpy(np.int64)] = rows["bit"].to_numpy(np.int64).astype(np.uint8)
    return out.tobytes()


def _reach(side: str) -> Column:
    """How many of the words beside the 5-gram agree, without a gap."""
    steps, ok = F.lit(0), F.lit(True)
    for j in range(SPREAD):
        d, i = F.col(f"d.{side}")[j], F.col(f"i.{side}")[j]
        ok = ok & (d == i) & (d != 0)
        steps = steps + ok.cast("int")
    return steps


def matches(docs: DataFrame, benchmark: DataFrame, *, doc_id="doc_id", doc_text="text", item_id="item_id", item_text="text") -> DataFrame:
    """One row per document and matching span: doc id, n_words, item id, first
    word and end word of the span (null where a document has no match)."""
    spark = docs.sparkSession
    own = stored(_scan(benchmark, item_id, item_text, list(range(1, WINDOW)), True).where(F.size("hits") > 0), "items")
    prints = own.select(F.col(item_id).alias("item_id"), F.explode("hits").alias("h")).select("item_id", "h.*")
    short = sorted(r[0] for r in prints.where("kind > 0").select("kind").distinct().collect())
    bits = spark.sparkContext.broadcast(_bit_table(prints))
    found = _scan(docs, doc_id, doc_text, short, False, bits).select(F.col(doc_id).alias("doc_id"), "n_words", F.explode_outer("hits").alias("h"))
    # documents without hits take part as a row of kind -1, under a key of their own
    of_doc = F.xxhash64(F.col("doc_id").cast("string"))
    left = found.select(
        "doc_id", "n_words", F.coalesce("h.kind", F.lit(-1)).alias("kind"), F.coalesce("h.hash", of_doc).alias("hash"), F.col("h.pos").alias("pos"),
        F.col("h.before").alias("before"), F.col("h.after").alias("after"), F.pmod(of_doc, F.lit(SALTS)).cast("int").alias("salt"),
    ).alias("d")
    right = prints.drop("pos").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).alias("i")
    joined = left.join(right, [F.col(f"d.{c}") == F.col(f"i.{c}") for c in ("kind", "hash", "salt")], "left")
    back, ahead = _reach("before"), _reach("after")
    kind = F.col("d.kind")
    whole = (kind > 0) | (back + ahead + GRAM >= WINDOW)
    first = F.when(kind > 0, F.col("d.pos")).otherwise(F.col("d.pos") - back)
    end = F.when(kind > 0, F.col("d.pos") + kind).otherwise(F.col("d.pos") + GRAM + ahead)
    hit = F.col("i.item_id").isNotNull() & whole
    return joined.select(F.col("d.doc_id").alias("doc_id"), F.col("d.n_words").alias("n_words"), F.when(hit, F.col("i.item_id")).alias("item_id"), F.when(hit, first).alias("first"), F.when(hit, end).alias("end"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **columns: str) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (sorted ids), spans
    (disjoint hit word ranges, first and end), contaminated."""
    spans = matches(docs, benchmark, **columns)
    per_doc = spans.groupBy("doc_id").agg(
        F.max("n_words").alias("n_words"),
        F.collect_set("item_id").alias("items"),
        F.sort_array(F.collect_set(F.when(F.col("first").isNotNull(), F.struct("first", "end")))).alias("spans"),
    )
    merged = F.expr("""aggregate(spans, cast(array() as array<struct<first:int,end:int>>), (a, s) ->
        case when size(a) = 0 or s.first > element_at(a, -1).end then concat(a, array(s))
             else concat(slice(a, 1, size(a) - 1), array(named_struct('first', element_at(a, -1).first, 'end', greatest(element_at(a, -1).end, s.end)))) end)""")
    return (
        per_doc.withColumn("spans", merged)
        .withColumn("n_hit", F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.first)"))
        .select("doc_id", "n_words", "n_hit", F.array_sort("items").alias("items"), "spans", (F.col("n_hit") > 0).alias("contaminated"))
    )


def clean(docs: DataFrame, benchmark: DataFrame, *, doc_id="doc_id", doc_text="text", **columns: str) -> DataFrame:
    """The documents without any hit, all columns as they are. Documents are told
    apart by id and text, so those with null or repeated ids take part."""
    rows, _ = told_apart(docs, doc_id, doc_text)
    return without(rows, "_key", matches(rows, benchmark, doc_id="_key", doc_text=doc_text, **columns).where(F.col("item_id").isNotNull()).select("doc_id").distinct()).drop("_key")
