"""Toxicity scores: FTRL-proximal logistic regression over hashed features.

Features of a text are the distinct hashes of its words, word pairs and skip
pairs (a word and the next but one), each 0 or 1, in ``2 ** SLOT_BITS`` slots.
FTRL-proximal keeps a learning rate for each coordinate, and its L1 term sets
the weights of slots without evidence to exactly zero; what remains is a small
table that goes to every task (never more than the number of slots).

Training uses a bounded sample: the ``max_rows`` labelled documents outside
the held-out fold with the smallest id hash. The sample's features are written
once; the learner reads them in hash order, once for each epoch, as a stream in
one task (its state is the slots; its input is bounded by ``max_rows``).
Scoring reads every whole text once and shuffles nothing.

Only the text enters a score. Null, empty and blank texts have no features and
get the score of the bias alone. Labels: null labels and labels of unknown
documents are left out; several labels of one document count as their largest.
Without any usable label every score is 0.5. A null id counts as the empty
string for the fold. Repeated rows get equal scores; further columns are
ignored by ``score`` and kept by ``without_toxic``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import blocks as B
from .store import stored

SLOT_BITS = 20
THRESHOLD = 0.7


@dataclass(frozen=True)
class Params:
    """Learner settings. ``max_rows`` bounds the labelled sample; ``l1`` is per
    sample row (as for a mean loss); ``positive`` weighs the rarer toxic rows."""

    max_rows: int = 8192
    epochs: int = 5
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 0.006
    l2: float = 0.0
    positive: float = 2.0


def features(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of every word, pair and skip pair, repeats included."""
    rows, found = [row], [B.grams(h, 1)]
    for gap, tag in ((1, 11), (2, 13)):
        if len(h) > gap:
            same = row[:-gap] == row[gap:]
            pair = B.mix(h[:-gap] * np.uint64(0x9FB21C651E98DF25) + B.mix(h[gap:] + np.uint64(tag)))
            rows.append(row[:-gap][same])
            found.append(pair[same])
    return np.concatenate(rows), (np.concatenate(found) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _distinct(row: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique((row.astype(np.int64) << SLOT_BITS) | slot)
    return key >> SLOT_BITS, key & ((1 << SLOT_BITS) - 1)


class Ftrl:
    """FTRL-proximal for logistic loss; slot ``2 ** SLOT_BITS`` is the bias, without L1."""

    def __init__(self, p: Params, rows: int):
        self.p, self.l1 = p, p.l1 * rows
        self.z, self.n = (np.zeros((1 << SLOT_BITS) + 1) for _ in range(2))

    def weights(self, at) -> np.ndarray:
        z, n, p = self.z[at], self.n[at], self.p
        l1 = np.where(at == 1 << SLOT_BITS, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2))

    def learn(self, slots: np.ndarray, y: int) -> None:
        at = np.append(slots, 1 << SLOT_BITS)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y) * (self.p.positive if y else 1.0)
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.p.alpha * w
        self.n[at] = n + g * g


def in_fold(doc_id: Column) -> Column:
    """Whether a document is held out from training."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, p: Params) -> DataFrame:
    """(id, y, slots) of the labelled sample; at most ``max_rows`` label rows are sent to the tasks."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y")).where(~in_fold(F.col("doc_id")))
    chosen = stored(known.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(p.max_rows).select(F.col("doc_id").alias("_id"), "y"), "labelled")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.text_bytes(batch.column(2))
            for lo, hi in B.row_blocks(offsets):
                row, h, _, _ = B.words(data, offsets, lo, hi, B.ALNUM)
                r, slot = _distinct(*features(h, row))
                limits = B.row_limits(r, hi - lo)
                slot = slot.astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array([slot[a:b].tobytes() for a, b in zip(limits[:-1], limits[1:])], pa.binary())], names=["id", "y", "slots"])

    rows = docs.select("id", "text").join(F.broadcast(chosen), F.col("id") == F.col("_id")).select("id", "y", "text")
    return stored(rows.mapInArrow(B.released(run), "id bigint, y int, slots binary"), "sample")


def train(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> tuple[np.ndarray, np.ndarray]:
    """(slots, weights) that are not zero; the bias is slot ``2 ** SLOT_BITS``."""
    sample = _sample(docs, labels, p)
    size = sample.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Ftrl(p, size)
        for batch in batches:
            for y, slots in zip(batch.column(0).to_pylist(), batch.column(1)):
                model.learn(np.frombuffer(slots.as_buffer(), np.int32).astype(np.int64), y)
        w = model.weights(np.arange(len(model.z)))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], names=["slot", "w"])

    order = sample.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(p.epochs)))).repartition(1).sortWithinPartitions("epoch", F.xxhash64("epoch", "id"), "id")
    rows = order.select("y", "slots").mapInArrow(B.released(run), "slot bigint, w double").toPandas()
    return rows["slot"].to_numpy(np.int64), rows["w"].to_numpy(np.float64)


def text_scores(column, dense: np.ndarray) -> np.ndarray:
    """Scores of an Arrow string column; ``dense`` has a weight for each slot and the bias last."""
    data, offsets = B.text_bytes(column)
    total = np.full(len(offsets) - 1, dense[-1])
    for lo, hi in B.row_blocks(offsets):
        row, h, _, _ = B.words(data, offsets, lo, hi, B.ALNUM)
        r, slot = features(h, row)
        used = dense[slot] != 0
        r, slot = _distinct(r[used], slot[used])
        total[lo:hi] += np.bincount(r, dense[slot], hi - lo)
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def score(docs: DataFrame, labels: DataFrame, *, doc_id="doc_id", text="text", params: Params = Params()) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    docs = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    return _scored(docs, train(docs, labels, params), []).select(F.col("id").alias("doc_id"), in_fold(F.col("id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], keep: list[str]) -> DataFrame:
    """``id``, the columns to keep, and ``score``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros((1 << SLOT_BITS) + 1)
        dense[sent.value[0]] = sent.value[1]
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text_scores(batch.column(1), dense))], names=["id", "score"])

    return docs.mapInArrow(B.released(run), "id bigint, score double")


def without_toxic(docs: DataFrame, labels: DataFrame, *, doc_id="doc_id", text="text", params: Params = Params()) -> DataFrame:
    """The documents whose score stays under the threshold, all columns as they are."""
    model = train(docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")), labels, params)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros((1 << SLOT_BITS) + 1)
        dense[sent.value[0]] = sent.value[1]
        for batch in batches:
            at = batch.schema.get_field_index(text)
            yield batch.filter(pa.array(text_scores(batch.column(at), dense) < THRESHOLD))

    return docs.mapInArrow(B.released(run), docs.schema)
