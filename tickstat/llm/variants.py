"""Spelling variants: words at edit distance one, grouped under their most frequent form.

Words that differ by one inserted, deleted or replaced code point are found by
pivotal grams. All bigrams are ranked by how few words hold them. A word's
prefix is its three rarest bigrams (2 x 1 + 1; all places of the third one
count), and its two pivots are the disjoint pair of prefix bigrams with the
smallest total frequency, chosen by dynamic programming over the places. One
edit touches at most one pivot. Of two near words, the one whose third rank is
smaller (s) therefore has a pivot that stands untouched among the other's (r)
prefix: either the second pivot, with all behind it unchanged, or the first one,
with all before it unchanged. Place limits are part of the join key: the
unchanged side of the pivot, and, where that is less than half of r, also the
half of the rest that the edit doesn't touch, together with r's length. Pairs
that share a key are verified inside the join; no unverified pair leaves it.

Scale: the text is read once and only long words are shuffled, as partial counts. Each
distinct word gives a bounded number of key rows (about 10 + 8, whatever the
vocabulary). The bigram ranks (at most the square of the alphabet of
``LETTERS``, 8,836 rows) are the only table sent to the tasks. Forms are
followed by pointer doubling; each step multiplies the count by ``RATIO``, so
the rounds are bounded by the logarithm of the logarithm of the largest count.

Null texts have no words; null ids count as the empty string. Repeated rows
count as often as they occur. Empty tables give empty results, further columns
are ignored. Of near words with equal counts the smallest in code-point order
is the form.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from . import blocks as B
from .store import stored

LETTERS = r"A-Za-zÀ-ÿ"
LEAST_LENGTH = 7
LEAST_COUNT = 2
RATIO = 10

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, *, doc_id="doc_id", text="text", least: int = LEAST_LENGTH) -> DataFrame:
    """doc_id (string) and every maximal run of letters of at least ``least`` code points, A-Z lower-cased."""
    found = F.regexp_extract_all(F.translate(F.col(text).cast("string"), _UPPER, _LOWER), F.lit(f"[{LETTERS}]{{{least},}}+"), F.lit(0))
    return docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("doc_id"), F.explode(found).alias("run"))


def counts(words: DataFrame, *, least: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n of the distinct words (one column) that are long and frequent enough."""
    return words.toDF("word").where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _bigrams(words: DataFrame) -> tuple[str, np.ndarray]:
    """(alphabet, number of words that hold each bigram of it)."""
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, 2)))
    rows = words.select(F.explode(grams).alias("g")).groupBy("g").count().collect()
    letters = "".join(sorted({c for r in rows for c in r["g"]}))
    table = np.zeros((len(letters), len(letters)), np.int64)
    for r in rows:
        table[letters.index(r["g"][0]), letters.index(r["g"][1])] = r["count"]
    return letters, table


def pivots(ranks: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rank of the third rarest bigram, whether each place is in the prefix,
    first pivot, second pivot) of words of one length; rows are words, columns places."""
    last = np.partition(ranks, 2, axis=1)[:, 2]
    prefix = ranks <= last[:, None]
    cost = np.where(prefix, weights, np.inf)
    least = np.minimum.accumulate(cost, axis=1)  # best single pivot up to each place
    at = np.maximum.accumulate(np.where(np.concatenate([np.ones((len(cost), 1), bool), cost[:, 1:] < least[:, :-1]], axis=1), np.arange(cost.shape[1]), 0), axis=1)
    pair = cost[:, 2:] + least[:, :-2]
    j = pair.argmin(axis=1)
    return last, prefix, at[np.arange(len(j)), j], j + 2


class _Hashes:
    """Hashes of substrings of words of one length."""

    def __init__(self, points: np.ndarray):
        n, size = points.shape
        up, down = B._powers(size + 1)
        self.down = down
        self.sums = np.zeros((n, size + 1), np.uint64)
        np.cumsum(B.mix(points.astype(np.uint64) + np.uint64(0x51ED270B)) * up[:size], axis=1, out=self.sums[:, 1:])

    def of(self, row: np.ndarray, a, b) -> np.ndarray:
        return B.mix((self.sums[row, b] - self.sums[row, a]) * self.down[a])


def _keys(h: _Hashes, row: np.ndarray, place: np.ndarray, own: int, other: int, behind: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row, key) of the unchanged side of a bigram at ``place`` of words of
    length ``own``, for a prefix word of length ``other``. ``behind``: the edit
    stands behind the bigram, so the text up to its end is unchanged; else the
    text from the bigram on."""
    k = place + 2 if behind else own - place  # length of the unchanged side
    whole = 2 * k >= other
    half = k + (other - k) // 2
    zero = np.zeros(len(k), np.int64)
    full = zero + own
    if behind:
        parts = [(0, whole, (zero, k), None), (1, ~whole, (zero, half), None), (2, ~whole, (zero, k), (half - other + own, full))]
    else:
        parts = [(3, whole, (own - k, full), None), (4, ~whole, (own - half, full), None), (5, ~whole, (zero, other - half), (own - k, full))]
    out = []
    for kind, which, one, two in parts:
        at = np.flatnonzero(which)
        x = h.of(row[at], one[0][at], one[1][at]) + np.uint64(kind * 4096 + other * 8)
        if two is not None:
            x = B.mix(x) + h.of(row[at], two[0][at], two[1][at]) + k[at].astype(np.uint64)
        out.append((row[at], B.mix(x)))
    return out


def _key_rows(letters: str, table: np.ndarray, least: int, pivotal: bool):
    """Task function: words and counts to rows (key, last, word, n) of their pivots or of their prefixes."""
    order = np.argsort(table, axis=None, kind="stable")
    ranks = np.empty(table.size, np.int64)
    ranks[order] = np.arange(table.size)
    ranks = ranks.reshape(table.shape)
    codes = np.array([ord(c) for c in letters], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.utf8_length(batch.column(0)).to_numpy()
            for own in np.unique(sizes).tolist():
                group = batch.take(pa.array(np.flatnonzero(sizes == own)))
                points = np.frombuffer("".join(group.column(0).to_pylist()).encode("utf-32-le"), np.uint32).reshape(-1, own)
                index = np.searchsorted(codes, points)
                last, prefix, a, b = pivots(ranks[index[:, :-1], index[:, 1:]], table[index[:, :-1], index[:, 1:]].astype(float))
                h, all_rows, found = _Hashes(points), np.arange(len(points)), []
                if pivotal:
                    for other in range(max(least, own - 1), own + 2):
                        found += _keys(h, all_rows, a, own, other, True) + _keys(h, all_rows, b, own, other, False)
                else:
                    row, place = np.nonzero(prefix)
                    found += _keys(h, row, place, own, own, True) + _keys(h, row, place, own, own, False)
                row, key = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
                order = np.lexsort((key, row))
                row, key = row[order], key[order]
                new = np.concatenate([[True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])])
                row, key = row[new], key[new].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(last[row]), group.column(0).take(pa.array(row)), group.column(1).take(pa.array(row))], names=["key", "last", "word", "n"])

    return run


def near_words(words: DataFrame, *, least: int = LEAST_LENGTH) -> DataFrame:
    """Each pair of words (word, n: distinct words of at least ``least`` >= 4
    code points) at edit distance one, once: word, n, near, near_n."""
    if least < 4:
        raise ValueError("words need three bigrams")
    letters, table = _bigrams(words)
    schema = "key bigint, last bigint, word string, n bigint"
    s = words.select("word", "n").mapInArrow(_key_rows(letters, table, least, True), schema)
    r = words.select("word", "n").mapInArrow(_key_rows(letters, table, least, False), schema).toDF("key", "r_last", "r_word", "r_n")
    pairs = s.join(r, (s["key"] == r["key"]) & (F.col("last") <= F.col("r_last")) & (F.levenshtein("word", "r_word", 1) == 1))
    first = F.col("word") < F.col("r_word")
    side = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    return pairs.select(side("word", "r_word").alias("word"), side("n", "r_n").alias("n"), side("r_word", "word").alias("near"), side("r_n", "n").alias("near_n")).distinct()


def _last(forms: DataFrame, most: int, ratio: int) -> DataFrame:
    """(word, root) by pointer doubling over (word, form); a chain has no more steps than the ratio allows counts up to ``most``."""
    steps = max(1, math.floor(math.log(max(most, 2)) / math.log(ratio)) + 1)
    at = forms.toDF("word", "root")
    for i in range(math.ceil(math.log2(steps + 1))):
        at = stored(at, "roots")
        then = at.toDF("_word", "_root")
        at = at.join(then, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root"))
    return at


def group(words: DataFrame, *, least: int = LEAST_LENGTH, ratio: int = RATIO) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root."""
    words = stored(words.select("word", "n"), "words")
    pairs = near_words(words, least=least)
    both = pairs.select(F.explode(F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))).alias("p")).select("p.*")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near")))
    found = both.groupBy("word").agg(F.count("*").alias("n_near"), F.max("n").alias("_n"), best.alias("best"))
    enough = -F.col("best.minus") >= ratio * F.col("_n")
    found = stored(found.select("word", "n_near", F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.minus")).alias("form_n")), "near")
    most = words.agg(F.max("n")).first()[0]
    roots = _last(found.where("form is not null").select("word", "form"), most or 1, ratio)
    return words.join(found, "word", "left").join(roots, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


def damaged(rows: DataFrame, every: int = 31) -> Column:
    """The runs of ``runs`` with one code point lost where the checksum of id and run is a multiple of ``every``."""
    h = F.crc32(F.concat(F.col("doc_id"), F.lit(":"), F.col("run")).cast("binary"))
    at = (h % F.length("run")).cast("int")
    return F.when(h % every == 0, F.concat(F.left(F.col("run"), at), F.substring(F.col("run"), at + 2, F.length("run")))).otherwise(F.col("run"))
