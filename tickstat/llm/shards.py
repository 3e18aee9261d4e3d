"""Shards of near-equal bytes: minimax contiguous partition, with DataFrame functions only.

Groups of equal texts are atomic and ordered by the hash of their text. The
order is cut into ``2 ** CELL_BITS`` fixed ranges of hashes; a range holds whole
groups, and its sizes are what the partition works on (a table of bounded size
whatever the corpus). The smallest feasible shard capacity is found by binary
search: a capacity is feasible if filling shards greedily in order, opening the
next one when a range doesn't fit, needs no more than the wanted number. The
order is cut under that capacity, at the feasible places nearest to even
shares; a group larger than a share has a shard of its own.

Slots number the rows of a shard without gaps. A range whose rows are many
(a hot group of copies, say) is dealt over several salts by document id, so
that no window holds more than a fixed share of all rows: rows are numbered
inside (range, salt), and the counts of the (range, salt) cells before, a
bounded table, are added.

Scale: the text is read once, into (id, size, checksum, range); what is shuffled
and joined later are these small rows. The driver sees the sizes of the ranges.

Null texts have 16 bytes, the checksum of no bytes, and the empty text's
group. Repeated rows are rows of their group. Null ids are numbered first.
Empty tables give empty results. Further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import stored

CELL_BITS = 15
OVERHEAD = 16


def capacity(sizes: list[int], shards: int) -> int | None:
    """Smallest capacity for which filling greedily in order needs no more than the shards."""
    if not sizes:
        return 0
    if not shards:
        return None
    before = [0, *accumulate(sizes)]

    def fits(most: int) -> bool:
        at = 0
        for _ in range(shards):
            at = bisect_right(before, before[at] + most) - 1
        return at >= len(sizes)

    low, high = max(-(-before[-1] // shards), *sizes), before[-1]
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low


def minimax_cuts(sizes: list[int], shards: int) -> list[int]:
    """Positions where shards 1, 2, ... begin: no shard is over the smallest
    feasible capacity. Where one oversized group sets that capacity, it has a
    shard of its own and the parts before and after it are cut likewise;
    elsewhere each cut is the feasible one nearest to an even share of the rest."""
    if shards <= 1 or not sizes:
        return []
    before, n = [0, *accumulate(sizes)], len(sizes)
    most = capacity(sizes, shards)
    if most == max(sizes) and most * shards > before[-1]:
        i = sizes.index(most)
        left, right = sizes[:i], sizes[i + 1 :]
        worst = lambda k: [c if (c := capacity(*x)) is not None else before[-1] + 1 for x in ((left, k), (right, shards - 1 - k))]
        k = min(range(shards), key=lambda k: (max(worst(k)), abs(k - (shards - 1) * before[i] / max(1, before[-1] - most))))
        own = [i] if k else []  # without a shard on the left the group opens the first one
        after = [i + 1] if right else []
        return minimax_cuts(left, k) + own + after + [i + 1 + c for c in minimax_cuts(right, shards - 1 - k)]
    least = [n]  # least[r]: the first position from which r shards hold the rest
    for _ in range(shards):
        least.append(bisect_left(before, before[least[-1]] - most))
    cuts, at = [], 0
    for rest in range(shards - 1, 0, -1):
        lowest, highest = max(least[rest], min(at + 1, n)), bisect_right(before, before[at] + most) - 1
        goal = before[at] + (before[-1] - before[at]) / (rest + 1)
        at = min(max(bisect_left(before, goal), lowest), highest)
        if at > lowest and abs(before[at - 1] - goal) <= abs(before[at] - goal):
            at -= 1
        if at >= n:
            break
        cuts.append(at)
    return cuts


def _range(text: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(text), 64 - CELL_BITS).cast("int")


def by_bytes(docs: DataFrame, shards: int, *, doc_id="doc_id", text="text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = stored(docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body).cast("long") + OVERHEAD).alias("size"), F.crc32(body).alias("text_crc32"), _range(body).alias("cell")), "sizes")
    totals = {r["cell"]: (r["size"], r["n"]) for r in rows.groupBy("cell").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()}
    cells = sorted(totals)
    cuts = [cells[i] for i in minimax_cuts([totals[c][0] for c in cells], shards)]
    # a range with more than its share of the rows is dealt over salts
    share = max(64, 4 * sum(n for _, n in totals.values()) >> CELL_BITS)
    salted = {c: -(-n // share) for c, (_, n) in totals.items() if n > share}
    shard = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<int>"), lambda c: c <= F.col("cell"))).cast("int")
    # at most 2 ** CELL_BITS / 4 ranges, so the broadcast has a fixed bound
    dealt = F.broadcast(docs.sparkSession.createDataFrame(sorted(salted.items()), "_hot int, _salts int"))
    salts = F.coalesce("_salts", F.lit(1))
    rows = rows.join(dealt, F.col("cell") == F.col("_hot"), "left").withColumns({"shard": shard, "salt": F.pmod(F.xxhash64("doc_id", "text_crc32"), salts).cast("int")}).drop("_hot", "_salts")
    counts = rows.groupBy("shard", "cell", "salt").agg(F.count("*").alias("n"))
    before = counts.select(
        F.col("cell").alias("_cell"), F.col("salt").alias("_salt"),
        F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("cell", "salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    own = rows.withColumn("slot", F.row_number().over(Window.partitionBy("cell", "salt").orderBy("doc_id", "text_crc32")))
    joined = own.join(before, (F.col("cell") == F.col("_cell")) & (F.col("salt") == F.col("_salt")))
    return joined.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("slot") - 1).alias("slot"))
