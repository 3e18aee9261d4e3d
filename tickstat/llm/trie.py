"""Prefix trie of conversations with totals over subtrees, by centroid decomposition.

A node is a distinct sequence of first turns (role, text). Its members are the
conversations that start with it, and its name is (smallest member, depth): the
nodes that a conversation names form the lower end of its path.

1. Turns get their places by one range partitioning over (conversation, turn);
   a conversation that spans partitions gets the sizes of the earlier ones added.
2. A prefix is known by sums, over its places, of four 32-bit pieces of place
   hashes, so that prefixes come from running sums over ranges of ``SPAN`` places
   and no conversation has to stay in one task.
3. Nodes are counted by one aggregate. A node's weight, the turns of all its
   members from it on, is the total over its subtree of the members of each node
   and comes with that aggregate; it steers the decomposition.
4. Subtree totals: the forest of parent edges starts as one component. In each
   round every component heavier than ``BOUND`` takes the deepest node that
   holds at least half of its weight, its centroid; the totals of the parts
   below it are summed up and added to the nodes from the centroid up to the
   component's top; then the centroid leaves and the component falls into the
   parts below and the rest, each of at most half the weight. So there are at
   most log2(turns / BOUND) rounds, however long a path is, and every node meets
   every node above it once. Lighter components are packed, a bounded number of
   nodes each, and go on by the same rule within one task.

Scale: heavy components are fewer than turns / ``BOUND``, and nodes with many
members fewer than ``HEAVY``; such tables are sent to the tasks behind a check of
their rows. All other joins are by (conversation, range of places) or (name), so
that a conversation or a first turn with a third of all rows stays dealt out.
The members that end at a node are joined in ranges of 4,096 ids, and the hash of
a node reads them in order, one range at a time. Each round is written to the
shared folder.

Null roles and texts count as empty; null turn numbers come first; equal turn
numbers of a conversation go by role, then by a hash of role and text. Repeated
rows are turns of their own. Rows with a null conversation id belong to no
conversation. An empty table has no root and gives no rows. Further columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import sent, stored

#: Places in one range of a conversation.
SPAN_BITS = 12
#: Components of at most this weight are finished within one task.
BOUND = 1 << 13
#: At most so many nodes count as heavy (each has that share of all rows).
HEAVY = 100_000

_MASK = 0xFFFFFFFF


def _span(place: Column) -> Column:
    return F.shiftright(place, SPAN_BITS)


def ranked(conversations: DataFrame, *, conv_id="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """conv, place (from 1), two content hashes x1 and x2, and the text's bytes, of every turn."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    own = conversations.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("bigint").alias("conv"), F.col(turn).alias("turn"), as_text(role).alias("role"), as_text(text).alias("text"))
    rows = own.select("conv", "turn", "role", F.xxhash64(F.lit(1), "role", "text").alias("x1"), F.xxhash64(F.lit(2), "text", "role").alias("x2"), F.octet_length("text").cast("bigint").alias("bytes"))
    rows = stored(rows.groupBy(*rows.columns).agg(F.count("*").alias("n")), "turns")
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "x1", "x2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, conv_before, count_before = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            done = np.cumsum(n) - n
            first = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            start = done - np.repeat(done[first], np.diff(np.append(first, len(conv))))
            if conv[0] == conv_before:
                start[: first[1] if len(first) > 1 else len(conv)] += count_before
            conv_before, count_before = conv[-1], int(start[-1] + n[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(conv), part, np.int32)), pa.array(start), *batch.columns[1:]], names=["conv", "part", "start", "n", "x1", "x2", "bytes"])

    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "n", "x1", "x2", "bytes")
    dealt = stored(dealt.mapInArrow(run, "conv bigint, part int, start bigint, n bigint, x1 bigint, x2 bigint, bytes bigint"), "dealt")
    sizes = dealt.groupBy("conv", "part").agg(F.max(F.col("start") + F.col("n")).alias("n"))
    before = sizes.select("conv", "part", F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    before = stored(before.where("before is not null"), "before")  # at most one conversation goes on from one partition to the next
    whole = dealt.join(sent(before), ["conv", "part"], "left").withColumn("start", F.col("start") + F.coalesce("before", F.lit(0)) + 1)
    step = 1 << SPAN_BITS
    whole = whole.withColumn("c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(step).cast("bigint"))))
    last = F.least(F.col("c") + step - 1, F.col("n") - 1)
    return whole.select("conv", F.explode(F.sequence(F.col("start") + F.col("c"), F.col("start") + last)).alias("place"), "x1", "x2", "bytes")


def sizes(turns: DataFrame) -> DataFrame:
    """conv and size (number of turns) of conversations with turns."""
    return turns.groupBy("conv").agg(F.count("*").alias("size"))


def _spans(convs: DataFrame, *more: str) -> DataFrame:
    """One row for each range of places of each conversation."""
    return convs.select("conv", "size", *more, F.explode(F.sequence(F.lit(0).cast("bigint"), _span(F.col("size")))).alias("span"))


def regrafted(turns: DataFrame, *, every: int = 5, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """(turns, convs) in which a conversation c starts with the first h turns of
    conversation c - c % every, h = crc32(c) % (most + 1), and goes on with its own after its first h."""
    own = stored(sizes(turns), "sizes").withColumn("base", F.col("conv") - F.col("conv") % every).withColumn("h", (F.crc32(F.col("conv").cast("string").cast("binary")) % (most + 1)).cast("bigint"))
    held = own.select(F.col("conv").alias("base"), F.col("size").alias("base_size"))
    convs = own.join(held, "base", "left").withColumn("head", F.least("h", F.coalesce("base_size", F.lit(0))))
    convs = stored(convs.select("conv", "base", "h", "head", F.col("size").alias("own_size"), (F.col("head") + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("size")), "convs")
    heads = turns.where(F.col("place") <= most).withColumnRenamed("conv", "base").join(convs, "base").where("place <= h").select("conv", "place", "x1", "x2", "bytes")
    shift = _spans(convs.select("conv", F.col("own_size").alias("size"), "h", "head"), "h", "head").drop("size")
    tails = turns.withColumn("span", _span(F.col("place"))).join(shift, ["conv", "span"]).where("place > h").select("conv", (F.col("head") + F.col("place") - F.col("h")).alias("place"), "x1", "x2", "bytes")
    return heads.unionByName(tails), convs.select("conv", "size")


def _prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv, place (from 0), size, bytes of the last text, and the prefix's key k1, k2."""
    hashes = F.xxhash64(F.lit(3), "place", "x1", "x2"), F.xxhash64(F.lit(4), "x2", "place", "x1")
    pieces = [f(h) for h in hashes for f in (lambda h: F.shiftrightunsigned(h, 32), lambda h: h.bitwiseAND(F.lit(_MASK)))]
    names = ["s1", "s2", "s3", "s4"]
    rows = turns.select("conv", "place", "bytes", *(p.alias(n) for p, n in zip(pieces, names)), _span(F.col("place")).alias("span"))
    zero = F.lit(0).cast("bigint")
    rows = rows.unionByName(convs.select("conv", zero.alias("place"), zero.alias("bytes"), *(zero.alias(n) for n in names), zero.alias("span")))
    within = Window.partitionBy("conv", "span").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.select("conv", "place", "bytes", "span", *(F.sum(n).over(within).alias(n) for n in names))
    spans = _spans(convs)
    long = stored(convs.where(_span(F.col("size")) > 0).select("conv"), "long")
    if not long.isEmpty():  # sums of the ranges before
        totals = rows.join(sent(long), "conv", "left_semi").groupBy("conv", "span").agg(*(F.sum(n).alias(n) for n in names))
        before = Window.partitionBy("conv").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
        spans = spans.join(totals.select("conv", "span", *(F.sum(n).over(before).alias(f"b{n}") for n in names)), ["conv", "span"], "left")
        summed = summed.join(spans, ["conv", "span"]).select("conv", "place", "size", "bytes", *((F.col(n) + F.coalesce(f"b{n}", F.lit(0))).alias(n) for n in names))
    else:
        summed = summed.join(spans, ["conv", "span"]).select("conv", "place", "size", "bytes", *names)
    return summed.select("conv", "place", "size", "bytes", F.xxhash64(F.lit(5), *names).alias("k1"), F.xxhash64(F.lit(6), *names[::-1]).alias("k2"))


def _paths(prefixes: DataFrame) -> DataFrame:
    """conv, place, size, node (its smallest member), up (the node before), and the node's n_convs, weight and bytes."""
    key = ["place", "k1", "k2"]
    nodes = prefixes.groupBy(*key).agg(F.min("conv").alias("node"), F.count("*").alias("n_convs"), F.sum("size").alias("sum_size"))
    nodes = stored(nodes.select(*key, "node", "n_convs", (F.col("sum_size") - F.col("n_convs") * (F.col("place") - 1)).alias("weight")), "nodes")
    many = max(1024, prefixes.count() // HEAVY)
    heavy, light = nodes.where(F.col("n_convs") >= many), nodes.where(F.col("n_convs") < many)
    marked = prefixes.join(F.broadcast(heavy), key, "left")
    found = marked.where("node is not null").unionByName(marked.where("node is null").drop("node", "n_convs", "weight").join(light, key))
    found = stored(found.drop("k1", "k2"), "found")
    before = found.select("conv", (F.col("place") + 1).alias("place"), F.col("node").alias("up"))
    return stored(found.join(before, ["conv", "place"], "left"), "paths")


def _top(place: np.ndarray) -> np.ndarray:
    """The top of every node's component, by pointer doubling over parent places (-1: top)."""
    at = np.where(place >= 0, place, np.arange(len(place)))
    while True:
        then = at[at]
        if (then == at).all():
            return at
        at = then


def component_totals(parent: np.ndarray, depth: np.ndarray, weight: np.ndarray, values: np.ndarray) -> np.ndarray:
    """What the nodes of a forest get: the sums of ``values`` (a row per node)
    over their subtrees. ``parent`` has places or -1; ``weight`` is subtree-wide."""
    parent, weight, out = parent.copy(), weight.copy(), np.zeros_like(values)
    live = np.ones(len(parent), bool)
    while live.any():
        top = _top(parent)
        at = np.flatnonzero(live & (2 * weight >= weight[top]))
        at = at[np.lexsort((depth[at], top[at]))]
        c = at[np.append(top[at][1:] != top[at][:-1], True)]  # the deepest of each component
        cut = np.zeros(len(parent), bool)
        cut[c] = True
        live[c] = False
        below = np.flatnonzero(live & (parent >= 0) & cut[np.maximum(parent, 0)])
        over = parent[below]
        parent[below] = -1
        sums = np.zeros_like(values)
        np.add.at(sums, _top(parent)[live], values[live])
        total = values.copy()
        np.add.at(total, over, sums[below])
        add, less, walk = total[c], weight[c], c
        out[c] += add
        while True:  # from the centroids up to the tops
            up = parent[walk]
            go = up >= 0
            if not go.any():
                break
            walk, add, less = up[go], add[go], less[go]
            out[walk] += add
            weight[walk] -= less
        parent[c] = -1
    return out


def _finished(small: DataFrame, bound: int) -> DataFrame:
    """conv, place, leaves, saved of the nodes of light components."""
    packs = max(1, -(-small.count() // bound))

    def run(table: pa.Table) -> pa.Table:
        a = {n: table.column(n).to_numpy() for n in table.column_names if n != "pack"}
        order = np.lexsort((a["place"], a["conv"]))
        a = {n: v[order] for n, v in a.items()}
        names, name = np.unique(a["conv"], return_inverse=True)
        width = int(a["place"].max()) + 2
        key = name.astype(np.int64) * width + a["place"]
        at = np.minimum(np.searchsorted(names, a["up"]), len(names) - 1)
        wanted = at * width + a["place"] - 1
        parent = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
        is_top = (a["conv"] == a["top"]) & (a["place"] == a["top_place"])
        parent = np.where(is_top, -1, parent)
        sums = component_totals(parent, a["place"], a["weight"], np.stack([a["leaves"], a["saved"]], axis=1))
        got = sums + np.stack([a["got_leaves"], a["got_saved"]], axis=1)
        return pa.table({"conv": a["conv"], "place": a["place"], "leaves": got[:, 0], "saved": got[:, 1]})

    packed = small.withColumn("up", F.coalesce("up", F.lit(0))).withColumn("pack", F.pmod(F.xxhash64("top", "top_place"), F.lit(packs)))
    return packed.groupBy("pack").applyInArrow(run, "conv bigint, place bigint, leaves bigint, saved bigint")


def subtree_totals(nodes: DataFrame, paths: DataFrame, bound: int = BOUND) -> DataFrame:
    """conv, place, leaves and saved summed over the subtree of every node.
    ``nodes``: conv, place, up, weight, leaves, saved; ``paths``: conv, place, size, node, up."""
    top = nodes.where("place = 0").select(F.col("conv").alias("top"), F.col("place").alias("top_place"), F.col("weight").alias("total"))
    zero = F.lit(0).cast("bigint")
    first = top.first()
    state = nodes.select("conv", "place", "up", "weight", "leaves", "saved", zero.alias("got_leaves"), zero.alias("got_saved"), F.lit(first["top"]).alias("top"), zero.alias("top_place"))
    tops, done, light = stored(top, "tops"), [], []
    component = ["top", "top_place"]
    while True:
        big = stored(tops.where(F.col("total") > bound), "big")
        if big.isEmpty():
            light.append(state)
            break
        # fewer components are heavy than turns / bound
        marked = stored(state.join(sent(big), component, "left"), "components")
        light.append(marked.where("total is null").drop("total"))
        live = marked.where("total is not null")
        centroids = live.where(2 * F.col("weight") >= F.col("total")).groupBy(*component).agg(F.max(F.struct("place", "conv", "weight")).alias("c"))
        centroids = stored(centroids.select(*component, F.col("c.conv").alias("c"), F.col("c.place").alias("c_place"), F.col("c.weight").alias("c_weight")), "centroids")
        # conversations that go on below a centroid, and through which of its children
        below = paths.join(sent(centroids), (F.col("up") == F.col("c")) & (F.col("place") == F.col("c_place") + 1))
        below = below.select("conv", *component, "c_place", F.col("node").alias("child"), F.explode(F.sequence(_span(F.col("place")), _span(F.col("size")))).alias("span"))
        there = live.drop("total").withColumn("span", _span(F.col("place"))).join(below, ["conv", "span", *component], "left").drop("span")
        is_below = F.coalesce(F.col("place") > F.col("c_place"), F.lit(False))
        there = there.select(*state.columns, F.when(is_below, F.col("child")).alias("child"), F.when(is_below, F.col("c_place") + 1).alias("child_place"))
        there = there.join(sent(centroids).drop("c_weight"), component).withColumn("is_c", (F.col("conv") == F.col("c")) & (F.col("place") == F.col("c_place"))).drop("c", "c_place")
        there = stored(there, "below")
        sums = there.where("is_c or child is not null").groupBy(*component).agg(F.sum("leaves").alias("add_leaves"), F.sum("saved").alias("add_saved"))
        adds = stored(centroids.join(sums, component), "adds").withColumnRenamed("top", "c_top")
        # the nodes from each centroid up to its component's top
        way = paths.join(sent(adds), (F.col("conv") == F.col("c")) & (F.col("place") >= F.col("top_place")) & (F.col("place") <= F.col("c_place")))
        way = way.select(F.col("node").alias("conv"), "place", "add_leaves", "add_saved", F.when(F.col("place") < F.col("c_place"), F.col("c_weight")).otherwise(0).alias("less"))
        none = lambda c: F.coalesce(c, F.lit(0))
        there = there.join(way, ["conv", "place"], "left").withColumns({
            "got_leaves": F.col("got_leaves") + none("add_leaves"), "got_saved": F.col("got_saved") + none("add_saved"), "weight": F.col("weight") - none("less"),
            "top": F.coalesce("child", "top"), "top_place": F.coalesce("child_place", "top_place")})
        there = stored(there.select(*state.columns, "is_c"), "round")
        done.append(there.where("is_c").select("conv", "place", F.col("got_leaves").alias("leaves"), F.col("got_saved").alias("saved")))
        state = there.where("not is_c").drop("is_c")
        tops = state.where("conv = top and place = top_place").select(*component, F.col("weight").alias("total"))
    rest = light[0]
    for part in light[1:]:
        rest = rest.unionByName(part)
    found = _finished(stored(rest, "light"), bound)
    for part in done:
        found = found.unionByName(part)
    return found


def _ends(paths: DataFrame) -> DataFrame:
    """conv, place and ends_sha256 of nodes at which conversations end."""
    ids = paths.where("place = size").select("node", "place", "conv").withColumn("chunk", F.shiftright("conv", 12))
    ids = ids.groupBy("node", "place", "chunk").agg(F.sort_array(F.collect_set("conv")).alias("ids"))
    ids = ids.select("node", "place", "chunk", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, None
        for batch in batches:
            out = []
            for node, place, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if (node, place) == last:
                    digest.update(b"," + ids.encode())
                    continue
                if last is not None:
                    out.append((*last, digest.hexdigest()))
                last, digest = (node, place), hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(("conv", "place", "ends_sha256"), r)) for r in out], schema)
        if last is not None:
            yield pa.RecordBatch.from_pylist([{"conv": last[0], "place": last[1], "ends_sha256": digest.hexdigest()}], schema)

    schema = pa.schema([("conv", pa.int64()), ("place", pa.int64()), ("ends_sha256", pa.string())])
    dealt = ids.repartition("node", "place").sortWithinPartitions("node", "place", "chunk").select("node", "place", "ids")
    return dealt.mapInArrow(run, "conv bigint, place bigint, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame | None = None, *, bound: int = BOUND) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (bytes of text that members share), ends_sha256.
    ``turns`` as of ``ranked``; ``convs`` (conv, size) may hold conversations without turns."""
    turns = stored(turns, "places")
    convs = stored(sizes(turns) if convs is None else convs, "convs")
    paths = _paths(stored(_prefixes(turns, convs), "prefixes"))
    own = paths.where("node = conv")
    children = own.where("place > 0").groupBy(F.col("up").alias("conv"), (F.col("place") - 1).alias("place")).agg(F.count("*").alias("n_children"))
    n_children = F.coalesce("n_children", F.lit(0))
    nodes = own.join(children, ["conv", "place"], "left").select(
        "conv", "place", "up", "n_convs", "weight", n_children.alias("n_children"), F.when(n_children == 0, 1).otherwise(0).cast("bigint").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    nodes = stored(nodes, "nodes")
    empty = nodes.isEmpty()
    totals = nodes.select("conv", "place", "leaves", "saved") if empty else subtree_totals(nodes.drop("n_convs", "n_children"), paths.select("conv", "place", "size", "node", "up"), bound)
    found = nodes.drop("leaves", "saved", "weight").join(totals, ["conv", "place"]).join(_ends(paths), ["conv", "place"], "left")
    return found.select(
        F.col("conv").alias("conv_id"), F.col("place").alias("depth"), F.col("up").alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
