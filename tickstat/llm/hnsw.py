"""Approximate nearest neighbours: a navigable small-world graph per shard.

Equal vectors are folded to one class, which keeps its smallest k + 1 ids, so a
vector that many rows share neither fills the neighbour lists nor hides ties.
The classes are dealt to shards of about ``SHARD`` by hash. Each shard gets a
hierarchical graph: a node's top level is drawn from its id's hash, nodes are
numbered from the top level down (the nodes of a level are a prefix), and each
level is a flat array of neighbour numbers. Nodes are inserted in batches that
search the graph built so far in lockstep; links are chosen by the usual
heuristic (a candidate is linked if it is nearer to the node than to any link
chosen before), both ways, and shrunk by the same rule where a list is full.

All queries go to all shards: query blocks of bounded size are sent to the
shards, a task opens a shard's graph once for ``TURNS`` blocks and reads these one
by one, descends the levels and runs a beam search for a whole block at once,
and the shards' best classes are merged by distance, computed in double
precision from the original vectors.

Graphs work in the shard's own scale (a power of two, so nothing is rounded) and
distances are scaled before they are squared: vectors of any finite size take
part. A shard of at most ``EF_SEARCH`` vectors is searched whole.

Scale: the index is stored in the shared folder, one row per shard, so a lost
executor costs a shard; memory is bounded by one shard and one query block.

Null vectors, zero vectors and vectors with null or non-finite components take
no part; vectors of different lengths are never compared. Rows repeated under
several ids are neighbours at distance 0; ties go to the smaller id. With fewer
than k candidates all are returned. Empty tables give empty results; further
columns are ignored. Null ids take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import blocks as B
from .store import stored

SHARD = 8192
QUERIES = 512
LINKS = 16
EF_BUILD = 64
EF_SEARCH = 192
BATCH = 512
#: Query blocks that one copy of a shard's graph serves.
TURNS = 16


def distances(queries: np.ndarray, vectors: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Squared distance of each query to the vectors at its row of ``at``."""
    gap = vectors[at] - queries[:, None, :]
    return np.einsum("qnd,qnd->qn", gap, gap)


def exact_distances(queries: np.ndarray, vectors: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Distances in double precision, for components of any finite size: each
    gap is scaled by a power of two, which rounds nothing, before it is squared."""
    with np.errstate(over="ignore", invalid="ignore"):
        gap = vectors[at] - queries[:, None, :]
        far = np.isinf(gap).any(axis=2)
        gap[far] = (vectors[at] / 2 - queries[:, None, :] / 2)[far] if far.any() else 0.0
        _, e = np.frexp(np.abs(gap).max(axis=2, initial=0.0))
        gap = np.ldexp(gap, -e[:, :, None])
        return np.ldexp(np.sqrt(np.einsum("qnd,qnd->qn", gap, gap)), e + far)


def beam(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, starts: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, squared distances), nearest first, of a beam search on one level
    for all queries at once; -1 where there are fewer."""
    q = len(queries)
    ids, dist = np.full((q, ef), -1, np.int64), np.full((q, ef), np.inf, vectors.dtype)
    done = np.ones((q, ef), bool)
    seen = np.zeros((q, len(vectors)), bool)
    w = min(starts.shape[1], ef)
    ids[:, :w] = starts[:, :w]
    real = ids[:, :w] >= 0
    dist[:, :w] = np.where(real, distances(queries, vectors, np.maximum(ids[:, :w], 0)), np.inf)
    done[:, :w] = ~real
    r, c = np.nonzero(real)
    seen[r, ids[r, c]] = True
    order = np.argsort(dist, axis=1, kind="stable")
    ids, dist, done = (np.take_along_axis(x, order, 1) for x in (ids, dist, done))
    live = np.arange(q)
    while len(live):
        open_ = ~done[live]
        some = open_.any(1)
        live, open_ = live[some], open_[some]
        if not len(live):
            break
        at = open_.argmax(1)
        done[live, at] = True
        near = links[ids[live, at]]
        fresh = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
        r, c = np.nonzero(fresh)
        seen[live[r], near[r, c]] = True
        d = np.where(fresh, distances(queries[live], vectors, np.maximum(near, 0)), np.inf).astype(vectors.dtype)
        better = (d < dist[live, -1][:, None]).any(1)
        if not better.any():
            continue
        rows = live[better]
        all_d = np.concatenate([dist[rows], d[better]], 1)
        all_i = np.concatenate([ids[rows], near[better]], 1)
        all_x = np.concatenate([done[rows], np.zeros_like(fresh[better])], 1)
        order = np.argsort(all_d, axis=1, kind="stable")[:, :ef]
        dist[rows] = np.take_along_axis(all_d, order, 1)
        ids[rows] = np.where(np.isinf(dist[rows]), -1, np.take_along_axis(all_i, order, 1))
        done[rows] = np.take_along_axis(all_x, order, 1) | np.isinf(dist[rows])
    return ids, dist


def choose(vectors: np.ndarray, ids: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` links for each row of candidates (nearest first, -1: none): those
    nearer to the node than to a link chosen before, then the nearest others."""
    q, c = ids.shape
    v = vectors[np.maximum(ids, 0)]
    square = np.einsum("qcd,qcd->qc", v, v)
    between = square[:, :, None] + square[:, None, :] - 2 * (v @ v.transpose(0, 2, 1))
    chosen = np.zeros((q, c), bool)
    nearest = np.full((q, c), np.inf, vectors.dtype)  # to a chosen link
    count = np.zeros(q, int)
    for j in range(c):
        take = (ids[:, j] >= 0) & (dist[:, j] < nearest[:, j]) & (count < most)
        chosen[:, j] = take
        count += take
        nearest = np.where(take[:, None], np.minimum(nearest, between[:, j, :]), nearest)
    order = np.argsort(np.where(ids < 0, 2, np.where(chosen, 0, 1)), axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(ids, order, 1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1) if out.shape[1] < most else out


def _link_back(vectors: np.ndarray, links: np.ndarray, nodes: np.ndarray, chosen: np.ndarray) -> None:
    """Adds the nodes to the lists of those they link to."""
    most = links.shape[1]
    r, c = np.nonzero(chosen >= 0)
    if not len(r):
        return
    to, new = chosen[r, c], nodes[r]
    hit = np.unique(to)
    old = links[hit]
    o_r, o_c = np.nonzero(old >= 0)
    owner = np.concatenate([hit[o_r], to])
    other = np.concatenate([old[o_r, o_c], new])
    gap = vectors[owner] - vectors[other]
    d = np.einsum("nd,nd->n", gap, gap)
    order = np.lexsort((other, d, owner))
    owner, other, d = owner[order], other[order], d[order]
    same = np.concatenate([[False], (owner[1:] == owner[:-1]) & (other[1:] == other[:-1])])
    owner, other, d = owner[~same], other[~same], d[~same]
    start = np.searchsorted(owner, hit)
    rank = np.arange(len(owner)) - np.repeat(start, np.diff(np.append(start, len(owner))))
    width = 2 * most
    ids, dist = np.full((len(hit), width), -1, np.int64), np.full((len(hit), width), np.inf, vectors.dtype)
    inside = rank < width
    row = np.searchsorted(hit, owner[inside])
    ids[row, rank[inside]], dist[row, rank[inside]] = other[inside], d[inside]
    full = (ids >= 0).sum(1) > most
    out = ids[:, :most].copy()
    for lo in range(0, int(full.sum()), 1024):
        some = np.flatnonzero(full)[lo : lo + 1024]
        out[some] = choose(vectors, ids[some], dist[some], most)
    links[hit] = out


class Graph:
    """Levels of neighbour numbers over vectors numbered from the top level down."""

    def __init__(self, vectors: np.ndarray, sizes: list[int], levels: list[np.ndarray]):
        self.vectors, self.sizes, self.levels = vectors, sizes, levels

    @staticmethod
    def order(ids: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """(numbering, nodes of each level) from the ids' hashes."""
        h = B.mix(ids.view(np.uint64) + np.uint64(77))
        u = ((h >> np.uint64(11)).astype(np.float64) + 1) / (1 << 53)
        top = np.minimum((-np.log(u) / np.log(LINKS)).astype(int), 12)
        order = np.lexsort((h, -top))
        sizes = [len(ids)]
        while (n := int((top >= len(sizes)).sum())) > 1:
            sizes.append(n)
        return order, sizes

    @classmethod
    def build(cls, vectors: np.ndarray, sizes: list[int]) -> Graph:
        n = len(vectors)
        levels = [np.full((sizes[k], LINKS * (2 if k == 0 else 1)), -1, np.int64) for k in range(len(sizes))]
        graph = cls(vectors, sizes, levels)
        lo = 0
        while lo < n:
            hi = min(n, lo + min(BATCH, max(lo, 32)))
            mates = np.arange(lo, hi)
            starts = np.zeros((hi - lo, 1), np.int64) if lo else np.full((hi - lo, 1), -1, np.int64)
            square = np.einsum("nd,nd->n", vectors[lo:hi], vectors[lo:hi])
            inner = np.maximum(square[:, None] + square[None, :] - 2 * vectors[lo:hi] @ vectors[lo:hi].T, 0).astype(vectors.dtype)
            np.fill_diagonal(inner, np.inf)
            for k in range(len(sizes) - 1, -1, -1):
                own = mates < sizes[k]
                known = min(lo, sizes[k])
                width = EF_BUILD if own.any() else 1
                if known:
                    starts, dist = beam(vectors[:known], levels[k][:known], vectors[lo:hi], starts, width)
                else:
                    starts, dist = np.full((hi - lo, 1), -1, np.int64), np.full((hi - lo, 1), np.inf, vectors.dtype)
                if own.any():
                    m = int(own.sum())
                    ids = np.concatenate([starts[:m], np.broadcast_to(mates[:m], (m, m))], 1)
                    d = np.concatenate([dist[:m], inner[:m, :m]], 1)
                    best = np.argsort(d, axis=1, kind="stable")[:, : EF_BUILD]
                    d = np.take_along_axis(d, best, 1)
                    ids = np.where(np.isinf(d), -1, np.take_along_axis(ids, best, 1))
                    chosen = choose(vectors, ids, d, LINKS)
                    levels[k][lo : lo + m, :LINKS] = chosen
                    _link_back(vectors, levels[k], mates[:m], chosen)
                starts = np.where(np.isinf(dist), -1, starts)
                if lo:
                    starts[(starts < 0).all(1), 0] = 0
            lo = hi
        return graph

    def search(self, queries: np.ndarray, ef: int) -> np.ndarray:
        """(queries, ef) node numbers, -1 where there are fewer; all nodes of a small graph."""
        if len(self.vectors) <= ef:
            return np.tile(np.arange(len(self.vectors)), (len(queries), 1))
        starts = np.zeros((len(queries), 1), np.int64)
        for k in range(len(self.sizes) - 1, 0, -1):
            starts, _ = beam(self.vectors[: self.sizes[k]], self.levels[k], queries, starts, 1)
        return beam(self.vectors, self.levels[0], queries, starts, ef)[0]


def _usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, v): the vectors that take part, with one kind of zero."""
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col(vec_id).cast("bigint").alias("id"), F.col(embedding).cast("array<double>").alias("v")).where("id is not null and v is not null").where(ok).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))


def _classes(rows: DataFrame, k: int) -> DataFrame:
    """(cid, v, members): equal vectors, their smallest id, and the k + 1 smallest."""
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    return ranked.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("members")).select(F.col("members")[0].alias("cid"), "v", "members")


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _scale(exact: np.ndarray) -> int:
    """The power of two that brings a shard's largest component under one."""
    return int(np.frexp(np.abs(exact).max())[1])


def _near_shard(queries: np.ndarray, scale: int) -> np.ndarray:
    """Queries in a shard's scale; of those 2 ** 60 times larger than the shard only the direction counts."""
    _, own = np.frexp(np.abs(queries).max(axis=1, initial=0.0))
    return np.ldexp(queries, -np.maximum(scale, own - 60)[:, None])


def _build(table: pa.Table) -> pa.Table:
    """One shard's index as one row."""
    ids = table["cid"].to_numpy()
    order, sizes = Graph.order(ids)
    exact = _matrix(table["v"])[order]
    graph = Graph.build(np.ldexp(exact, -_scale(exact)), sizes)
    return pa.table({
        "dim": table["dim"].slice(0, 1), "shard": table["shard"].slice(0, 1), "ids": [ids[order].tobytes()], "vectors": [np.ascontiguousarray(exact).tobytes()],
        "sizes": [np.array(sizes, np.int64).tobytes()], "links": [b"".join(x.astype(np.int32).tobytes() for x in graph.levels)],
    })


def index(vectors: DataFrame, *, vec_id="vec_id", embedding="embedding", k: int = 10) -> tuple[DataFrame, DataFrame]:
    """(classes, shards): the folded vectors, and one row per shard with its graph."""
    classes = stored(_classes(_usable(vectors, vec_id, embedding), k), "vectors")
    shards = max(1, -(-classes.count() // SHARD))
    dealt = classes.select("cid", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"))
    built = dealt.groupBy("dim", "shard").applyInArrow(_build, "dim int, shard int, ids binary, vectors binary, sizes binary, links binary")
    return classes, stored(built, "graphs")


def _search(rows: DataFrame, k: int) -> DataFrame:
    """(query_id, cid, score): each query's k + 1 best classes of each shard.
    Each group's first row is a shard's graph; its query blocks follow."""

    def opened(ids: bytes, vectors: bytes, sizes: bytes, links: bytes, dim: int):
        exact, flat = np.frombuffer(vectors, np.float64).reshape(-1, dim), np.frombuffer(links, np.int32)
        levels, at = [], 0
        sizes = np.frombuffer(sizes, np.int64)
        for level, size in enumerate(sizes.tolist()):
            width = LINKS * (2 if level == 0 else 1)
            levels.append(flat[at : at + size * width].reshape(size, width).astype(np.int64))
            at += size * width
        scale = _scale(exact)
        return np.frombuffer(ids, np.int64), exact, scale, Graph(np.ldexp(exact, -scale), sizes.tolist(), levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = None
        for batch in batches:
            for i in range(batch.num_rows):
                dim, part, qids, qs, *graph = (batch.column(j)[i].as_py() for j in range(8))
                if part < 0:
                    here = opened(*graph, dim)
                    continue
                ids, exact, scale, graph = here
                qids, queries = np.array(qids, np.int64), np.array(qs, np.float64).reshape(-1, dim)
                for lo in range(0, len(queries), QUERIES):
                    q = queries[lo : lo + QUERIES]
                    found = graph.search(_near_shard(q, scale), EF_SEARCH)
                    none = found < 0
                    score = np.where(none, np.inf, exact_distances(q, exact, np.maximum(found, 0)))
                    cid = np.where(none, np.iinfo(np.int64).max, ids[np.maximum(found, 0)])
                    best = np.lexsort((cid, score), axis=1)[:, : k + 1]
                    score, cid, none = (np.take_along_axis(x, best, 1) for x in (score, cid, none))
                    r, c = np.nonzero(~none)
                    yield pa.RecordBatch.from_arrays([pa.array(qids[lo : lo + QUERIES][r]), pa.array(cid[r, c]), pa.array(score[r, c])], names=["query_id", "cid", "score"])

    return rows.select("dim", "part", "qids", "qs", "ids", "vectors", "sizes", "links").mapInArrow(run, "query_id bigint, cid bigint, score double")


def nearest(vectors: DataFrame, queries: DataFrame, *, vec_id="vec_id", embedding="embedding", k: int = 10) -> DataFrame:
    """Each query's k nearest rows, its own left out: query_id, rank, vec_id, score."""
    classes, graphs = index(vectors, vec_id=vec_id, embedding=embedding, k=k)
    asked = stored(_usable(queries, vec_id, embedding), "queries")
    parts = max(1, -(-asked.count() // QUERIES))
    blocks = asked.select("id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"))
    blocks = blocks.groupBy("dim", "part").agg(F.collect_list(F.struct("id", "v")).alias("x"))
    blocks = stored(blocks.select("dim", "part", (F.col("part") / TURNS).cast("int").alias("turn"), F.col("x.id").alias("qids"), F.flatten("x.v").alias("qs")), "blocks")
    # every block meets every shard of its length: blocks are sent to the shards, whose graph goes along once for TURNS blocks
    opening = graphs.join(blocks.select("dim", "turn").distinct(), "dim").withColumn("part", F.lit(-1))
    asking = blocks.join(graphs.select("dim", "shard"), "dim")
    rows = opening.unionByName(asking, allowMissingColumns=True).repartition("dim", "shard", "turn").sortWithinPartitions("dim", "shard", "turn", "part")
    found = _search(rows, k)
    best = Window.partitionBy("query_id").orderBy("score", "cid")
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    rows = found.join(classes.select("cid", "members"), "cid").select("query_id", "score", F.explode("members").alias("vec_id")).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
