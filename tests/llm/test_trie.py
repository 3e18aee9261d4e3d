"""The prefix trie against a plain version that lists every prefix."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tickstat.llm import trie as T


def _plain(convs: dict[int, list[tuple[str, str]]]) -> list[tuple]:
    nodes: dict[tuple, list[int]] = {}
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            nodes.setdefault(tuple(convs[c][:d]), []).append(c)
    name = {p: (m[0], len(p)) for p, m in nodes.items()}
    kids = {p: 0 for p in nodes}
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = {p: 0 for p in nodes}, {p: 0 for p in nodes}
    for p, m in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1].encode()) if p else 0)
    return sorted((name[p][0], len(p), name[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c in m if len(convs[c]) == len(p)).encode()).hexdigest()) for p, m in nodes.items())


def _rows(df) -> list[tuple]:
    return sorted(tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def _table(spark, convs, parts=4):
    rows = [(c, i * 3, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(parts)


def _some(n: int, seed: int) -> dict[int, list[tuple[str, str]]]:
    rng = random.Random(seed)
    convs = {}
    for c in rng.sample(range(-40, 4 * n), n):
        turns = [("u", rng.choice(["hi", "hé", "yo"])) for _ in range(rng.randint(1, 7))]
        if convs and rng.random() < 0.4:
            own = rng.choice(list(convs.values()))
            turns = own[: rng.randint(1, len(own))] + turns[: rng.randint(0, 3)]
        convs[c] = turns
    return convs


def test_component_totals():
    rng = np.random.default_rng(4)
    for n, reach in ((1, 1), (2, 1), (60, 60), (400, 3), (3000, 1)):
        parent = np.array([-1] + [rng.integers(max(0, i - reach), i) for i in range(1, n)])
        if n == 400:
            parent[[100, 300]] = -1  # a forest
        depth = np.zeros(n, int)
        for i in range(n):
            depth[i] = 0 if parent[i] < 0 else depth[parent[i]] + 1
        own, values = rng.integers(1, 9, n), rng.integers(0, 50, (n, 2))
        weight, wanted = own.copy(), values.copy()
        for i in range(n - 1, 0, -1):
            if parent[i] >= 0:
                weight[parent[i]] += weight[i]
                wanted[parent[i]] += wanted[i]
        assert (T.component_totals(parent, depth, weight, values) == wanted).all()


@pytest.mark.parametrize("bound,bits", [(6, 1), (40, 2)])
def test_trie_in_rounds(spark, monkeypatch, bound, bits):
    monkeypatch.setattr(T, "SPAN_BITS", bits)
    convs = _some(60, bound)
    convs |= {1000 + i: [("u", "hi"), ("a", "same")] for i in range(12)}
    convs[2000] = [("u", "hi")] + [("a", str(i % 3)) for i in range(45)]
    convs[2001] = convs[2000][:30] + [("a", "other")]
    assert _rows(T.prefix_trie(T.ranked(_table(spark, convs)), bound=bound)) == _plain(convs)


def test_ends_of_many_members(spark):
    convs = {c: [("u", "same")] for c in range(-3, 9000)} | {10_000: [("u", "same"), ("a", "more")]}
    got = _rows(T.prefix_trie(T.ranked(_table(spark, convs)), bound=500))
    assert got == _plain(convs)


def test_odd_turns(spark):
    rows = [(1, None, None, None), (1, 0, "u", ""), (1, 0, "u", ""), (1, 5, "u", "é" * 9000), (2, None, "", ""), (2, 1, "u", ""), (None, 0, "u", "lost"), (3, 2, "u", "x"), (3, 2, "u", "x")]
    frame = spark.createDataFrame([(*r, "k", 7) for r in rows], "conv_id bigint, turn bigint, role string, text string, conv string, place int")
    convs = {1: [("", ""), ("u", ""), ("u", ""), ("u", "é" * 9000)], 2: [("", ""), ("u", "")], 3: [("u", "x"), ("u", "x")]}
    assert _rows(T.prefix_trie(T.ranked(frame))) == _plain(convs)
    assert _rows(T.prefix_trie(T.ranked(frame.where("false")))) == []
    many = spark.range(9000).selectExpr("7L conv_id", "1L turn", "'u' role", "'x' text")  # one row, 9,000 times
    assert T.ranked(many).selectExpr("count(*)", "count(distinct place)", "min(place)", "max(place)").first()[:] == (9000, 9000, 1, 9000)


def test_regrafted(spark):
    rng = random.Random(3)
    convs = {c: [("u", str(rng.randint(0, 2))) for _ in range(rng.randint(1, 12))] for c in rng.sample(range(-9, 60), 45)}
    wanted = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        wanted[c] = convs.get(base, [])[:h] + own[h:]
    assert _rows(T.prefix_trie(*T.regrafted(T.ranked(_table(spark, convs))), bound=20)) == _plain(wanted)

