"""Connected components in few rounds."""

import random

import pytest

from tickstat.llm import components as C


def _plain(links) -> dict[int, int]:
    label = {x: x for a, b in links if a is not None and b is not None and a != b for x in (a, b)}

    def root(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = sorted((root(a), root(b)))
            label[y] = x
    return {x: root(x) for x in label}


def _got(spark, links):
    frame = spark.createDataFrame(links, "x bigint, y bigint").repartition(4)
    rows = C.components(frame).collect()
    found = {r.node: r.component for r in rows}
    assert len(found) == len(rows)
    return found


def test_random_links(spark):
    rng = random.Random(1)
    links = [(rng.randint(-400, 400), rng.randint(-400, 400)) for _ in range(350)] + [(7, 7), (900, 901), (900, 901), (None, 3), (5, None)]
    assert _got(spark, links) == _plain(links)
    assert _got(spark, [(1, 1), (None, None)]) == {} == _got(spark, [])


@pytest.mark.parametrize("shape", ["path", "star"])
def test_rounds_grow_with_the_logarithm(spark, monkeypatch, shape):
    n, rounds = 10_000, []
    plain = C.stored

    def counted(df, name):
        rounds.append(name)
        return plain(df, name)

    monkeypatch.setattr(C, "stored", counted)
    if shape == "path":
        links = [(i, i + 1) for i in range(n)]
    else:
        links = [(n // 2, i) for i in range(n) if i != n // 2]
    found = _got(spark, links)
    assert len(found) >= n and set(found.values()) == {0}
    assert rounds.count("labels") <= 30
