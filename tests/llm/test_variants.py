"""Spelling variants against a plain version that compares all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tickstat.llm import variants as V


def _one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def _plain(n: dict[str, int], ratio: int = 10) -> set[tuple]:
    near = {w: [x for x in n if _one_edit(w, x)] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w: str) -> str:
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def _rows(df) -> list[tuple]:
    return [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]


@pytest.mark.parametrize("alphabet,least,most,n", [("ab", 4, 9, 250), ("abcdé", 5, 8, 500), ("ÿab", 7, 11, 500)])
def test_near_words(spark, alphabet, least, most, n):
    rng = random.Random(most)
    words = {"".join(rng.choice(alphabet) for _ in range(rng.randint(least, most))): 0 for _ in range(n)}
    for w in list(words)[: n // 3]:  # and one edit of some of them
        i = rng.randrange(len(w))
        v = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(alphabet) + w[i:], w[:i] + rng.choice(alphabet) + w[i + 1 :]])
        if len(v) >= least:
            words[v] = 0
    n_of = {w: rng.choice([2, 2, 3, 20, 200, 2000, 20000]) for w in words}
    table = spark.createDataFrame(list(n_of.items()), "word string, n bigint").repartition(5)
    got = _rows(V.group(table, least=least))
    assert len(got) == len(n_of) and set(got) == _plain(n_of)


def test_pivots_are_the_cheapest_disjoint_pair():
    rng = np.random.default_rng(2)
    ranks = np.array([rng.permutation(40)[:9] for _ in range(300)])
    weights = (ranks // 3).astype(float)
    last, prefix, a, b = V.pivots(ranks, weights)
    for i in range(len(ranks)):
        pre = np.flatnonzero(ranks[i] <= np.sort(ranks[i])[2])
        assert prefix[i].nonzero()[0].tolist() == pre.tolist() and last[i] == np.sort(ranks[i])[2]
        assert weights[i, a[i]] + weights[i, b[i]] == min(weights[i, x] + weights[i, y] for x in pre for y in pre if y - x >= 2)
        assert b[i] - a[i] >= 2 and {a[i], b[i]} <= set(pre)


def test_whole_documents(spark):
    rows = [(1, "Recieved received RECEIVED received; received receivd", "x", 1), (1, "received received", "x", 2), (None, "received receivd received received", "y", 3),
            (2, None, "z", 4), (3, "", "z", 5), (4, "1 2 3 short", "z", 6), (5, "ÀÉÎõüßÿ Àéîõüßÿ " * 3 + "y" * 5000 + " " + "y" * 4999 + " " + "y" * 5000, "z", 7),
            (6, "received receive recéived receive " * 6, "z", 8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, run string, n int").repartition(3)
    count = Counter()
    for i, text, _, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            if h % 31 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            count[low] += 1
    runs = V.runs(docs)
    got = _rows(V.group(V.counts(runs.select(V.damaged(runs)))))
    assert len(got) == len(set(got)) and set(got) == _plain({w: n for w, n in count.items() if len(w) >= 7 and n >= 2})
    assert V.group(V.counts(V.runs(docs.where("doc_id = 2")).select("run"))).count() == 0

