"""Every text query against its SQL or a plain version, over whole tables, and odd inputs."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import plain
from tests.oracle_harness import compare
from tickstat.llm import bpe, decontaminate, hnsw, htmltext, idfiles, jaccard, licenses, pii, queries, shards, toxicity
from tickstat.llm.sql import SQL
from tickstat.llm.store import table

EXTRA = "id bigint, n bigint, row string, low string, key int, hits int, score string, shard int, part int, slot int, cell int, component string, base string, spans string, labels string, ids string"


@pytest.fixture(scope="module")
def texts(spark, sf_small):
    return {r.doc_id: r.text for r in table(spark, sf_small, "documents").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, a repeated row and further columns with names that the operators use."""
    rows = [(i, t) for i, t in enumerate(plain.ODD_TEXTS)] + [(5, plain.ODD_TEXTS[5])]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    return frame.select("doc_id", "text", *(F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in EXTRA.split(", ")))


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.where("false")


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf_small, name):
    assert compare(spark, sf_small, [name], verbose=False)[name] == "OK"


@pytest.fixture(scope="module")
def byte_library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(bpe.RANKS), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark, sf_small, texts, odd, nothing, byte_library):
    found = queries.op1_bpe(spark, sf_small).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = byte_library.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    back = {r.doc_id: r.text for r in bpe.decoded(bpe.encode(odd)).collect()}
    assert back == {i: t or "" for i, t in enumerate(plain.ODD_TEXTS)}
    assert bpe.encode(odd).count() == odd.count() and bpe.encode(nothing).collect() == []


def test_pii(spark, sf_small, texts, odd, nothing):
    named = lambda spans: ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)
    found = queries.op2_pii(spark, sf_small).collect()
    assert len(found) == len(texts)
    for r in found:
        want = plain.base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(named(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[3] == k for x in want) for k in pii.BASE_KINDS]
        spans = [(int(s), pii.KINDS.index(k)) for k, s, _ in (x.split(":") for x in r.spans.split(",") if x)]
        assert spans == sorted(spans) and {f"{k}:{s}:{e}" for s, _, e, k in want} <= set(r.spans.split(","))
    for r in pii.spans(odd).collect():
        assert [(x.s, x.rank - 1, x.e, x.kind) for x in r.base] == plain.base_spans(plain.ODD_TEXTS[r.doc_id])
    assert pii.spans(nothing).collect() == []


def test_pii_long_secrets_and_any_case(spark):
    long = "".join(f"aB{i}" for i in range(300))
    values = [f"token={long}", f"secret: {long[:128]}.{long}-{long}", f"token = \"{long[:200]}\"", f"Password: {long[:20]}", f"API_KEY={long[:20]}", f"x Secret={long[:40]}", "0123456789abcdef" * 20, "password=hunter2hunter2"]
    rows = [(i, f"see {v} here") for i, v in enumerate(values)] * 10
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    for r in pii.spans(frame).collect():
        assert [(x.kind, x.v) for x in r.spans][-1][0] == "secret"
        assert sum(len(x.v) for x in r.spans) >= len(values[r.doc_id]) - 2, values[r.doc_id]
    for r in pii.redact(frame).collect():
        assert "aB" not in r.text and "cdef" not in r.text and r.text.startswith("see "), r.text


def test_pii_on_hard_texts(spark):
    hard = ["a@b@c.d a@b.c%x@y.z 1.2.3.4.5.6.7.8 999.1.1.1 0000255.1.1.1", "+1 (555) 555-1234 +1 5 +12345678901234567 4111-1111-1111-1111-", "😀 4111111111111111 😀x@y.zé " + "1" * 5000 + " a@" + "b." * 4000 + "c +1" + " " * 3000 + "é", "1 " * 4000, "5 4111111111111111 1-4111111111111111"]
    rng = random.Random(5)
    hard += ["".join(rng.choice("a@.1+- 4(") for _ in range(rng.randint(1, 80))) for _ in range(300)]
    frame = spark.createDataFrame(list(enumerate(hard)), "doc_id bigint, text string")
    for r in pii.spans(frame).collect():
        assert [(x.s, x.rank - 1, x.e, x.kind) for x in r.base] == plain.base_spans(hard[r.doc_id])
        assert all(hard[r.doc_id][x.s : x.e] == x.v for x in r.spans)


def test_redaction(odd, nothing):
    clean = pii.redact(odd, length="n")
    assert clean.columns == odd.columns
    spans = {r.doc_id: r.spans for r in pii.spans(odd).collect()}
    for r in clean.collect():
        text, at, out = plain.ODD_TEXTS[r.doc_id], 0, ""
        assert set(plain.base_spans(text)) <= {(x.s, x.rank - 1, x.e, x.kind) for x in spans[r.doc_id]}
        for s, e, k in ((x.s, x.e, x.kind) for x in spans[r.doc_id]):
            if s >= at:
                out, at = out + text[at:s] + f"[{k.upper()}]", e
        assert r.text == (text if text is None else out + text[at:])
    assert pii.redact(nothing).collect() == []


def test_toxicity(spark, sf_mid, odd, nothing):
    labels = table(spark, sf_mid, "labels")
    found = queries.op3_toxicity(spark, sf_mid)
    rows = found.join(labels, "doc_id", "left").collect()
    assert len(rows) == table(spark, sf_mid, "documents").count()
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    held = [r for r in rows if r.held_out and r.toxic is not None]
    good = [r.score for r in held if r.toxic == 0]
    bad = [r.score for r in held if r.toxic == 1]
    assert np.mean([b > g for b in bad for g in good]) > 0.7 and np.mean([g >= 0.7 for g in good]) < 0.05
    # held-out labels are never seen
    turned = labels.withColumn("toxic", F.when(toxicity.in_fold(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.score(table(spark, sf_mid, "documents"), turned).collect()}
    assert again == {r.doc_id: r.score for r in rows}
    few = labels.limit(0)
    assert {r.score for r in toxicity.score(odd, few).collect()} == {0.5}
    assert toxicity.score(nothing, labels).collect() == [] and toxicity.without_toxic(odd, labels).columns == odd.columns
    null_labels = labels.select("doc_id", F.lit(None).cast("int").alias("toxic")).union(labels.select(F.lit(None).cast("bigint"), F.lit(1)))
    assert toxicity.score(odd, null_labels).count() == odd.count()


def test_ftrl_is_sparse_and_learns():
    rng = np.random.default_rng(0)
    model = toxicity.Ftrl(toxicity.Params(l1=0.004), 2000)
    rows = [(np.unique(np.append(rng.integers(100, 5000, 60), 7 if i % 5 == 0 else 8)), int(i % 5 == 0)) for i in range(2000)]
    for slots, y in rows:
        model.learn(slots, y)
    w = model.weights(np.arange(6000))
    assert w[7] > 1 and (w != 0).mean() < 0.2


def test_token_ids(spark, sf_small, texts, odd, nothing):
    library = Tokenizer.from_file(P.path(idfiles.VOCABULARY))
    start = 0
    for r in sorted(queries.op4_token_ids(spark, sf_small).collect()):
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    folder = idfiles.new_folder(spark)
    idfiles.write_ids(odd, folder)
    for r in idfiles.read_ids(spark, folder).collect():
        assert r.ids == library.encode(plain.ODD_TEXTS[r.doc_id] or "", add_special_tokens=False).ids + [2]
    rows = sorted(idfiles.checksums(spark, folder).collect())
    assert [r.start for r in rows] == np.concatenate([[0], np.cumsum([r.n_tokens for r in rows])])[:-1].tolist() and len(rows) == odd.count()
    empty = idfiles.new_folder(spark)
    idfiles.write_ids(nothing, empty)
    assert idfiles.checksums(spark, empty).collect() == []


def test_token_ids_lie_in_two_bytes_between_the_passes(spark, odd):
    folder = idfiles.new_folder(spark)
    idfiles.write_ids(odd, folder)
    rows = spark.read.parquet(f"{folder}/tokenized").collect()
    assert len(rows) == odd.count() and all(len(r.ids) == 2 * r.n_ids for r in rows)
    wide = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in idfiles.tokenized(odd).collect()}
    assert wide == {r.doc_id: np.frombuffer(r.ids, "<u2").tolist() for r in rows}
    # an id beyond two bytes
    idfiles.write_ids(odd, folder := idfiles.new_folder(spark), end=70_000)
    assert {r.doc_id: r.ids for r in idfiles.read_ids(spark, folder).collect()} == {i: x[:-1] + [70_000] for i, x in wide.items()}


def _near_copies(seed: int = 0) -> list[str]:
    """Texts of many sizes with copies changed a little, more, and a lot; blocks of one, two and many."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "a"]) if rng.random() < 0.3 else f"w{rng.randrange(4000)}"
    out = []
    for size in (1, 2, 3, 5, 12, 30, 60, 64, 70, 130, 300, 900):
        text = [word() for _ in range(size)]
        for edits in (0, 0, 1, 2, size // 60, size // 40, size // 25, size // 15, size // 8):
            copy = list(text)
            for _ in range(edits):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randrange(2)] = [word()] * rng.randrange(1, 3)
            out.append(" ".join(copy))
    passage = " ".join(word() for _ in range(50))
    out += [passage + " " + " ".join(word() for _ in range(rng.randrange(5, 90))) for _ in range(60)]
    base = [word() for _ in range(220)]
    for _ in range(90):  # a group that needs leaders: many rows, chained links
        base = list(base)
        base[rng.randrange(220)] = word()
        out.append(" ".join(base))
    return out


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 8, 10)])
def test_jaccard(spark, monkeypatch, k, num, den):
    monkeypatch.setattr(jaccard, "ROWS", 16)
    texts = _near_copies(k)
    random.Random(1).shuffle(texts)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    sets = {i: plain.shingles(t, k) for i, t in enumerate(texts)}
    want = plain.components(sets, num, den)
    found = jaccard.jaccard_classes(frame, words=k, similarity=(num, den)).collect()
    assert {r.doc_id: r.component_id for r in found} == want
    assert {r.doc_id: r.n_shingles for r in found} == {i: len(s) for i, s in sets.items()}
    kept = jaccard.without_copies(frame, words=k, similarity=(num, den))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_long_lists_lose_no_link():
    """Leaders, over chunks, keep connected whatever passes the bound."""
    rng = np.random.default_rng(0)
    for num, den in ((9, 10), (8, 10)):
        maps = [int(x) for x in rng.integers(0, 1 << 62, 6)]  # the lower half; the upper half stays as the group's number
        rows = []
        for m in maps:
            for _ in range(60):
                for _ in range(rng.integers(0, 4)):
                    m ^= 1 << int(rng.integers(0, 62))
                rows.append((m, int(rng.integers(28, 36)), maps.index(min(maps, key=lambda x: (x ^ m).bit_count()))))
        rng.shuffle(rows)
        ids, size = np.arange(len(rows)), np.array([r[1] for r in rows])
        m = np.array([[r[0], r[2]] for r in rows], np.int64).view(np.uint64)
        lists, found = jaccard._Lists(num, den), []
        for lo in range(0, len(rows), 50):
            s = slice(lo, lo + 50)
            found += list(lists.feed(np.zeros(len(ids[s]), np.int64), ids[s], m[s], (size[s] * 2) * 65536 + size[s]))
        a, b = (np.concatenate(x) for x in zip(*found))
        x, y = jaccard.forest(a, b)
        label = dict(zip(x.tolist(), y.tolist()))
        for i in range(len(rows)):
            gap = np.bitwise_count(m ^ m[i]).sum(axis=1).astype(int)
            for j in np.flatnonzero((gap * (den + num) <= (size + size[i]) * (den - num)) & (np.minimum(size, size[i]) * den >= np.maximum(size, size[i]) * num)):
                assert label.get(i, i) == label.get(int(j), int(j))


def test_jaccard_of_odd_texts(odd, nothing):
    sets = {i: plain.shingles(t, 5) for i, t in enumerate(plain.ODD_TEXTS)}
    found = jaccard.jaccard_classes(odd).collect()
    assert {r.doc_id: r.component_id for r in found} == plain.components(sets, 8, 10) and len(found) == odd.count()
    assert jaccard.jaccard_classes(nothing).collect() == [] and jaccard.without_copies(nothing).collect() == []
    assert jaccard.without_copies(odd).columns == odd.columns


def test_copies_with_repeated_and_null_ids(spark):
    words = lambda seed, n=40: " ".join(f"w{seed}x{i}" for i in range(n))
    a, b, c, d, e = map(words, range(5))
    rows = [(3, a), (5, a), (5, b), (5, b), (7, c), (7, c), (None, d), (None, d), (None, d + " end"), (None, c), (9, e), (8, e), (8, e), (None, "x"), (None, "x"), (1, "y")]
    frame = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, k int")
    kept = jaccard.without_copies(frame)
    assert kept.columns == frame.columns
    found = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(x for x in found if x[0] is not None) == [(1, "y"), (3, a), (5, b), (7, c), (8, e)]
    assert sorted(t.replace(" end", "") for i, t in found if i is None) == sorted([d, "x"])
    items = spark.createDataFrame([(1, words(0, 12)), (2, words(3, 12))], "item_id bigint, text string")
    assert sorted(r.k for r in decontaminate.clean(frame, items).collect()) == [k for k, (_, t) in enumerate(rows) if t not in (a, d, d + " end")]


def test_main_text(spark, sf_small):
    pages = table(spark, sf_small, "pages")
    found = queries.op6_main_text(spark, sf_small).collect()
    assert len(found) == pages.count() and all(r.n_chars == len(r.text) for r in found)
    want = {r.page_id: r.html for r in pages.collect()}
    for r in found:
        # the tables' own pages: headline and paragraphs of the article element
        body = want[r.page_id].split("<article>")[1].split("</article>")[0]
        for tag in ("</p>", "<p>", "<h1>", "</h1>", "<br>"):
            body = body.replace(tag, "\n")
        lines = [" ".join(htmltext.html.unescape(x.replace("<b>", "")).split()) for x in body.split("\n")]
        assert " ".join(r.text.split()) == " ".join(x for x in lines if x)
    frame = spark.createDataFrame([(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<article>a", "x"), (2, None, "", "x")], "page_id bigint, url string, html string, text string")
    assert sorted((r.text, r.n_chars) for r in htmltext.extract(frame).collect()) == [("", 0), ("", 0), ("", 0), ("a", 1)]
    assert htmltext.extract(frame.where("false")).collect() == []


def test_licenses(spark, sf_small, texts, odd, nothing):
    def want(text):
        w, places, labels = plain.alnum_words(text), [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))

    for r in queries.op7_licenses(spark, sf_small).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    found = licenses.scan(odd).collect()
    assert len(found) == odd.count()
    for r in found:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, ",".join(r.base_labels)) == want(plain.ODD_TEXTS[r.doc_id])
    more = ["GNU General Public License, version 3. This work is licensed under the", "this work is licensed under the GNU General Public License (version 3)", "a gnu in a public place", "All rights reserved", "cc by nc cc by nc", "Licensed under CC BY 4.0"]
    rows = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(more)), "doc_id bigint, text string")).collect()}
    assert rows[1].labels == ["gpl-3"] and rows[2].labels == [] and rows[3].labels == ["all-rights-reserved"] and rows[4].n_base == 2 and rows[5].labels == ["cc-by"]
    assert licenses.scan(nothing).collect() == []


def test_licenses_of_files_with_whole_notices(spark):
    notice = {label: text for label, _, text in licenses.TEMPLATES}  # the last of each label
    two = [(a, b) for a in ("mit", "apache-2", "gpl-3", "bsd", "isc") for b in ("mit", "apache-2", "gpl-3", "bsd", "all-rights-reserved") if a != b]
    files = [(x,) for x in notice] + two
    # other files, in which the templates' words are more and less common
    other = ["some words of a common text", "this software is provided as is with permission", "the public domain license", "free"] * 30
    rows = [(i, " ; ".join(notice[x] for x in f)) for i, f in enumerate(files)] + [(1000 + i, t) for i, t in enumerate(other)]
    found = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, f in enumerate(files):
        assert set(f) <= set(found[i].labels) and found[i].score > 0.99, f
    half = "permission is hereby granted free of charge to all"
    twice = spark.createDataFrame([(1, half), (1, half), (2, "x")], "doc_id bigint, text string")
    assert [r.labels for r in licenses.scan(twice).collect()] == [[], [], []]  # repeated rows don't add up


def _exact(rows, asked, k=10):
    out = {}
    for q, v in asked:
        near = sorted((float(np.sqrt(((np.array(x) - np.array(v)) ** 2).sum())), i) for i, x in rows if i != q and len(x) == len(v))
        out[q] = near[:k]
    return out


def test_licenses_over_line_breaks_and_usual_notices(spark):
    fsf = "is free software: you can redistribute it and/or modify it\nunder the terms of the GNU {}General Public License as published by\nthe Free Software Foundation, either version {} of the License, or\n(at your option) any later version."
    want = {
        "All rights\nreserved": ["all-rights-reserved"], "All  rights \t reserved.": ["all-rights-reserved"], "This is free and unencumbered software released into the public\ndomain.": ["public-domain"],
        "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007": ["gpl-3"], "GNU GENERAL PUBLIC LICENSE Version 2, June 1991": ["gpl-2"], "// SPDX-License-Identifier: GPL-3.0-or-later": ["gpl-3"],
        "# SPDX-License-Identifier: MIT": ["mit"], "SPDX-License-Identifier: BSD-2-Clause": ["bsd-2"], "SPDX-License-Identifier: LGPL-2.1": ["lgpl-2"], fsf.format("", 3): ["gpl-3"], fsf.format("", 2): ["gpl-2"],
        fsf.format("Affero ", 3): ["agpl-3"], fsf.format("Lesser ", 3): ["lgpl", "lgpl-3"],
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.": ["bsd", "bsd-3"],
        "the rights of the public are reserved in this domain": [], "a permission slip": [],
    }
    docs = spark.createDataFrame(list(enumerate(want)), "doc_id bigint, text string")
    found = {r.doc_id: list(r.labels) for r in licenses.scan(docs).collect()}
    texts = list(want)
    assert {texts[i]: x for i, x in found.items()} == want


def test_neighbours(spark, sf_small):
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf_small, "embeddings").collect()]
    want = _exact(rows, [r for r in rows if r[0] % 100 == 0])
    found = {}
    for r in queries.op8_neighbours(spark, sf_small).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = 0
    for q, near in want.items():
        own = sorted(found[q])
        assert [x[0] for x in own] == list(range(1, len(near) + 1)) and [x[2] for x in own] == sorted(x[2] for x in own)
        hit += len({x[1] for x in own} & {i for _, i in near})
    assert hit >= 0.95 * sum(map(len, want.values()))


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [None, 1.0]), (5, [-0.0, 1.0]), (6, [0.0, 1.0]), (7, [0.0, 1.0]), (8, [1.0, 2.0, 3.0]), (9, [inf, 0.0]), (10, []), (100, [0.0, 1.0]), (None, [1.0, 1.0])]
    odd += [(i, [2.0, 2.0]) for i in range(200, 260)]
    frame = spark.createDataFrame(odd, "vec_id bigint, embedding array<float>").withColumn("id", F.lit("x")).withColumn("shard", F.lit("y"))
    good = [(i, v) for i, v in odd if i in (0, 5, 6, 7, 8, 100) or (i or 0) >= 200]
    found = {}
    for r in hnsw.nearest(frame, frame.where("vec_id % 100 = 0")).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    assert {q: [(s, i) for _, s, i in sorted(x)] for q, x in found.items()} == {q: x for q, x in _exact(good, [g for g in good if g[0] % 100 == 0]).items() if x}
    assert hnsw.nearest(frame.where("false"), frame.where("false")).collect() == []


@pytest.mark.parametrize("size", [1e-300, 1e-30, 1.0, 1e20, 1e300])
def test_neighbours_of_any_finite_size(spark, size):
    rng = np.random.default_rng(3)
    few = [(i, (rng.normal(size=4) * size).tolist()) for i in (0, 1, 2, 100, 200)] + [(300, [size, 0.0, 0.0])]
    found = {}
    for r in hnsw.nearest(spark.createDataFrame(few, "vec_id bigint, embedding array<double>"), spark.createDataFrame(few, "vec_id bigint, embedding array<double>").where("vec_id % 100 = 0")).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score / size))
    plain_ = {i: np.array(v) / size for i, v in few}
    for q in (0, 100, 200):
        want = sorted((np.linalg.norm(plain_[q] - v), i) for i, v in plain_.items() if i != q and len(v) == 4)
        assert [x[1] for x in sorted(found[q])] == [i for _, i in want] and np.allclose([x[2] for x in sorted(found[q])], [d for d, _ in want], rtol=1e-9)
    assert 300 not in found


def test_graph_of_tiny_and_huge_vectors():
    rng = np.random.default_rng(5)
    for size in (1e-25, 1e-200, 1e150):
        x = rng.normal(size=(600, 12)) * size
        table = hnsw._build(pa.table({"cid": np.arange(600), "v": pa.array(x.tolist()), "dim": np.full(600, 12, np.int32), "shard": np.zeros(600, np.int32)}))
        ids, sizes = np.frombuffer(table["ids"][0].as_py(), np.int64), np.frombuffer(table["sizes"][0].as_py(), np.int64)
        flat, levels, at = np.frombuffer(table["links"][0].as_py(), np.int32), [], 0
        for level, n in enumerate(sizes.tolist()):
            width = hnsw.LINKS * (2 if level == 0 else 1)
            levels.append(flat[at : at + n * width].reshape(n, width).astype(np.int64))
            at += n * width
        graph = hnsw.Graph(np.ldexp(x[ids], -hnsw._scale(x)), sizes.tolist(), levels)
        q = x[:50]
        found = ids[np.maximum(graph.search(hnsw._near_shard(q, hnsw._scale(x)), 64), 0)]
        near = np.argsort((((q[:, None] - x[None]) / size) ** 2).sum(2), axis=1)[:, :10]
        assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(found, near)]) > 0.97


def test_neighbours_over_shards(spark, sf_small, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD", 100)
    monkeypatch.setattr(hnsw, "QUERIES", 2)
    test_neighbours(spark, sf_small)


def test_shards(spark, sf_small, texts, odd, nothing):
    found = queries.op9_shards(spark, sf_small).toPandas()
    assert sorted(found.doc_id) == sorted(texts) and set(found.law) == {"bytes"} and found.grown_shard.isna().all()
    body = [(texts[i] or "").encode() for i in found.doc_id]
    assert found["size"].tolist() == [len(b) + 16 for b in body] and found.text_crc32.tolist() == [zlib.crc32(b) for b in body]
    assert found.groupby(body).shard.nunique().max() == 1 and found.shard.between(0, 39).all()
    for _, part in found.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    small = shards.by_bytes(odd, 4).toPandas()
    assert len(small) == odd.count() and all(sorted(p.slot) == list(range(len(p))) for _, p in small.groupby("shard"))
    assert shards.by_bytes(nothing, 4).collect() == []


def test_shards_with_a_hot_text(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i} " * (i % 7)) for i in range(3000)] + [(None, "no id"), (None, None)]
    found = shards.by_bytes(spark.createDataFrame(rows, "doc_id bigint, text string"), 8).toPandas()
    assert found[found.doc_id % 3 == 0].shard.nunique() == 1
    for _, part in found.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    rest = found.groupby("shard")["size"].sum().sort_values()
    assert len(rest) == 8 and rest.iloc[-2] < 1.2 * rest.iloc[:-1].mean()


def test_decontamination_of_odd_texts(spark, odd, nothing):
    long = " ".join(f"w{i}" for i in range(40))
    items = {1: long, 2: "One two", 3: "", 4: None, 5: "a b c", 6: "the the the the the the the the the the the", 7: "one", 8: "x " + " ".join(f"w{i}" for i in range(5, 14)) + " y", 9: long.upper()}
    bodies = plain.ODD_TEXTS + [f"start {long} end", "w3 " + " ".join(f"w{i}" for i in range(20, 30)) + ", tail", " ".join(f"w{i}" for i in range(20, 29)), f"{long} {long}", "one one. ONE"]
    frame = spark.createDataFrame(list(enumerate(bodies)), "doc_id bigint, text string")
    benchmark = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    found = {r.doc_id: r for r in decontaminate.decontaminate(frame, benchmark).collect()}
    for i, body in enumerate(bodies):
        places, hit = plain.hits(body, items)
        r = found[i]
        assert (r.n_words, r.n_hit, set(r.items), r.contaminated) == (len(plain.alnum_words(body)), len(places), hit, bool(places))
        assert {p for s in r.spans for p in range(s.first, s.end)} == places
    clean = {r.doc_id for r in decontaminate.clean(frame, benchmark).collect()}
    assert clean == {i for i, r in found.items() if not r.contaminated}
    assert {r.n_hit for r in decontaminate.decontaminate(odd, benchmark.where("false")).collect()} == {0}
    assert decontaminate.clean(odd, benchmark).columns == odd.columns and decontaminate.decontaminate(nothing, benchmark).collect() == []


def test_pipeline(spark, sf_small, texts, byte_library):
    """The whole pipeline against plain versions of its stages (the learned parts as learned)."""
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_small).collect()}
    toxic = {r.doc_id for r in queries.op3_toxicity(spark, sf_small).where("predicted = 1").collect()}
    left = {i: t for i, t in texts.items() if i not in toxic}
    classes = plain.components({i: plain.shingles(t, 5) for i, t in left.items()}, 8, 10)
    left = {i: left[i] for i in set(classes.values())}
    items = {r.item_id: r.text for r in table(spark, sf_small, "benchmark").collect()}
    left = {i: t for i, t in left.items() if not plain.hits(t, items)[0]}
    assert set(found) == set(left)
    for i, r in found.items():
        ids = byte_library.encode_ordinary(left[i])
        assert r.ids == ids or (("[" in byte_library.decode(r.ids)) and "@" not in byte_library.decode(r.ids))


def test_stages_keep_the_columns(spark, sf_small):
    docs = table(spark, sf_small, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_small).schema.simpleString() == docs.schema.simpleString()
