"""The secret scan: fixed spans against plain patterns, Viterbi against a plain one, held-out recall."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import plain
from tickstat.llm import blocks as B, secretscan as S
from tickstat.llm.queries import QUERIES
from tickstat.llm.store import table

ODD = plain.ODD_TEXTS + [
    "PassWord: 'abc123' passwd=abc12 secrettoken = \"x/y+z=.-_\" api_key:apikey=zzzzzz", "é token==AbCdEf0123456789AbCd " * 3, "AKIA" + "A" * 15 + " AKIA" + "B" * 16 + "x",
    "0123456789abcdef0123456 0123456789abcdef01234567" + "g" + "f" * 30, "token = \"" + "/".join(["ab" * 12] * 6) + "\" tail", "ſecret: abcdefg toKen: abcdefg",
]


def _plain_base(text: str | None) -> list[tuple[int, int, int]]:
    text, out = text or "", []
    word = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password") + "|" + "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in ("passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
    for rank, pattern, ok in ((0, rf"({word})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 6), (1, "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), (2, "[0-9a-f]+", lambda m: len(m[0]) >= 24)):
        out += [(m.start(), rank, m.end()) for m in re.finditer(pattern, text) if ok(m)]
    return sorted(out)


@pytest.fixture(scope="module")
def field():
    lines = S.made_lines(10)
    return S.fit([x for x, _ in lines], [y for _, y in lines])


def _tagged(field, texts) -> list[list[str]]:
    data, offsets = B.text_bytes(pa.array(texts))
    found = S._found(field, data, offsets, 0, len(texts))
    return [[t.encode()[a:b].decode() for a, b in found.get(i, [])] for i, t in enumerate(texts)]


def test_viterbi_is_that_of_the_whole_text():
    rng = np.random.default_rng(1)
    for n, rows, spread in ((1, 1, 1.0), (40, 5, 1.0), (300, 20, 3.0), (300, 1, 0.3)):
        move = rng.normal(size=(3, 3))
        scores = (rng.normal(size=(n, 3)) * spread * 2).astype(np.float32)
        row = np.sort(rng.integers(0, rows, n))
        got = S.Field(np.zeros((0, 3)), move).tags(scores, row)
        for r in np.unique(row):
            at = np.flatnonzero(row == r)
            best, back = move[0] + scores[at[0]], []
            for i in at[1:]:
                paths = best[:, None] + move
                back.append(paths.argmax(0))
                best = paths.max(0) + scores[i]
            tag = int((best + move[:, 0]).argmax())
            wanted = [tag]
            for b in back[::-1]:
                wanted.append(int(b[wanted[-1]]))
            assert got[at].tolist() == wanted[::-1]


def test_features_do_not_depend_on_parts(field, monkeypatch):
    data, offsets = B.text_bytes(pa.array(["a token = \"x9\" b", "", "Über 12 c\nd e" * 20]))
    tokens = S.Tokens(data, offsets, 0, 3)
    whole = field.scores(tokens)
    monkeypatch.setattr(S, "PART", 7)
    assert (field.scores(tokens) == whole).all()


def test_new_lines_made_by_rule(field):
    """Lines with values that the field has not seen."""
    lines = S.made_lines(25)[10 * (len(S.SECRET_LINES) + len(S.PLAIN_LINES)) :]
    got = _tagged(field, [x for x, _ in lines])
    wanted = [[x[a:b] for a, b in s] for x, s in lines]
    secret = [g == w for g, w in zip(got, wanted) if w]
    assert len(secret) >= 300 and np.mean(secret) >= 0.95
    assert np.mean([not g for g, w in zip(got, wanted) if not w]) >= 0.99


def test_secrets_of_other_shapes_and_plain_text(field):
    found = _tagged(field, ["X-Api-Token: kJ8sd7fH3kLs9Df7GhsK2", "ssh key AAAAB3NzaC1yc2EAAAADAQABAAABgQC7", "mongodb://svc:Gh7Kq92LmPz@mongo.internal/x"])
    assert found == [["kJ8sd7fH3kLs9Df7GhsK2"], ["AAAAB3NzaC1yc2EAAAADAQABAAABgQC7"], ["Gh7Kq92LmPz"]]
    assert not any(_tagged(field, ["the quick brown fox", "mail a@b.example.com or 192.168.1.1", "card 4111 1111 1111 1111 and +49 30 1234567", "der Krieg 1945 zu Ende. Über 200", "a" * 30, "w " * 3000, ""]))


def test_odd_texts(spark):
    rows = [(i, t, None, 7) for i, t in enumerate(ODD)] + [(3, ODD[3], None, 7), (None, ODD[-1], None, 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, id string, base int")
    got = S.find(docs).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == sorted((r[0] is not None, r[0] or 0) for r in rows)
    for r in got:
        own = ODD[-1 if r.doc_id is None else r.doc_id]
        base = [(x.s, S.KINDS.index(x.kind), x.e) for x in r.base]
        spans = [(x.s, S.KINDS.index(x.kind), x.e) for x in r.spans]
        assert base == _plain_base(own) and spans == sorted(spans) and set(base) <= set(spans)
        assert all(x.v == own[x.s : x.e] for x in r.spans)
        added = [x for x in spans if x[1] == 3]
        assert not any(a < e and s < b for a, _, b in base for s, _, e in added)
    assert S.find(docs.where("false")).collect() == []


def test_added_spans_and_places(spark):
    secret = "kJ8sd7fH3kLs9Df7GhsK2"
    text = "ééé Bearer " + secret + " ü\npassword: abcdef12\nX-Key: " + secret
    [r] = S.find(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()
    assert [(x.kind, x.s) for x in r.spans] == [("tagged", 11), ("assign", text.index("password")), ("tagged", text.rindex(secret))]
    assert [x.v for x in r.spans if x.kind == "tagged"] == [secret, secret]


def test_query_and_held_out_recall(spark, sf_mid):
    texts = {r.doc_id: r.text for r in table(spark, sf_mid, "documents").select("doc_id", "text").collect()}
    for r in QUERIES["op11_secrets"](spark, sf_mid).collect():
        base = _plain_base(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in base) for i in range(3))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{S.KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest()
        assert {f"{S.KINDS[k]}:{s}:{e}" for s, k, e in base} <= set(r.spans.split(",")) or not base
    rows = table(spark, sf_mid, "documents").selectExpr("doc_id id", "text")
    field = S.train(rows.where("id % 2 = 0"))
    other = [t for i, t in texts.items() if i % 2 and t]
    got = _tagged(field, other)
    wanted = [[t[v:e] for _, k, e, v in S.base_spans(t) if k < 2] for t in other]
    hits = [x in g for g, w in zip(got, wanted) for x in w]
    assert len(hits) >= 4 and np.mean(hits) >= 0.9
    assert sum(bool(g) for g, w in zip(got, wanted) if not w) <= 0.01 * len(other)


def test_windows_keep_values_whole():
    rng = random.Random(2)
    for _ in range(50):
        text = " ".join(rng.choice(["word", "token = \"" + "ab12" * 8 + "\"", "x" * 40]) for _ in range(30))
        for part, marks in S.windows(text, rng.randrange(10**6)):
            assert all(re.fullmatch("[a-z0-9]+", part[a:b]) for a, b in marks)
