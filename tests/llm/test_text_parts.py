"""Word blocks, rank-file encoding and the id file coding, without Spark."""

import base64
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from tests.llm import plain
from tickstat.llm import blocks as B, bpe, hnsw, htmltext, idfiles, jaccard, pii, shards
from tickstat.llm.pieces import Pieces


def _random_texts(n: int, alphabet: str, most: int = 60, seed: int = 1) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, most))) for _ in range(n)]


@pytest.mark.parametrize("table,split", [(B.ALNUM, plain.alnum_words), (B.SPACED, plain.spaced_words)])
def test_words_have_one_hash_each(table, split):
    texts = plain.ODD_TEXTS + _random_texts(300, "aAbB 1é\n\t-\x00.")
    data, offsets = B.text_bytes(pa.array(texts))
    names, i = {}, 0
    for lo, hi in B.row_blocks(offsets, 700):
        row, h, _, _ = B.words(data, offsets, lo, hi, table)
        limits = B.row_limits(row, hi - lo)
        for r in range(hi - lo):
            words = split(texts[lo + r])
            got = h[limits[r] : limits[r + 1]].tolist()
            assert len(got) == len(words)
            for w, x in zip(words, got):
                assert names.setdefault(x, w) == w
        i += hi - lo
    assert i == len(texts) and len(set(names.values())) == len(names)


def test_span_hashes_do_not_depend_on_parts(monkeypatch):
    codes = np.random.default_rng(0).integers(1, 255, 5000).astype(np.uint8)
    start = np.arange(0, 4990, 7)
    end = start + 5
    whole = B.span_hashes(codes, start, end)
    monkeypatch.setattr(B, "BLOCK_BYTES", 64)
    assert (B.span_hashes(codes, start, end) == whole).all()


def test_bpe_equals_library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(bpe.RANKS), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    table = bpe.ranks(P.path(bpe.RANKS))
    coder = bpe.Encoder(table)
    texts = [t or "" for t in plain.ODD_TEXTS] + ["it's I'LL 'tis ' s 's you'd've", " a  b \n\n d", "a　b\x85c\x1cd", "二十 ①² 𝟘 ٣٤", "a" * 700 + " " * 90, "<|endoftext|>"]
    texts += _random_texts(1500, "ab 'strevlmd\n\t1é! 日😀", seed=3)
    data, offsets = B.text_bytes(pa.array(texts))
    for lo, hi in B.row_blocks(offsets, 20_000):
        ids, limits = coder.encode(data, offsets, lo, hi)
        for i in range(lo, hi):
            own = ids[limits[i - lo] : limits[i - lo + 1]]
            assert own.tolist() == library.encode_ordinary(texts[i])
            assert bpe.decode(own, table).tobytes().decode() == texts[i]


def test_bpe_keeps_a_bounded_number_of_pieces(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 50)
    table = bpe.ranks(P.path(bpe.RANKS))
    small, large = bpe.Encoder(table), None
    texts = _random_texts(400, "abcdefgh ", 40, 9)
    data, offsets = B.text_bytes(pa.array(texts))
    found = [small.encode(data, offsets, i, i + 1)[0].tolist() for i in range(len(texts))]
    assert len(small.hash) <= 50 + 40
    monkeypatch.undo()
    large = bpe.Encoder(table)
    assert found == [large.encode(data, offsets, i, i + 1)[0].tolist() for i in range(len(texts))]


@pytest.mark.parametrize("part", [7, 40, 300])
def test_bpe_of_texts_cut_into_parts(monkeypatch, part):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(bpe.RANKS), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    monkeypatch.setattr(bpe, "PART", part)
    monkeypatch.setattr(bpe, "REPLAY", 64)
    coder = bpe.Encoder(bpe.ranks(P.path(bpe.RANKS)))
    texts = _random_texts(1500, "ab 'strevlmd\n\t1é! 日😀　二x", 120, 5) + ["日本" * 50 + "。" + "語" * 30, "it's I'll 's'll" * 20, "", "a" * 900]
    data, offsets = B.text_bytes(pa.array(texts))
    ids, limits = coder.encode(data, offsets, 0, len(texts))
    for i, t in enumerate(texts):
        assert ids[limits[i] : limits[i + 1]].tolist() == library.encode_ordinary(t)
        raw = np.frombuffer(t.encode(), np.uint8)
        assert b"".join(p.tobytes() for p in bpe.parts(raw, part)) == t.encode()


def test_bpe_tells_pieces_with_one_hash_apart(monkeypatch):
    table = bpe.ranks(P.path(bpe.RANKS))
    texts = _random_texts(200, "abcde fgh", 60, 7)
    data, offsets = B.text_bytes(pa.array(texts))
    right, right_limits = bpe.Encoder(table).encode(data, offsets, 0, len(texts))
    plain_hash = bpe._piece_hash
    poor = lambda codes, a, b: plain_hash(codes, a, b) >> np.uint64(58)
    check = bpe._check_hash(data, offsets[:-1], offsets[1:])
    monkeypatch.setattr(bpe, "_piece_hash", poor)
    monkeypatch.setattr(bpe, "_check_hash", lambda codes, a, b: plain_hash(bpe._OTHER_BYTES[codes], a, b))
    assert (bpe._check_hash(data, offsets[:-1], offsets[1:]) == check).all()
    found, limits = bpe.Encoder(bpe.Ranks(P.path(bpe.RANKS))).encode(data, offsets, 0, len(texts))
    assert (found == right).all() and (limits == right_limits).all()


def test_one_text_of_64_mb_needs_little_memory():
    """In a process of its own, so that its peak is its own."""
    code = """
import hashlib, resource, numpy as np, public_tokenizers as P
from tickstat.llm import bpe
rng = np.random.default_rng(1)
words = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(1, 9))) for _ in range(30000)]
one = " ".join(words) + "\\n"
raw = np.frombuffer((one * (1 + (64 << 20) // len(one))).encode(), np.uint8)
table = bpe.ranks(P.path(bpe.RANKS))
coder = bpe.Encoder(table)
first = coder._part(raw[: len(one)], np.array([len(one)]))[0]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
back, n = hashlib.sha256(), 0
for part in bpe.parts(raw, bpe.PART):
    ids, _ = coder._part(part, np.array([len(part)]))
    n += len(ids)
    back.update(bpe.decode(ids, table).tobytes())
assert back.hexdigest() == hashlib.sha256(raw.tobytes()).hexdigest()
assert abs(n - len(first) * (len(raw) // len(one))) <= 2 * len(raw) // len(one)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    import subprocess
    import sys

    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) < 250, done.stdout


def test_merge_out_of_rank_order():
    """A rank file in which a merge opens a pair of lower rank."""
    table = object.__new__(bpe.Ranks)
    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"bc", b"xa", b"xabc"]
    path = None
    import os
    import tempfile

    with tempfile.NamedTemporaryFile("wb", suffix=".tiktoken", delete=False) as f:
        for r, t in enumerate(tokens):
            f.write(base64.b64encode(t) + b" " + str(r).encode() + b"\n")
        path = f.name
    table = bpe.Ranks(path)
    os.unlink(path)
    rng = random.Random(4)
    pieces = ["".join(rng.choice("abcx") for _ in range(rng.randint(1, 14))).encode() for _ in range(500)]
    limits = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
    ids, ends = bpe.replay(np.frombuffer(b"".join(pieces), np.uint8), limits, table, bands=4)
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [table.plain(p) for p in pieces]


def test_id_coding_round_trip():
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.integers(0, most, 60) for most in (200, 256, 257, 65536, 65537, 1 << 24, 1 << 32)]).astype(np.uint32)
    counts = np.array([0, 1, 2, 3, 4, 5, 100, 0, 205, 100])
    control, n_control, data, n_data = idfiles.pack(values, counts)
    assert (idfiles.unpack(control, data, counts) == values).all()
    assert n_control.sum() == len(control) and n_data.sum() == len(data)
    assert len(idfiles.unpack(control[:0], data[:0], np.zeros(0, int))) == 0


class _Counted:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, own):
        self.own, self.texts = own, 0

    def encode_batch(self, texts, **options):
        self.texts += len(texts)
        return self.own.encode_batch(texts, **options)

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.own.encode_batch_fast(texts, **options)


def test_letter_pieces_go_to_the_library_together(monkeypatch):
    path = P.path(idfiles.VOCABULARY)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgXYZéÉßÿÞñ") for _ in range(rng.randint(1, 12)))
    texts = [" ".join(word() for _ in range(50)) for _ in range(60)]
    kinds = idfiles._tools(path)
    counted = [_Counted(x[0] if isinstance(x, tuple) else x) for x in kinds[:-1]]
    fresh = [(c, *x[1:]) if isinstance(x, tuple) else c for c, x in zip(counted, kinds[:-1])]
    monkeypatch.setitem(idfiles._WORDS, path, (*fresh, Pieces(idfiles.CACHE)))
    data, offsets = B.text_bytes(pa.array(texts))
    ids, limits = idfiles.block_ids(data, offsets, 0, len(texts), path)
    library = Tokenizer.from_file(path)
    assert [ids[a:b].tolist() for a, b in zip(limits[:-1], limits[1:])] == [library.encode(x, add_special_tokens=False).ids for x in texts]
    assert sum(c.texts for c in counted) <= 20  # some 2,700 different words


@pytest.mark.parametrize("bound", [5, 60, 600_000])
def test_ids_of_odd_texts_are_the_librarys(monkeypatch, bound):
    path = P.path(idfiles.VOCABULARY)
    parts = [*"aBzéÉßÿŸ×÷Þñ\u0301'’st7½²İΣςµª \n\u00a0\u2003-.中😀\x00\x01\x7fﬁ", "A\u030a", "K", "<|endoftext|>", "ll", "the", "\u200d", "ẞ"]
    rng = random.Random(bound)
    texts = plain.ODD_TEXTS + ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(600)]
    texts += [x.replace("<|endoftext|>", "") if x else x for x in texts]
    monkeypatch.setitem(idfiles._WORDS, path, (*idfiles._tools(path)[:-1], Pieces(bound)))
    data, offsets = B.text_bytes(pa.array(texts))
    library, found = Tokenizer.from_file(path), []
    for lo, hi in B.row_blocks(offsets, 500):
        ids, limits = idfiles.block_ids(data, offsets, lo, hi, path)
        found += [ids[a:b].tolist() for a, b in zip(limits[:-1], limits[1:])]
    assert found == [library.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_pieces_met_again_stay_when_room_is_made():
    pieces = Pieces(4)
    hashes = lambda *x: np.array(x, np.uint64)
    pieces.add(hashes(7, 5, 9), np.array([70, 71, 50], np.int32), np.array([2, 1, 0]))
    assert pieces.places(hashes(5, 9)).tolist() == [1, 2]
    assert pieces.places(hashes(1, 5, 2)).tolist() == [-1, 0, -1]  # over the bound: 7 went
    at = np.concatenate([pieces.places(hashes(5, 9)), pieces.add(hashes(1, 2), np.array([10, 20, 21], np.int32), np.array([1, 2]))])
    ids, limits = pieces.fill(at[[3, 0, 1, 2]])
    assert ids.tolist() == [20, 21, 50, 10] and limits.tolist() == [0, 2, 3, 3, 4]
    assert pieces.places(hashes(11, 12, 13, 14)).tolist() == [-1] * 4 and len(pieces.hash) == 0


def test_forest_and_overlaps():
    rng = np.random.default_rng(0)
    for _ in range(50):
        n, m = int(rng.integers(2, 50)), int(rng.integers(1, 60))
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        x, y = jaccard.forest(a, b)
        links = lambda p, q: plain.components({i: {i} for i in range(n)}, 1, 1) if not len(p) else _reach(n, p, q)
        assert links(a, b) == links(x, y) and len(x) < n
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40))).astype(np.uint64) for _ in range(40)]
    shared = jaccard.overlaps(sets)
    assert all(shared[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(40) for j in range(40))


def _reach(n, a, b):
    label = list(range(n))
    for _ in range(n):
        for u, v in zip(a.tolist(), b.tolist()):
            label[u] = label[v] = min(label[u], label[v])
    return dict(enumerate(label))


def test_minimax_cuts_are_optimal():
    rng = random.Random(2)

    def best(sizes, k):
        if k == 1:
            return sum(sizes)
        return min(max(sum(sizes[:i]), best(sizes[i:], k - 1)) for i in range(len(sizes) + 1))

    for _ in range(150):
        sizes, k = [rng.choice([rng.randint(1, 20), 200]) for _ in range(rng.randint(0, 9))], rng.randint(1, 4)
        cuts = [0, *shards.minimax_cuts(sizes, k), len(sizes)]
        assert cuts == sorted(cuts) and len(cuts) <= k + 1
        assert max(sum(sizes[a:b]) for a, b in zip(cuts, cuts[1:])) == best(sizes, k)


def test_oversized_group_leaves_even_shards():
    sizes = [10] * 3000 + [100_000] + [10] * 3000
    cuts = [0, *shards.minimax_cuts(sizes, 40), len(sizes)]
    totals = sorted(sum(sizes[a:b]) for a, b in zip(cuts, cuts[1:]))
    assert len(totals) == 40 and totals[-1] == 100_000 and totals[-2] <= 1.1 * totals[0]


def test_expectation_finds_the_bad_labeler():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.6
    right = np.array([0.95, 0.9, 0.85, 0.5])
    votes = np.where(rng.random((4000, 4)) < right, np.where(truth, 1, -1)[:, None], np.where(truth, -1, 1)[:, None])
    patterns, which, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post, rates = pii.expect(patterns, np.zeros(len(patterns), int), counts.astype(float))
    assert ((post[which.ravel()] > 0.5) == truth).mean() > 0.93
    assert rates[0, 1, 2] > 0.9 > 0.6 > rates[3, 1, 2]


def test_graph_recall():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    graph = hnsw.Graph.build(x, hnsw.Graph.order(np.arange(3000))[1])
    q = rng.normal(size=(60, 24)).astype(np.float32)
    truth = np.argsort(((q[:, None] - x[None]) ** 2).sum(-1), axis=1)[:, :10]
    found = graph.search(q, hnsw.EF_SEARCH)
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(truth.tolist(), found.tolist())]) > 0.95
    assert all(len(set(r[r >= 0])) == (r >= 0).sum() for r in found)


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/a>Home</a></li></ul></nav>
<div id="sidebar"><p>Some sidebar text that is quite long and has many words in it, more than ten.</p></div><div class='cookie-notice'>We use cookies here.</div>
<main><article><h1>Title &amp; more</h1><p>First <b>para</b><br>of text</p><div class="ad">Buy now</div><ul><li>one<li>two</ul><form><p>hello form</p></form>
<script>var t="</p>";</script><!-- no <p>this</p> --><blockquote>quoted</blockquote><section class="comments"><p>nice one, I like it very much and write many words</p></section></article></main>
<aside>side</aside><footer>&copy; foot</footer></body></html>"""


def test_main_text():
    found = htmltext.main_texts([PAGE, None, "", "<p>unclosed <b>tags", "no markup"], htmltext.tree())
    assert found[0] == "Title & more\n\nFirst para of text\n\none\n\ntwo\n\nquoted"
    assert found[1] == found[2] == ""


def test_main_text_of_odd_markup():
    pages = ["<article><p>" + "word " * 4000 + "</article>", "<article><p>a < b and c</p><p title='>'>x</p></article>", "<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000, "<article><p>cut off <scr", "<" * 5000, "<article><p class=\"x>open quote</p>"]
    found = htmltext.main_texts(pages, htmltext.tree())
    assert found[0] == " ".join(["word"] * 4000) and found[1] == "a < b and c\n\nx" and found[2] == "deep"


def test_main_text_after_hidden_elements():
    whole = "<article><p>one {} two</p><p>three</p></article>"
    # closed by themselves, without an end tag, and elements whose names only begin like a hidden one
    for odd in ("<svg width='1'/>", "<svg/>", "<math />", "<iframe src=x />", "<object data=x>", "<canvas>", "<video controls>", "<svg><svg></svg>", "<video-player></video-player>", "<title-bar></title-bar>", "<select-box x='>'>"):
        assert htmltext.main_texts([whole.format(odd)], htmltext.tree()) == ["one two\n\nthree"], odd
    for gone in ("<svg><text>x</text></svg>", "<svg><svg>x</svg>x</svg>", "<svg><svg>x</svg>", "<object><object>x</object>", "<video><video>x</video>", "<svg a='/>'><g/>x</svg >", "<script>'<p>x'</script\n>", "<title>x</title>", "<iframe>x</iframe>", "<object><p>x</p></object>", "<audio>x</audio>", "<select><option>x</select>"):
        assert htmltext.main_texts([whole.format(gone)], htmltext.tree()) == ["one two\n\nthree"], gone
    assert htmltext.main_texts(["<article><p>a" + "<svg>" * 30000 + "<object>" * 30000 + "b</p></article>"], htmltext.tree()) == ["ab"]


def test_main_text_keeps_parts_with_slug_names():
    kept = ['<h2 id="related-work">', '<h2 id="comments">', '<section id="naval-battles">', '<div class="side-by-side">', '<section id="legal-history">', '<section id="notice">', '<div class="alerting-systems">', '<div data-id="ad">', '<figure><figcaption>', "<p class='legal-theory'>", '<div id="socialism">']
    gone = ['<div class="ad">', '<div class="ad-slot-2">', '<section class="comments">', '<div id="comments">', '<ul class="related-posts">', '<div role="navigation">', '<div class="box cookie-notice">', '<div class="social-share">', '<article class="comment">', '<div class="newsletter_signup">', "<nav>"]
    for part in kept + gone:
        end = "".join(f"</{x.split()[0].split('>')[0]}>" for x in reversed(part.split("<")[1:]))
        want = ["one"] + ["some words of it"] * (part in kept) + ["two"]
        assert htmltext.main_texts([f"<main><p>one</p>{part}some words of it{end}<p>two</p></main>"], htmltext.tree()) == ["\n\n".join(want)], part


def test_decision_tree_learns_its_table():
    table = np.array(htmltext.LABELLED, float)
    assert (htmltext.classify(htmltext.tree(), table[:, :-1]) == (table[:, -1] == 1)).mean() > 0.97
