"""Secrets by a linear-chain conditional random field beside fixed patterns.

Base spans (assign, access, hex) follow fixed patterns and are always kept. The
field tags the tokens of a text (runs of letters and digits) as beginning,
inside or outside of a secret. Features of a token: its shape (length, cases,
digits, changes between them, hexadecimal), the characters before and behind it,
the words and shapes of its neighbours, and how much its file looks like
settings or code. Viterbi decodes the tags; spans that touch no base span are
added with the kind ``tagged``.

Training: windows of tokens from a bounded sample of the documents
(``Params.max_docs`` by hash, at most ``max_windows`` windows), labelled by the
base patterns, and lines made by rule from the contexts and value kinds below,
labelled by construction. Windows in which a field of the made lines alone sees
a secret beyond the patterns are left out, so that unlabelled secrets don't
count as plain text. The log-likelihood is maximised by gradient steps over
forward-backward marginals, all windows at once. The weights (``SLOTS`` x 3)
are sent to the tasks.

Decoding: a token whose margin for "outside" exceeds what any transition could
win back is outside on every best path, so Viterbi runs over the stretches
between such tokens, all stretches of a block at once; the tags are those of the
whole text. Every whole text is read once; nothing is shuffled.

Null texts count as empty: no spans. Texts are never cut; a very long one is a
block of its own, and its features are scored in parts. Repeated rows give equal
rows, empty tables empty results; further columns are ignored. Without any row
in the sample the lines made by rule alone train the field.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import blocks as B
from .store import stored

KINDS = ("assign", "access", "hex", "tagged")
TAGS = OUTSIDE, BEGIN, INSIDE = 0, 1, 2
SLOT_BITS = 16
N_FEATURES = 13
SLOTS = N_FEATURES << SLOT_BITS
WINDOW = 16
PART = 1 << 18

#: Fixed patterns.
ASSIGN = re.compile("([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")
LONG_HEX = re.compile("[0-9a-f]{24}")
#: Texts without any of these have no base span.
GATE = "(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"

#: Fixed contexts of the lines made by rule; the braces stand for the value.
SECRET_LINES = (
    "password: {}", "pwd={}", "DB_PASS={}", "passphrase is \"{}\"", "Authorization: Bearer {}", "export API_KEY={}", "\"client_secret\": \"{}\",", "private_key = '{}'",
    "access_key_id: {}", "aws_secret_access_key = {}", "curl -H \"X-Auth-Token: {}\" https://api.example.org/v1", "postgres://admin:{}@db.example.org/prod", "https://deploy:{}@git.example.org/x",
    "credentials: admin / {}", "signing key {}", "my login key is {} please keep it", "<add key=\"conn\" value=\"{}\" />", "webhook_key: \"{}\"", "PIN code and key: {}", "set auth {} for the server",
)
PLAIN_LINES = (
    "password policy: must be changed every year", "token = next(tokens)", "the secret garden was {} pages long", "an api key is required for version {}", "see order {} of 2024-05-{}", "call +1 555 {} {}",
    "write to user{}@example.com", "IBAN DE{} {} {}", "https://www.example.org/articles/{}/index.html", "image IMG_{}_{}.jpg at 1920x1080", "class HttpServerFactory{} extends Base", "colour #ff{}aa and #00cc{}",
    "def getUserById{}(id): return table[{}]", "ISBN 978-3-16-{}-0", "value = {}", "x{} = y{} + 3.14", "the year {} in chapter {}", "key words: storage, network, key", "card 4111 1111 {} {}", "id: {}", "host 10.0.{}.{} port {}",
    "version: {}.{}.{}", "| {} | {} | total |", "length = {}; width = {}", "He said: \"the key is under the mat\"", "auth is described in section {}", "md5 sums are listed below", "part no. AB-{}",
)


@dataclass(frozen=True)
class Params:
    """``max_docs``: documents whose windows may train (by hash, about so many);
    ``max_windows``: windows taken of them; ``copies``: lines made of each context."""

    max_docs: int = 8192
    max_windows: int = 1024
    copies: int = 10
    steps: int = 60
    rate: float = 0.15
    decay: float = 2e-3


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind's place, end, start of the value) of the fixed patterns, in code points."""
    out = [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if LONG_HEX.search(text):
        out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(out)


def _value(rng: random.Random) -> str:
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    some = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    kind = rng.randrange(8)
    if kind == 0:
        return some(dig + "abcdef", rng.choice([16, 20, 32, 40, 64]))
    if kind == 1:
        return some(low + up + dig, rng.randint(16, 44))
    if kind == 2:
        return some(up + dig, rng.randint(16, 24))
    if kind == 3:
        return some(low + up + dig, 18) + rng.choice("/+") + some(low + up + dig, rng.randint(6, 20))
    if kind == 4:
        return rng.choice(["ghp_", "sk_live_", "xoxb-", "glpat-", "pk_"]) + some(low + up + dig, rng.randint(20, 36))
    if kind == 5:
        return ".".join("eyJ" + some(low + up + dig, rng.randint(12, 30)) for _ in range(2)) + "." + some(low + up + dig, 27)
    if kind == 6:
        return some(low, rng.randint(4, 7)) + some(dig, rng.randint(2, 4)) + rng.choice(["", "x", "Z"])
    return some(up, 1) + some(low, rng.randint(3, 6)) + some(dig, 4) + some(low + up, rng.randint(0, 3))


def made_lines(copies: int) -> list[tuple[str, list[tuple[int, int]]]]:
    """(line, spans of secrets in code points) from the contexts above, by a fixed seed."""
    rng, out = random.Random(11), []
    for _ in range(copies):
        for line in SECRET_LINES:
            value = _value(rng)
            lead = rng.choice(["", "", "# ", "  ", "the words before it\n"])
            at = len(lead) + line.index("{}")
            out.append((lead + line.replace("{}", value) + rng.choice(["", "\n", " and more text"]), [(at, at + len(value))]))
        for line in PLAIN_LINES:
            out.append((re.sub(r"\{\}", lambda m: "".join(rng.choice("0123456789") for _ in range(rng.choice([1, 2, 3, 4, 4, 8]))), line), []))
    return out


# Byte classes of the gaps between tokens, as bits.
_NEWLINE, _EQUALS, _QUOTE, _SPACE, _JOIN, _AT = 1, 2, 4, 8, 16, 32
_GAP = np.zeros(256, np.uint8)
for _chars, _bit in ((b"\r\n", _NEWLINE), (b":=", _EQUALS), (b"\"'`", _QUOTE), (b"\x20\t", _SPACE), (b"-_./+", _JOIN), (b"@#$%&*", _AT)):
    _GAP[list(_chars)] = _bit
_KIND = np.zeros(256, np.uint8)  # 1 digit, 2 lower, 3 upper, 4 other letters
_KIND[48:58], _KIND[97:123], _KIND[65:91], _KIND[128:] = 1, 2, 3, 4
_HEXES = np.zeros(256, bool)
_HEXES[48:58] = _HEXES[97:103] = _HEXES[65:71] = True
_CODE = np.zeros(256, bool)
_CODE[list(b"={};:<>\"_")] = True


def _sums(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, out=out[1:])
    return out


class Tokens:
    """Tokens of some rows: limits, hashes, shapes and gaps; features by range."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lo: int, hi: int):
        self.row, self.hash, self.start, self.end = B.words(data, offsets, lo, hi, B.ALNUM)
        base = int(offsets[lo])
        raw = data[base : int(offsets[hi])]
        limits = offsets[lo : hi + 1] - base
        n, kind = len(self.row), _KIND[raw]
        size = self.end - self.start
        share = lambda flags: (lambda s: s[self.end] - s[self.start])(_sums(flags))
        digits, lower, upper, other = (share(kind == k) for k in (1, 2, 3, 4))
        change = np.zeros(len(raw), bool)
        change[1:] = kind[1:] != kind[:-1]
        changes = share(change) - change[self.start] if n else size
        length = np.minimum(np.searchsorted([2, 4, 6, 8, 12, 16, 20, 24, 32, 40, 64], size, side="right"), 11)
        self.length = length
        self.shape = length * 16 + (digits > 0) * 8 + (upper > 0) * 4 + (lower > 0) * 2 + (other > 0)
        self.mix = (length * 6 + (5 * digits) // np.maximum(size, 1)) * 6 + np.minimum(5, (10 * changes) // np.maximum(size, 1))
        self.hex = (share(_HEXES[raw]) == size) * 16 + length
        first = np.concatenate([[True], self.row[1:] != self.row[:-1]]) if n else np.zeros(0, bool)
        self.first, self.last = first, np.append(first[1:], True) if n else first
        # the gap before each token, as bits; 64 where the row starts, 128 where it is longer than three bytes
        left = np.concatenate([[0], self.end[:-1]]) if n else self.start
        gap = np.zeros(n, np.int64)
        bits = _GAP[raw]
        for bit in (_NEWLINE, _EQUALS, _QUOTE, _SPACE, _JOIN, _AT):
            s = _sums(bits == bit)
            gap |= np.where(s[self.start] > s[left], bit, 0)
        gap[self.start - left > 3] |= 128
        gap[first] = 64
        self.before = gap
        self.after = np.append(gap[1:], 64) if n else gap
        self.after[self.last] = 64
        code = _sums(_CODE[raw])
        dense = 200 * (code[limits[1:]] - code[limits[:-1]]) // np.maximum(limits[1:] - limits[:-1], 1)
        self.file = np.searchsorted([1, 3, 6, 12, 24], dense, side="right")[self.row]

    def features(self, a: int, b: int) -> np.ndarray:
        """(tokens a..b) x ``N_FEATURES`` slots."""
        def near(values: np.ndarray, by: int, none: int) -> np.ndarray:
            at = np.arange(a, b) + by
            ok = (at >= 0) & (at < len(self.row))
            at = np.where(ok, at, 0)
            ok &= self.row[at] == self.row[a:b]
            return np.where(ok, values[at], values.dtype.type(none))

        own = slice(a, b)
        u = lambda x: x.astype(np.uint64)
        shape, before, after = u(self.shape[own]), u(self.before[own]), u(self.after[own])
        prev = near(self.hash, -1, 1)
        parts = [
            shape, u(self.mix[own]), u(self.hex[own]) * np.uint64(8) + u(self.file[own]), before * np.uint64(256) + after, after * np.uint64(256) + shape,
            before * np.uint64(256) + shape, prev, near(self.hash, -2, 1), near(self.hash, 1, 1), u(near(self.shape, -1, 255)) * np.uint64(256) + before,
            u(near(self.shape, 1, 255)) * np.uint64(256) + after, prev + before, u(self.file[own]) * np.uint64(256) + shape,
        ]
        out = np.empty((b - a, N_FEATURES), np.int32)
        for i, part in enumerate(parts):
            out[:, i] = (B.mix(part * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i)) >> np.uint64(64 - SLOT_BITS)).astype(np.int32) + (i << SLOT_BITS)
        return out


@dataclass
class Field:
    """``emit``: slot x tag; ``move``: tag x tag, where a text's ends count as outside."""

    emit: np.ndarray
    move: np.ndarray

    def scores(self, tokens: Tokens) -> np.ndarray:
        n = len(tokens.row)
        out = np.zeros((n, 3), np.float32)
        for a in range(0, n, PART):
            slots = tokens.features(a, min(n, a + PART))
            for i in range(N_FEATURES):
                out[a : a + PART] += self.emit[slots[:, i]]
        return out

    def tags(self, scores: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Best tag of every token: Viterbi over each row."""
        t = self.move
        win = max(t[a, y] + t[y, b] - t[a, 0] - t[0, b] for a in TAGS for b in TAGS for y in (BEGIN, INSIDE))
        open_ = scores[:, 0] - scores[:, 1:].max(axis=1) <= max(win, 0.0) + 1e-3
        out = np.zeros(len(row), np.int8)
        at = np.flatnonzero(open_)
        if not len(at):
            return out
        new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])])
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(at)))
        order = np.argsort(-size, kind="stable")
        begin, size = at[begin[order]], size[order]
        best = t[0][None, :] + scores[begin]
        back: list[np.ndarray] = []
        for step in range(1, int(size[0])):
            n = int(np.searchsorted(-size, -step, side="left"))  # stretches longer than step
            paths = best[:n, :, None] + t[None]
            back.append(paths.argmax(axis=1).astype(np.int8))
            best[:n] = paths.max(axis=1) + scores[begin[:n] + step]
        tag = (best + t[:, 0][None]).argmax(axis=1)
        for step in range(int(size[0]) - 1, -1, -1):
            n = int(np.searchsorted(-size, -step, side="left"))
            out[begin[:n] + step] = tag[:n]
            if step:
                m = len(back[step - 1])
                tag[:m] = back[step - 1][np.arange(m), tag[:m]]
        return out


def _labels(tokens: Tokens, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Tags of tokens from (row, first byte, end byte) of secrets."""
    out = np.zeros(len(tokens.row), np.int8)
    for row, a, b in spans:
        at = np.flatnonzero((tokens.row == row) & (tokens.start >= a) & (tokens.end <= b))
        out[at[:1]], out[at[1:]] = BEGIN, INSIDE
    return out


def fit(texts: list[str], spans: list[list[tuple[int, int]]], p: Params = Params()) -> Field:
    """The field of highest (penalised) likelihood for texts with spans in code points."""
    data, offsets = B.text_bytes(pa.array(texts, pa.string()))
    tokens = Tokens(data, offsets, 0, len(texts))
    size_to = lambda t, i: len(t[:i].encode())
    marks = [(r, int(offsets[r]) + size_to(t, a), int(offsets[r]) + size_to(t, b)) for r, (t, found) in enumerate(zip(texts, spans)) for a, b in found]
    gold = _labels(tokens, marks)
    slots = tokens.features(0, len(tokens.row))
    used, slot = np.unique(slots, return_inverse=True)
    slot = slot.reshape(slots.shape)
    limits = B.row_limits(tokens.row, len(texts))
    rows = np.flatnonzero(np.diff(limits))
    begin, size = limits[rows], np.diff(limits)[rows]
    width = int(size.max())
    here = np.arange(width)[None] < size[:, None]
    place = np.where(here, begin[:, None] + np.arange(width)[None], 0)
    w, t = np.zeros((len(used), 3)), np.zeros((3, 3))
    t[0, 2] = -2.0
    hot = np.eye(3)[gold]
    before = np.where(tokens.first, 0, np.concatenate([[0], gold[:-1]]))
    gold_moves = np.zeros((3, 3))
    np.add.at(gold_moves, (before, gold), 1)
    np.add.at(gold_moves, (gold[tokens.last], 0), 1)
    sq_w, sq_t = np.full(w.shape, 1e-2), np.full(t.shape, 1e-2)
    n = len(rows)
    for _ in range(p.steps):
        e = w[slot].sum(axis=1)[place]  # windows x width x 3
        f, g = np.zeros((n, width, 3)), np.zeros((n, width, 3))
        lse = lambda x, axis: (lambda m: m.squeeze(axis) + np.log(np.exp(x - m).sum(axis=axis)))(x.max(axis=axis, keepdims=True))
        f[:, 0] = t[0][None] + e[:, 0]
        for j in range(1, width):
            f[:, j] = np.where(here[:, j, None], lse(f[:, j - 1, :, None] + t[None], 1) + e[:, j], f[:, j - 1])
        z = lse(f[:, -1] + t[:, 0][None], 1)
        g[:, -1] = t[:, 0][None]
        moves = np.zeros((3, 3))
        for j in range(width - 1, 0, -1):
            nxt = here[:, j]
            step = t[None] + (e[:, j] + g[:, j])[:, None, :]
            pair = np.exp(f[:, j - 1, :, None] + step - z[:, None, None])
            moves += pair[nxt].sum(axis=0)
            g[:, j - 1] = np.where(nxt[:, None], lse(step, 2), g[:, j])
        post = np.exp(f + g - z[:, None, None])
        moves[0] += post[:, 0].sum(axis=0)
        end = post[np.arange(n), size - 1]
        moves[:, 0] += end.sum(axis=0)
        delta = np.zeros((len(tokens.row), 3))
        delta[place[here]] = post[here]
        delta -= hot
        grad = np.stack([np.bincount(slot.ravel(), np.repeat(delta[:, y], N_FEATURES), len(used)) for y in TAGS], axis=1) + p.decay * n * w
        grad_t = moves - gold_moves + p.decay * n * t
        sq_w += grad**2
        sq_t += grad_t**2
        w -= p.rate * grad / np.sqrt(sq_w)
        t -= p.rate * grad_t / np.sqrt(sq_t)
    emit = np.zeros((SLOTS, 3), np.float32)
    emit[:, 0] = 0.0
    emit[used] = w
    return Field(emit, t)


def windows(text: str, own: int) -> list[tuple[str, list[tuple[int, int]]]]:
    """At most four windows around base spans, and one at a place drawn by ``own``; spans are the values'."""
    found = base_spans(text)
    marks = [(v, e) for _, _, e, v in found]
    at = [marks[i * len(marks) // min(4, len(marks))][0] for i in range(min(4, len(marks)))] + [own % (len(text) + 1)]
    out = []
    for p in at:
        a, b = max(0, p - 80), min(len(text), p + 160)
        inner = sorted({(x, y) for x, y in marks if x < b and y > a})
        a, b = min([a, *(x for x, _ in inner)]), max([b, *(y for _, y in inner)])
        kept: list[tuple[int, int]] = []
        for x, y in inner:  # values of two kinds at one place count once
            if kept and x < kept[-1][1]:
                kept[-1] = (kept[-1][0], max(y, kept[-1][1]))
            else:
                kept.append((x, y))
        if b - a <= 480:
            out.append((text[a:b], [(x - a, y - a) for x, y in kept]))
    return out


def train(docs: DataFrame, p: Params = Params()) -> Field:
    """A field from the lines made by rule and a sample of the documents (columns id, text)."""
    share = min(1.0, p.max_docs / max(1, docs.count()))
    drawn = F.pmod(F.xxhash64(F.col("id").cast("string"), "text"), F.lit(1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for part, marks in windows(text or "", own):
                    out.append({"part": part, "at": [a for a, _ in marks], "to": [b for _, b in marks]})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("part", pa.string()), ("at", pa.list_(pa.int32())), ("to", pa.list_(pa.int32()))]))

    sample = docs.withColumn("own", drawn).where(F.col("own") <= int(share * ((1 << 30) - 1))).select("text", "own").mapInArrow(run, "part string, at array<int>, to array<int>")
    has = lambda yes: sample_rows.where((F.size("at") > 0) == yes).orderBy(F.xxhash64("part"), "part").limit(p.max_windows // 2).collect()
    sample_rows = stored(sample.distinct(), "windows")
    made = made_lines(p.copies)
    rows = [(r["part"], list(zip(r["at"], r["to"]))) for yes in (True, False) for r in has(yes)]
    if rows:  # windows that seem to hold a secret beyond the patterns can't stand for plain text
        first = fit([t for t, _ in made], [s for _, s in made], p)
        data, offsets = B.text_bytes(pa.array([t for t, _ in rows], pa.string()))
        found = _found(first, data, offsets, 0, len(rows))
        plain = lambda i, t, s: all(any(len(t[:a].encode()) <= x and y <= len(t[:b].encode()) for a, b in s) for x, y in found.get(i, []))
        rows = [r for i, r in enumerate(rows) if plain(i, *r)]
    return fit([t for t, _ in rows + made], [s for _, s in rows + made], p)


def _found(field: Field, data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> dict[int, list[tuple[int, int]]]:
    """row -> (first byte, end byte) of the spans that the field tags."""
    tokens = Tokens(data, offsets, lo, hi)
    tag = field.tags(field.scores(tokens), tokens.row)
    at = np.flatnonzero(tag)
    out: dict[int, list[tuple[int, int]]] = {}
    limits = offsets[lo : hi + 1] - offsets[lo]
    for i in at.tolist():
        r = int(tokens.row[i])
        a, b = int(tokens.start[i] - limits[r]), int(tokens.end[i] - limits[r])
        mine = out.setdefault(lo + r, [])
        if tag[i] == INSIDE and mine and tag[i - 1] and tokens.row[i - 1] == r:
            mine[-1] = (mine[-1][0], b)
        else:
            mine.append((a, b))
    return out


def find(docs: DataFrame, *, doc_id="doc_id", text="text", params: Params = Params()) -> DataFrame:
    """One row per document: doc_id, base and spans (all): arrays of (kind, s,
    e, v) by start, then kind as listed; code points, end exclusive; v is the text."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(train(rows, params))
    one = pa.struct([("kind", pa.string()), ("s", pa.int32()), ("e", pa.int32()), ("v", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = sent.value
        for batch in batches:
            column = pc.fill_null(batch.column(1), "")
            gate = pc.match_substring_regex(column, GATE).to_numpy(zero_copy_only=False)
            data, offsets = B.text_bytes(column)
            base: list[list[dict]] = [[] for _ in range(len(column))]
            spans: list[list[dict]] = [[] for _ in range(len(column))]
            tagged: dict[int, list[tuple[int, int]]] = {}
            for lo, hi in B.row_blocks(offsets):
                tagged |= _found(field, data, offsets, lo, hi)
            for i in sorted({*np.flatnonzero(gate).tolist(), *tagged}):
                own = column[i].as_py()
                fixed = [(s, k, e) for s, k, e, _ in base_spans(own)] if gate[i] else []
                more, last, done, place = [], 0, 0, 0
                raw = data[int(offsets[i]) : int(offsets[i + 1])]
                starts = sorted(s for s, _, _ in fixed)
                reach = np.maximum.accumulate([e for _, e in sorted((s, e) for s, _, e in fixed)] or [0])
                for a, b in tagged.get(i, []):
                    done += int(np.count_nonzero((raw[last:a] & 0xC0) != 0x80))
                    s, e = done, done + int(np.count_nonzero((raw[a:b] & 0xC0) != 0x80))
                    last, done = b, e
                    while place < len(starts) and starts[place] < e:  # base spans that start before this one ends
                        place += 1
                    if not place or reach[place - 1] <= s:
                        more.append((s, 3, e))
                named = lambda found: [{"kind": KINDS[k], "s": s, "e": e, "v": own[s:e]} for s, k, e in sorted(found)]  # noqa: E731, B023
                base[i], spans[i] = named(fixed), named(fixed + more)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, pa.list_(one)), pa.array(spans, pa.list_(one))], names=["doc_id", "base", "spans"])

    kind = docs.schema[doc_id].dataType.simpleString()
    array = "array<struct<kind:string,s:int,e:int,v:string>>"
    return rows.mapInArrow(run, f"doc_id {kind}, base {array}, spans {array}")
