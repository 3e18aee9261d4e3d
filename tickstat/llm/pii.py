"""Personal data by weak supervision, with DataFrame functions only.

Base spans (email, ip, card, phone) follow fixed patterns and checks and are
always kept. The method adds spans of further kinds: secret, ssn, iban,
localphone and account. Every candidate, base or not, gets votes (+1, -1, 0
for none) of regex, gazetteer and context labelers. The vote patterns of the
whole corpus are counted (a table bounded by 3 ** labelers x kinds x lengths,
whatever the corpus), expectation-maximisation estimates each labeler's
reliability without labels, and a logistic span classifier is fitted on the
posteriors. Its weights become a column expression; candidates scoring at least
``ACCEPT`` and clear of base spans are added.

Places: ``split`` by a pattern gives the gaps and ``regexp_extract_all`` the
matches; their lengths summed up are the starts, in code points, and the ends
of the gaps are the context. Texts are read whole, row by row, without a
shuffle; only the pattern counts are shuffled.

The patterns are written with possessive runs and limits, which match the same
spans as the plain forms in linear time and constant stack, also on very long
texts. Null texts count as empty. Repeated rows give equal rows. Further
columns are ignored by ``spans`` and kept by ``redact``. Without any candidate
nothing is added.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .store import stored

ACCEPT = 0.5
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("secret", "ssn", "iban", "localphone", "account")
KINDS = BASE_KINDS + ADDED_KINDS
LABELERS = ("shape", "checksum", "gazetteer", "cue", "assigned", "limits", "variety")

#: Fixed patterns.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PART = r"^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
SECRET_WORDS = "password|passwd|pwd|token|secret|api_key"
FURTHER = (
    r"(?<![A-Za-z0-9+])(?:AKIA[A-Z0-9]{16}|[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}+|\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}"
    r"|(?i:" + SECRET_WORDS + r")[\x20]{0,3}[=:][\x20]{0,3}\"?[A-Za-z0-9+/_.-]{8,}+\"?|[0-9a-f]{24,}+|[0-9]{7,34}+)(?![A-Za-z0-9])"
)
#: Fixed word lists of the gazetteer and context labelers.
DOMAIN_ENDS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "info", "eu")
CUES = "call|phone|tel|mobile|fax|mail|email|contact|card|visa|account|iban|ssn|ip|address|host|password|passwd|pwd|token|secret|key|login|user"
COUNTER_CUES = "isbn|version|page|chapter|figure|table|section|year|line|item|order|part|no"


_PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "further": FURTHER}


def _cut(text: Column) -> dict[str, Column]:
    """Gaps and matches of each pattern; only for texts that can have a match."""
    digit = text.rlike("[0-9]")
    gates = {"email": text.contains("@"), "ip": digit, "card": digit, "phone": text.contains("+"), "further": digit | text.rlike(f"(?i:{SECRET_WORDS})|[0-9a-f]{{24}}")}
    gaps = {f"_gaps_{k}": F.when(gates[k], F.split(text, p, -1)) for k, p in _PATTERNS.items()}
    return gaps | {f"_found_{k}": F.when(gates[k], F.regexp_extract_all(text, F.lit(p), F.lit(0))) for k, p in _PATTERNS.items()}


def _places(name: str) -> Column:
    """Matches of a pattern: array of (s, e, v, before, after), in order."""
    none = F.expr("cast(array() as array<struct<s:int,e:int,v:string,before:string,after:string>>)")
    gaps = F.col(f"_gaps_{name}")
    parts = F.transform(
        F.arrays_zip(gaps.alias("g"), F.col(f"_found_{name}").alias("m"), F.slice(gaps, F.lit(2), F.size(gaps)).alias("h")),
        lambda x: F.struct(F.length(x["g"]).alias("gap"), x["m"].alias("v"), F.right(x["g"], F.lit(24)).alias("before"), F.left(x["h"], F.lit(8)).alias("after")),
    )
    step = lambda a, x: F.struct(
        (a["p"] + x["gap"] + F.length(x["v"])).alias("p"),
        F.concat(a["o"], F.array(F.struct((a["p"] + x["gap"]).alias("s"), (a["p"] + x["gap"] + F.length(x["v"])).alias("e"), x["v"].alias("v"), x["before"].alias("before"), x["after"].alias("after")))).alias("o"),
    )
    placed = F.aggregate(F.filter(parts, lambda x: x["v"].isNotNull()), F.struct(F.lit(0).alias("p"), none.alias("o")), step, lambda a: a["o"])
    return F.when(gaps.isNotNull(), placed).otherwise(none)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def step(total: Column, i: Column) -> Column:
        d = (F.ascii(F.substring(F.reverse(digits), i, F.lit(1))) - 48) * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return (F.length(digits) > 0) & (F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), step) % 10 == 0)


def _ip_ok(v: Column) -> Column:
    return F.forall(F.split(v, r"\."), lambda p: p.rlike(IP_PART))


def _card_ok(v: Column) -> Column:
    d = _digits(v)
    return F.length(d).between(14, 19) & luhn(d)


def _phone_ok(v: Column) -> Column:
    return F.length(_digits(v)).between(10, 15)


def _named(spans: Column, kind) -> Column:
    return F.transform(spans, lambda x: F.struct((kind(x["v"]) if callable(kind) else F.lit(kind)).alias("kind"), *(x[c].alias(c) for c in ("s", "e", "v", "before", "after"))))


def _further_kind(v: Column) -> Column:
    return (
        F.when(v.rlike(r"^(AKIA|[0-9a-f]{24})|[=:]") & ~v.rlike("^[0-9]+$"), F.lit("secret")).when(v.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.lit("ssn"))
        .when(v.rlike("^[A-Z]"), F.lit("iban")).when(v.rlike(r"^\(?[0-9]{3}\)?[ .-][0-9]{3}[.-]"), F.lit("localphone")).otherwise(F.lit("account"))
    )


def candidates() -> tuple[Column, Column]:
    """(base spans, further candidates): arrays of (kind, s, e, v, before, after), from the columns of ``_cut``."""
    base = F.concat(
        _named(_places("email"), "email"),
        _named(F.filter(_places("ip"), lambda x: _ip_ok(x["v"])), "ip"),
        _named(F.filter(_places("card"), lambda x: _card_ok(x["v"])), "card"),
        _named(F.filter(_places("phone"), lambda x: _phone_ok(x["v"])), "phone"),
    )
    return base, _named(_places("further"), _further_kind)


def _votes(c: Column) -> list[Column]:
    """One vote of each labeler on a candidate."""
    v, kind, d = c["v"], c["kind"], _digits(c["v"])
    is_ = lambda *k: kind.isin(*k)
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    before, after = F.lower(c["before"]), c["after"]
    return [
        vote(is_("email", "ip", "ssn") | (is_("phone", "localphone") & v.rlike(r"[0-9]{3}[)\x20.-]+[0-9]{3}[.-][0-9]{4}$")) | v.rlike(r"^AKIA|^[0-9a-f]{28,}$|[=:]"), is_("account") & (F.length(d) < 9)),
        vote(is_("card", "account") & F.length(d).between(14, 19) & luhn(d), is_("account") & F.length(d).between(14, 19) & ~luhn(d)),
        vote(
            (is_("email") & v.rlike(r"\.(" + "|".join(DOMAIN_ENDS) + ")$")) | (is_("card", "account") & (F.length(d) > 13) & d.rlike("^(4|5[1-5]|3[47]|6011|65)")) | (is_("phone", "localphone") & d.rlike("^1?[2-9]")) | v.rlike("^AKIA|^(?i:password|token|secret|api_key)"),
            (is_("ip") & v.rlike(r"^(0|127|255)\.")) | (is_("iban") & ~v.rlike("^(DE|FR|ES|GB|IT|NL|AT|BE|CH|PL|PT|SE)")),
        ),
        vote(before.rlike(r"(^|[^a-z])(" + CUES + r")[^a-z]{0,4}$"), before.rlike(r"(^|[^a-z])(" + COUNTER_CUES + r")[^a-z]{0,4}$")),
        vote(v.rlike("[=:]") | before.rlike(r"[=:][\x20]?\"?$"), F.lit(False)),
        vote((F.length(before) == 0) | before.rlike(r"[\s(\"'<,;:]$"), before.rlike(r"[A-Za-z0-9@#$%&*]$") | after.rlike("^[@#$%&*]")),
        vote(F.size(F.array_distinct(F.split(d, ""))) >= 4, (F.length(d) >= 7) & (F.size(F.array_distinct(F.split(d, ""))) <= 2)),
    ]


def _length(c: Column) -> Column:
    return F.least(F.floor(F.length(c["v"]) / 8), F.lit(4)).cast("int")


def expect(patterns: np.ndarray, kinds: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of each pattern, P(vote | class) of each labeler) by
    expectation-maximisation; patterns hold votes -1, 0, 1."""
    post = 1 / (1 + np.exp(-patterns.sum(1).astype(float)))
    rates = np.zeros((patterns.shape[1], 2, 3))
    for _ in range(rounds):
        prior = np.array([(1 + (post * counts)[kinds == k].sum()) / (2 + counts[kinds == k].sum()) for k in range(len(KINDS))])
        for j in range(patterns.shape[1]):
            for c, p in enumerate((1 - post, post)):
                n = np.array([(p * counts)[patterns[:, j] == v].sum() for v in (-1, 0, 1)]) + 1.0
                # a labeler is better than chance: the mass on the vote for the class is never the smaller one
                rates[j, c] = n / n.sum()
            if rates[j, 1, 2] < rates[j, 0, 2]:
                rates[j, :, 2] = rates[j, :, 2].mean()
            if rates[j, 0, 0] < rates[j, 1, 0]:
                rates[j, :, 0] = rates[j, :, 0].mean()
        odds = np.log(prior / (1 - prior))[kinds] + sum(np.log(rates[j, 1, patterns[:, j] + 1] / rates[j, 0, patterns[:, j] + 1]) for j in range(patterns.shape[1]))
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return post, rates


def _inputs(patterns: np.ndarray, kinds: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones((len(patterns), 1)), patterns == 1, patterns == -1, kinds[:, None] == np.arange(len(KINDS)), lengths[:, None] == np.arange(5)], axis=1).astype(float)


def fit(rows: list[tuple]) -> np.ndarray:
    """Classifier weights from (votes..., kind, length, count) rows; Newton steps on the grouped rows."""
    if not rows:
        return np.zeros(1 + 2 * len(LABELERS) + len(KINDS) + 5)
    table = np.array([[*r[: len(LABELERS)], KINDS.index(r[-3]), r[-2], r[-1]] for r in rows], dtype=np.int64)
    patterns, kinds, lengths, counts = table[:, : len(LABELERS)], table[:, -3], table[:, -2], table[:, -1].astype(float)
    post, _ = expect(patterns, kinds, counts)
    x = _inputs(patterns, kinds, lengths)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (counts * (p - post)) + 1e-2 * w
        hess = (x * (counts * (p * (1 - p) + 1e-9))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w -= np.clip(np.linalg.solve(hess, grad), -4, 4)
    return w


def train(found: DataFrame) -> np.ndarray:
    """Weights of the span classifier from all candidates (columns base, more)."""
    c = F.col("c")
    rows = (
        found.select(F.explode(F.concat("base", "more")).alias("c"))
        .select(*(x.cast("int").alias(n) for x, n in zip(_votes(c), LABELERS)), c["kind"].alias("kind"), _length(c).alias("length"))
        .groupBy(*LABELERS, "kind", "length").count().collect()
    )
    return fit(sorted(tuple(r) for r in rows))


def _score(c: Column, w: np.ndarray) -> Column:
    votes, m = _votes(c), len(LABELERS)
    total = F.lit(float(w[0]))
    for j, v in enumerate(votes):
        total = total + F.when(v == 1, float(w[1 + j])).when(v == -1, float(w[1 + m + j])).otherwise(0.0)
    for j, k in enumerate(KINDS):
        total = total + F.when(c["kind"] == k, float(w[1 + 2 * m + j])).otherwise(0.0)
    for j in range(5):
        total = total + F.when(_length(c) == j, float(w[1 + 2 * m + len(KINDS) + j])).otherwise(0.0)
    return total


def _accepted(base: Column, more: Column, w: np.ndarray) -> Column:
    least = math.log(ACCEPT / (1 - ACCEPT))
    return F.filter(more, lambda c: (_score(c, w) >= least) & ~F.exists(base, lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])))


def _ordered(spans: Column) -> Column:
    """Sorted by start, then kind as listed."""
    rank = lambda k: F.array_position(F.array(*map(F.lit, KINDS)), k).cast("int")
    return F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), rank(x["kind"]).alias("rank"), x["e"].alias("e"), x["kind"].alias("kind"), x["v"].alias("v"))))


def scan(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns to keep, and the spans and candidates of each row: base, more."""
    base, more = candidates()
    return docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")).select(*keep, *(c.alias(n) for n, c in _cut(F.col("_text")).items())).select(*keep, base.alias("base"), more.alias("more"))


def spans(docs: DataFrame, *, doc_id="doc_id", text="text") -> DataFrame:
    """One row per document: doc_id, base and spans (all): arrays of
    (s, rank, e, kind, v) by start, then kind; code points, end exclusive."""
    found = stored(scan(docs, [doc_id], text), "candidates")
    w = train(found)
    return found.select(F.col(doc_id).alias("doc_id"), _ordered(F.col("base")).alias("base"), _ordered(F.concat("base", _accepted(F.col("base"), F.col("more"), w))).alias("spans"))


def redact(docs: DataFrame, *, text="text", length: str | None = "n_chars") -> DataFrame:
    """The documents with every span replaced by its kind in brackets, all
    columns as they are; ``length`` names a column to hold the new length."""
    w = train(stored(scan(docs, [], text), "candidates"))
    base, more = candidates()
    found = docs.withColumns(_cut(F.coalesce(F.col(text).cast("string"), F.lit("")))).select(*docs.columns, base.alias("_base"), more.alias("_more"))
    found = found.withColumn("_spans", _ordered(F.concat("_base", _accepted(F.col("_base"), F.col("_more"), w))))
    body = F.col(text)
    step = lambda a, x: F.struct(
        F.greatest(a["p"], x["e"]).alias("p"),
        F.when(x["s"] >= a["p"], F.concat(a["o"], F.substring(body, a["p"] + 1, x["s"] - a["p"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(a["o"]).alias("o"),
    )
    clean = F.aggregate("_spans", F.struct(F.lit(0).alias("p"), F.lit("").alias("o")), step, lambda a: F.concat(a["o"], F.substring(body, a["p"] + 1, F.length(body))))
    found = found.withColumn(text, F.when(F.size("_spans") > 0, clean).otherwise(body))
    if length and length in docs.columns:
        found = found.withColumn(length, F.when(F.size("_spans") > 0, F.length(text).cast(docs.schema[length].dataType)).otherwise(F.col(length)))
    return found.select(*docs.columns)
