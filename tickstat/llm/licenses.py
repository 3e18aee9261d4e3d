"""Licence scans with a positional rare-token index, DataFrame functions only.

Base phrases are looked for exactly, at every place. The method adds labels: a
fixed table of licence templates is indexed by word (template, offset). Over
all documents the document frequency of the templates' words is counted. Of
each template the words of highest IDF are indexed, so many that the others
hold less than ``SHARE`` of its IDF mass; a start that reaches the share thus
has one of them in place. A place p of such a word in a file proposes the
template's start p - offset, and each proposed start is verified: the IDF mass
of all the template's words that stand in place there. A template counts where
that reaches ``SHARE`` of its mass and its mandatory key phrase stands in the
file.

Words are runs of ASCII letters, ASCII digits and non-ASCII characters, lower
case. (``lower`` also folds non-ASCII letters; no base phrase holds a letter
that a non-ASCII character folds to, so base places are those of ASCII folding.)

Scale: two passes over the texts, none shuffled; starts are proposed and
verified within the file's row. What is shuffled: counts of the templates' words
(bounded) and small rows per document. The templates' postings and the
frequencies are tables of fixed size.

Null texts have no words. Rows are told apart by id and text, so repeated rows
give equal rows. Null ids are kept. Empty tables give empty results; further
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .store import stored

SHARE = 0.6

#: Base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Label, mandatory key phrase, template.
TEMPLATES = (
    ("mit", "mit license", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "apache license", "licensed under the apache license version 2 0"),
    ("gpl-3", "gnu general public license version 3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-2", "gnu general public license version 2", "this work is licensed under the gnu general public license version 2"),
    ("lgpl", "gnu lesser general public license", "licensed under the terms of the gnu lesser general public license"),
    ("agpl-3", "gnu affero general public license", "licensed under the terms of the gnu affero general public license version 3"),
    ("mpl-2", "mozilla public license", "subject to the terms of the mozilla public license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "cc by 4 0", "licensed under cc by 4 0"),
    ("cc-by", "creative commons attribution", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("public-domain", "released into the public domain", "this is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "all rights reserved", "all rights reserved"),
    ("bsd-3", "nor the names of its contributors", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("unlicense", "spdx license identifier unlicense", "spdx license identifier unlicense"),
    ("mpl-2", "mozilla public license v 2 0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "spdx license identifier isc", "spdx license identifier isc"),
    ("mit", "spdx license identifier mit", "spdx license identifier mit"),
    ("apache-2", "spdx license identifier apache 2 0", "spdx license identifier apache 2 0"),
    ("mpl-2", "spdx license identifier mpl 2 0", "spdx license identifier mpl 2 0"),
    ("bsd-2", "spdx license identifier bsd 2 clause", "spdx license identifier bsd 2 clause"),
    ("bsd-3", "spdx license identifier bsd 3 clause", "spdx license identifier bsd 3 clause"),
    *((f"{name}-{v}", f"spdx license identifier {name} {v}", f"spdx license identifier {name} {v} 0") for name in ("gpl", "lgpl", "agpl") for v in (2, 3)),
    *((f"gpl-{v}", f"gnu general public license version {v}", f"gnu general public license version {v} {date}") for v, date in ((2, "june 1991"), (3, "29 june 2007"))),
    *((f"{label}-{v}", f"gnu {name}general public license as published by the free software foundation either version {v}", f"under the terms of the gnu {name}general public license as published by the free software foundation either version {v} of the license or at your option any later version")
      for label, name in (("gpl", ""), ("lgpl", "lesser "), ("agpl", "affero ")) for v in (2, 3)),
)
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A file without any of these words mentions no licence; any break may stand between two words.
MENTIONS = f"licen[cs]e|rights{_BREAK}reserved|permission|redistribution|public{_BREAK}domain|cc{_BREAK}by"

VOCABULARY = tuple(sorted({w for _, _, t in TEMPLATES for w in t.split()}))
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _spaces(text: Column) -> Column:
    return F.regexp_count(text, F.lit(" "))


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, row, low): the lower-cased text and its hash."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("low")).withColumn("row", F.xxhash64("low"))


def _frequencies(texts: DataFrame) -> tuple[int, dict[str, int]]:
    """(documents, documents that hold each vocabulary word)."""
    vocabulary = F.array(*map(F.lit, VOCABULARY))
    held = F.array_intersect(F.split(F.regexp_replace("low", _BREAK, " "), " "), vocabulary)
    rows = texts.select(F.explode(F.array_append(held, F.lit(""))).alias("word")).groupBy("word").count().collect()
    found = {r["word"]: r["count"] for r in rows}
    return found.pop("", 0), found


def _base(texts: DataFrame) -> DataFrame:
    """Base places of the files that mention a licence; ``padded`` has each word between single spaces."""
    rows = texts.select("doc_id", "row", F.concat(F.lit(" "), F.trim(F.regexp_replace("low", _BREAK, " ")), F.lit(" ")).alias("padded"))
    rows = rows.select("*", *(F.when(F.col("padded").contains(f" {p} "), F.split("padded", f"(?<= ){p}(?= )", -1)).alias(f"gaps{i}") for i, p in enumerate(PHRASES)), _spaces(F.col("padded")).alias("spaces"))
    gaps = [F.col(f"gaps{i}") for i in range(len(PHRASES))]
    places = [F.when(g.isNotNull(), F.size(g) - 1).otherwise(0) for g in gaps]
    first = [F.when(g.isNotNull(), _spaces(F.element_at(g, 1)) - 1) for g in gaps]
    last = [F.when(g.isNotNull(), F.col("spaces") - _spaces(F.element_at(g, -1)) - len(p.split())) for g, p in zip(gaps, PHRASES)]
    return rows.select(
        "doc_id", "row", "padded", sum(places, F.lit(0)).cast("long").alias("n_base"), F.least(*first).cast("long").alias("first_word"), F.greatest(*last).cast("long").alias("last_word"),
        F.array_compact(F.array(*(F.when(g.isNotNull(), F.lit(label)) for g, label in zip(gaps, PHRASES.values())))).alias("base_labels"),
    )


def _rare(words: list[str], idf: dict[str, float]) -> list[str]:
    """The template's words of highest IDF, until the others hold less than ``SHARE`` of its mass."""
    mass = rest = sum(idf[w] for w in words)
    rare = []
    for w in sorted(set(words), key=lambda w: (-idf[w], w)):
        if rest < (SHARE - 1e-9) * mass:
            break
        rare.append(w)
        rest -= words.count(w) * idf[w]
    return rare


def _matches(rows: DataFrame, n: int, frequency: dict[str, int]) -> DataFrame:
    """(doc_id, row, labels, score) of the templates found."""
    idf = {w: math.log((1 + n) / (1 + frequency.get(w, 0))) + 1e-6 for w in VOCABULARY}
    words = [t.split() for _, _, t in TEMPLATES]
    rare = [_rare(t, idf) for t in words]
    fields = lambda **x: F.struct(*(F.lit(v).alias(k) for k, v in x.items()))
    postings = [F.array(*(fields(word=w, template=i, offset=o) for o, w in enumerate(t) if w in rare[i])) for i, t in enumerate(words)]
    wanted = F.array(*(F.array(*(fields(word=w, offset=o, share=idf[w] / sum(idf[x] for x in t)) for o, w in enumerate(t))) for t in words))
    # the postings of the templates whose key phrase is there; columns used in lambdas are used elsewhere too, or they would be computed again for every element
    mine = F.flatten(F.array_compact(F.array(*(F.when(F.col("padded").contains(f" {key} "), postings[i]) for i, (_, key, _) in enumerate(TEMPLATES)))))
    rows = rows.select("doc_id", "row", F.split(F.trim("padded"), " ").alias("words"), mine.alias("postings")).where(F.size("postings") > 0)
    known = sorted({w for r in rare for w in r})
    places = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("pos"))), lambda x: x["word"].isin(*known) & F.exists("postings", lambda q: q["word"] == x["word"]))
    rows = rows.select("doc_id", "row", "words", "postings", F.when(F.size("postings") > 0, places).alias("places"))
    # a start and its template as one number, as plain numbers are told apart by hash
    many = len(TEMPLATES)
    starts = F.transform("places", lambda p: F.transform(F.filter("postings", lambda q: q["word"] == p["word"]), lambda q: (p["pos"] - q["offset"]).cast("bigint") * many + q["template"]))
    rows = rows.select("doc_id", "row", "words", F.array_distinct(F.flatten(starts)).alias("starts"))
    share = lambda template, start: F.aggregate(
        F.get(wanted, template), F.lit(0.0), lambda total, x: total + F.when(F.get("words", start + x["offset"]) == x["word"], x["share"]).otherwise(0.0))
    template, start = (lambda s: F.pmod(s, F.lit(many)).cast("int")), (lambda s: F.floor(s / many).cast("int"))
    found = F.filter(F.transform("starts", lambda s: F.struct(template(s).alias("template"), share(template(s), start(s)).alias("share"))), lambda x: x["share"] >= SHARE - 1e-9)
    found = rows.select("doc_id", "row", found.alias("found")).dropDuplicates(["doc_id", "row"]).where(F.size("found") > 0)
    label = F.array(*(F.lit(x) for x, _, _ in TEMPLATES))
    return found.select(
        "doc_id", "row", F.array_distinct(F.transform("found", lambda x: F.get(label, x["template"]))).alias("labels"),
        F.array_max(F.transform("found", lambda x: F.least(x["share"], F.lit(1.0)))).alias("score"),
    )


def scan(docs: DataFrame, *, doc_id="doc_id", text="text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word,
    base_labels and labels (sorted arrays), score."""
    texts = _texts(docs, doc_id, text)
    n, frequency = _frequencies(texts)
    mentions = stored(_base(texts.where(F.col("low").rlike(MENTIONS))), "mentions")
    found = _matches(mentions.select("doc_id", "row", "padded"), n, frequency)
    keyed = lambda d, p: d.select(*(F.col(c).alias(p + c) for c in d.columns))
    # one row for each (id, text)
    base = mentions.drop("padded").dropDuplicates(["doc_id", "row"])
    right = keyed(base, "b_").join(keyed(found, "f_"), F.expr("b_doc_id <=> f_doc_id and b_row = f_row"), "left")
    right = stored(right.where("b_n_base > 0 or f_row is not null"), "labels")
    left = texts.select("doc_id", "row", F.regexp_count("low", F.lit(_WORD)).cast("long").alias("n_words"))
    none = F.expr("cast(array() as array<string>)")
    base_labels, more = F.coalesce("b_base_labels", none), F.coalesce("f_labels", none)
    return left.join(right, F.expr("doc_id <=> b_doc_id and row = b_row"), "left").select(
        "doc_id", "n_words", F.coalesce("b_n_base", F.lit(0)).alias("n_base"), F.col("b_first_word").alias("first_word"), F.col("b_last_word").alias("last_word"),
        F.array_sort(F.array_distinct(base_labels)).alias("base_labels"), F.array_sort(F.array_union(base_labels, more)).alias("labels"),
        F.when(F.size(base_labels) > 0, 1.0).otherwise(F.coalesce("f_score", F.lit(0.0))).alias("score"),
    )
