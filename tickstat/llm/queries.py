"""Registered queries of this subpackage: opN_<name>(spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe as E
from . import decontaminate as D
from . import hnsw as N
from . import htmltext as H
from . import idfiles as I
from . import jaccard as J
from . import licenses as L
from . import pii as P
from . import secretscan as K
from . import shards as S
from . import toxicity as X
from . import trie as T
from . import variants as V
from .store import stored, table

Query = Callable[[SparkSession, str], DataFrame]


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.extract(table(spark, sf_dir, "pages"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.scan(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return N.nearest(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = S.by_bytes(table(spark, sf_dir, "documents"), 40)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), "contaminated")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.encode(table(spark, sf_dir, "documents"), digests=True)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.spans(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
    return found.select("doc_id", *map(count, P.BASE_KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = I.new_folder(spark)
    I.write_ids(table(spark, sf_dir, "documents"), folder)
    return I.checksums(spark, folder)


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.jaccard_classes(table(spark, sf_dir, "documents"), words=3, similarity=(90, 100))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = K.find(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
    return found.select("doc_id", *map(count, K.KINDS[:3]), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = V.runs(table(spark, sf_dir, "documents"))
    return V.group(V.counts(runs.select(V.damaged(runs)))).select("word", "form", "root", "n", "n_near", "form_n")


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = stored(T.ranked(table(spark, sf_dir, "conversations")), "ranked")
    return T.prefix_trie(*T.regrafted(turns))


QUERIES: dict[str, Query] = {
    "op1_bpe": op1_bpe,
    "op2_pii": op2_pii,
    "op3_toxicity": op3_toxicity,
    "op4_token_ids": op4_token_ids,
    "op5_jaccard": op5_jaccard,
    "op6_main_text": op6_main_text,
    "op7_licenses": op7_licenses,
    "op8_neighbours": op8_neighbours,
    "op9_shards": op9_shards,
    "op10_decontaminate": op10_decontaminate,
    "op11_secrets": op11_secrets,
    "op12_variants": op12_variants,
    "op13_trie": op13_trie,
}
