"""Tables in the shared folder, to cut lineage between passes.

Executors may be lost at any time; what a later pass reads again is therefore
written as Parquet under ``spark.checkpoint.dir`` (one copy for all, not in an
executor's own folder) and read back with a known size.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickstat.session import ensure_checkpoint_dir


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one only where none is set (tests)."""
    return spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Up to so many ids (16 MB of integers) are sent to the tasks; more are joined by a shuffle.
MOST_SENT = 2_000_000


def sent(small: DataFrame) -> DataFrame:
    """A stored table marked for broadcast while it has few rows (of a few numbers each)."""
    return F.broadcast(small) if small.count() <= MOST_SENT else small


def without(docs: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows whose key isn't in ``gone`` (one column); rows with a null key stay."""
    gone = stored(gone.toDF("_gone"), "gone")
    return docs.join(sent(gone), docs[key] == gone["_gone"], "left_anti")


def told_apart(docs: DataFrame, doc_id: str, text: str, once: bool = False) -> tuple[DataFrame, bool]:
    """The documents with a column _key that tells them apart by id and text, and
    whether that differs from the id: the id where it occurs once, a hash of
    both where it is null or repeated. With ``once``, one row of each key."""
    kind = "bigint" if dict(docs.dtypes)[doc_id] in ("tinyint", "smallint", "int", "bigint") else "string"
    own = docs.withColumn("_key", F.col(doc_id).cast(kind))
    care = own.groupBy("_key").count().where("count > 1 or _key is null")
    care = stored(care.select(F.col("_key").alias("_care")), "repeated")
    if care.isEmpty():
        return own, False
    on = F.expr("_key <=> _care")
    hashed = F.xxhash64(F.col("_key").isNull(), "_key", F.col(text).isNull(), F.col(text).cast("string")).cast(kind)
    odd = own.join(sent(care), on, "left_semi").withColumn("_key", hashed)
    return own.join(sent(care), on, "left_anti").unionByName(odd.dropDuplicates(["_key"]) if once else odd), True
