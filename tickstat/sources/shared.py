"""Tables in the cluster's shared folder, for results that several passes read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from tickstat.session import ensure_checkpoint_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under ``spark.checkpoint.dir`` and read it back: it is
    evaluated once however often it is read, and a lost executor costs nothing."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
