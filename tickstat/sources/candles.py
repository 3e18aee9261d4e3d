"""Scan per-pair Parquet files and derive the symbol from the file name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickstat.functions.symbols import base_asset, quote_asset


def list_files(spark: SparkSession, path: str, suffix: str = ".parquet") -> list[str]:
    """Sorted paths of the files directly under ``path`` (any file system that
    Spark reads). The files' contents are not read; only names travel."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path).select("path")
    return sorted(r.path for r in names.collect())


def read_candles(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: StructType | None = None,
    max_files: int | None = None,
) -> DataFrame:
    """Scan one folder (or a list of files) of ``<BASE>-<QUOTE>.parquet`` files.

    ``symbol`` comes from the file name through the ``_metadata`` column (no
    per-file unions); base and quote come from ``symbol``. ``max_files`` keeps
    the first N files by name (local development), as a list of paths -- not
    the comma-joined string that fails to resolve. By default the schema is
    read from the Parquet footers (numeric types are normalized later by
    ``bar_features``); pass ``schema=RAW_CANDLE`` to enforce the declared one.
    """
    paths = [path] if isinstance(path, str) else list(path)
    if max_files:
        files: list[str] = []
        for p in paths:
            files.extend(list_files(spark, p) if not p.endswith(".parquet") else [p])
        files = sorted(files)[:max_files]
        if not files:
            raise FileNotFoundError(f"nothing to read: no *.parquet file in {paths}")
        paths = files
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(*paths)
    name = F.url_decode(F.col("_metadata.file_name"))
    df = df.withColumn("symbol", F.regexp_extract(name, r"^(.*)\.parquet$", 1))
    return df.withColumn("base_asset", base_asset()).withColumn("quote_asset", quote_asset())


def schema_report(df: DataFrame) -> DataFrame:
    """(position, column, type, nullable) of ``df`` as a small DataFrame."""
    spark = df.sparkSession
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "position int, column string, type string, nullable boolean")
