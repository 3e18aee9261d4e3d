"""Canonical rounding of floating results for cross-engine comparison.

Sums and means computed in a different order differ in the last bits. The
registered queries and their SQL oracles both round every double to nine
significant digits with the same SQL text, which parses in Spark SQL and in
DuckDB alike (up to array indexing). Rounding is plain IEEE arithmetic,
``floor(x * 10^s + 0.5) / 10^s``, because the two engines' ``round``
functions break ties differently (decimal string vs binary value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

SIG_DIGITS = 9
_STEP = 16
#: 10^k is the product of a coarse and a fine power; together they reach over all of a double's range.
_COARSE = range(-304, 305, _STEP)


def round_sig_sql(expr: str, digits: int = SIG_DIGITS, dialect: str = "spark") -> str:
    """SQL text rounding ``expr`` (a double) to ``digits`` significant digits.

    The decimal exponent e = floor(log10|x|) gives k = digits-1-e, and 10^k is
    taken as 10^(16 a) * 10^b from two literal arrays; rounding is
    ``floor(x * f * g + 0.5) / g / f`` in IEEE arithmetic, identical in both
    engines. Only the array indexing differs between the dialects. Values
    under the smallest normal double (2.3e-308) count as zero.
    """
    x = f"({expr})"
    get = "element_at(array({0}), {1})" if dialect == "spark" else "list_extract([{0}], {1})"
    k = f"CAST({digits - 1} - floor(log10(greatest(abs({x}), 2.3e-308))) AS INTEGER)"
    a = f"CAST(floor({k} / {float(_STEP)}) AS INTEGER)"
    coarse = get.format(", ".join(f"1e{p}" for p in _COARSE), f"least({a}, {304 // _STEP}) + {304 // _STEP + 1}")
    fine = get.format(", ".join(f"1e{p}" for p in range(2 * _STEP)), f"{k} - {_STEP} * least({a}, {304 // _STEP}) + 1")
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN abs({x}) < 2.3e-308 THEN 0.0 WHEN isnan({x}) OR abs({x}) > 1e300 THEN {x} "
            f"ELSE floor({x} * {coarse} * {fine} + 0.5) / {fine} / {coarse} END")


def round_sig(col_name: str, digits: int = SIG_DIGITS) -> Column:
    return F.expr(round_sig_sql(f"`{col_name}`", digits))


def canon(df: DataFrame, digits: int = SIG_DIGITS) -> DataFrame:
    """Round every double column of ``df`` (names and order unchanged)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(round_sig(f.name, digits).cast("double").alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)
