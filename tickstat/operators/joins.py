"""Size-checked broadcast joins.

Time calendars (one row per minute or day) grow with the time span, not with
the number of symbols, so joining them to the bar table should not shuffle
the bar table. AQE only converts a join to a broadcast below
``spark.sql.adaptive.autoBroadcastJoinThreshold`` (10 MB by default), which a
multi-year minute calendar exceeds. Here the small side is counted first
(one cheap job on a filtered, aggregated table) and broadcast only when the
count is under a row bound; beyond it the join stays a shuffle join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of a narrow calendar (a timestamp and a few flags) are ~20-40 bytes in a
# broadcast relation: 5 million rows stay well under a few hundred MB.
MAX_BROADCAST_ROWS = 5_000_000


def fits_broadcast(small: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> bool:
    """True when ``small`` has at most ``max_rows`` rows.

    A plain distributed count (partial counts per task): ``limit(n).count()``
    would move up to n rows per partition into a single task."""
    return small.count() <= max_rows


def broadcast_if_small(small: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``broadcast(small)`` when its row count is under the bound, else ``small``."""
    return F.broadcast(small) if fits_broadcast(small, max_rows) else small
