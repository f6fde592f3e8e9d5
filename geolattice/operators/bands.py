"""How a search's matches lie in time, month by month, from partition statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_MONTHS = 18


def month_histogram(stats: DataFrame, pruned: Column | None = None) -> DataFrame:
    """month, n: the partitions' counts spread evenly over the months they span."""
    rows = stats if pruned is None else stats.filter(pruned)
    first, last = F.date_trunc("month", "dt_lo"), F.date_trunc("month", "dt_hi")
    spread = rows.withColumn("months", F.sequence(first, last, F.expr("interval 1 month")))
    return spread.select(F.explode("months").alias("month"), (F.col("n") / F.size("months")).alias("share")).groupBy("month").agg(F.sum("share").alias("n"))


def next_band(counts: list[float], cursor: int, target: float, cap: int = MAX_MONTHS) -> tuple[int, int]:
    """Months (first, last) from the cursor on, the fewest that hold the target, at most `cap`; indexes from 0."""
    total, last = 0.0, cursor
    for k in range(cursor, min(len(counts), cursor + cap)):
        total, last = total + counts[k], k
        if total >= target:
            break
    return cursor, last
