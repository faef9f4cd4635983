"""Rank and running total over groups whose number has no bound (Q8, Q9).

A window ordered over the whole table runs in one task.  Instead the different values are counted (a value that many
groups share is one row from here on), cut into ranges by value, and ranked within each range; one row for each range says what lies above
it.  The groups then meet the rank of their value in a join, whose hot values Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.numeric import q
from tabulon.operators.ordering import _PID, range_partitioned
from tabulon.session import materialize


def rank_and_running(groups: DataFrame, value: str, *, rank: str = "_rank", running: str = "_running",
                     num_partitions: int | None = None) -> DataFrame:
    """The rows with their rank by falling ``value`` (ties share one, nulls come last) and the total down to and with
    their ties (nulls add nothing), both as the windows ``RANK()`` and ``SUM(value)`` over ``ORDER BY value DESC`` have them.

    The rows are written once: sums of doubles may differ in the last bit where they are computed again.
    """
    rows = materialize(groups)
    n, total, v = F.col("__n"), F.col("__total"), q(value)
    levels = (rows.groupBy(v.alias("__level")).agg(F.count(F.lit(1)).alias("__n"))
                  .select("__level", n, (F.col("__level") * n).alias("__total")))
    placed = range_partitioned(levels, F.desc("__level"), num_partitions)
    above = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    # One row for each range: a broadcast side bounded by the number of partitions.
    starts = (placed.groupBy(_PID).agg(F.sum(n).alias("__n"), F.sum(total).alias("__total"))
                    .select(_PID, F.coalesce(F.sum(n).over(above), F.lit(0)).alias("__n_above"), F.sum(total).over(above).alias("__above")))
    within = Window.partitionBy(_PID).orderBy(F.desc("__level")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here, before = F.sum(total).over(within).alias("__here"), F.sum(n).over(within).alias("__upto")
    ranked = (placed.select(_PID, "__level", n, here, before).join(F.broadcast(starts), _PID)
                    .select("__level", (F.col("__n_above") + F.col("__upto") - n + 1).alias(rank),
                            F.coalesce(F.col("__above") + F.col("__here"), F.col("__here"), F.col("__above")).alias(running)))
    return rows.join(ranked, v.eqNullSafe(F.col("__level"))).drop("__level")
