"""Places in a total order over all rows, without a task that sees them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.tables import checkpointed


def ranked(rows: DataFrame, order: Sequence[Column | str], name: str = "rank", start: int = 1) -> DataFrame:
    """The rows with name, their place (from start) in the given order; equals take places one after the other.

    Rows move once, by ranges of the order; the tasks' numbers of rows, as many as there
    are tasks, are summed over one small table.
    """
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    held = checkpointed(spread.withColumn("__row", F.monotonically_increasing_id()))
    task, place = F.shiftright("__row", 33), F.col("__row").bitwiseAND(F.lit((1 << 33) - 1))
    before = F.sum("__n").over(Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1))
    starts = held.groupBy(task.alias("__task")).agg(F.count("*").alias("__n")).select("__task", F.coalesce(before, F.lit(0)).alias("__before"))
    # a row for each task
    out = held.withColumn("__task", task).join(F.broadcast(starts), "__task")
    return out.withColumn(name, (F.col("__before") + place + start).cast("long")).drop("__row", "__task", "__before")
