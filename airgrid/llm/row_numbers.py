"""Numbers all rows of a table 0, 1, 2, ... in a given order without bringing them into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airgrid.llm.common import written


def numbered(rows: DataFrame, order: Sequence[Column], out: str = "row") -> tuple[DataFrame, int]:
    """The rows with their place in ``order``, and their count.

    Ranges of the order go to tasks, which number their own rows; the rows of the tasks before are
    added from one small row per task.  Ties are broken by the place in the input, so that a value
    that fills a third of the table is cut into ranges too.  The ranges are written before they are
    counted, because ranges come from a sample and must not be drawn twice.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.withColumn("_tie", F.monotonically_increasing_id())
    ordered = ordered.repartitionByRange(n, *order, F.col("_tie")).sortWithinPartitions(*order, F.col("_tie"))
    place = F.monotonically_increasing_id()
    stored = written(
        ordered.drop("_tie").withColumns({"_part": F.shiftright(place, 33), "_own": place.bitwiseAND(F.lit((1 << 33) - 1))}), "ranges"
    )
    sizes = stored.groupBy("_part").agg((F.max("_own") + 1).alias("_size"))
    total = sizes.agg(F.sum("_size")).first()[0] or 0
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    return stored.join(starts, "_part").withColumn(out, F.col("_start") + F.col("_own")).drop("_part", "_own", "_start", "_size"), total
