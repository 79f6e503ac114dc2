"""Positions of rows in an order, without bringing a group together in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import Scratch, fresh


def positions(rows: DataFrame, group: list[str], order: list[str], scratch: Scratch, name: str = "pos") -> DataFrame:
    """``rows`` with ``name``, the place (from 0) of each row among those of its
    ``group`` in ascending ``order`` (nulls first, equal rows in any order).

    ``rows`` is a written table.  Spark deals it out in ranges of (group, order,
    row), so a group that holds most rows, or one value repeated in most rows,
    spreads over many tasks.  A row's place is its place in its task, less where
    its group begins there, plus the group's rows in earlier tasks; that last
    table has one row for each task a group touches.  ``group`` must not be null.
    """
    row, at, task, first, before, n = fresh(rows, "row", "at", "task", "first", "before", "n")
    keys = [*group, *order, row]
    dealt = (rows.withColumn(row, F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
             .drop(row).withColumn(at, F.monotonically_increasing_id()))
    dealt = scratch.table(dealt.withColumn(task, F.shiftright(at, 33)))
    parts = dealt.groupBy(task, *group).agg(F.min(at).alias(first), F.count("*").alias(n))
    earlier = F.sum(n).over(Window.partitionBy(*group).orderBy(task).rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(task, *group, first, F.coalesce(earlier, F.lit(0)).alias(before))
    return (dealt.join(parts, [task, *group])
            .withColumn(name, F.col(at) - F.col(first) + F.col(before)).select(*rows.columns, name))
