"""Numbers in a global order without a task that sees all rows: ranges, counts of ranges, prefix sums, local numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import storage

PART, PLACE = "__order_part", "__order_place"
LOCAL_BITS = 33  # monotonically_increasing_id holds the partition above and the row's place in it below
FEW = 200_000  # rows, one for each partition that a group spans, that are broadcast


def numbered(df: DataFrame, order: list[Column], name: str, within: list[str] | None = None) -> DataFrame:
    """``df`` with the place (from 1) of each row in ``order``, or of each row among those of equal ``within``.

    Rows are dealt by ranges of ``within`` and ``order``, so a hot group spans as many tasks as its rows need.  The sorted
    frame is cut once; then each (group, partition) is counted, and the counts of a group's earlier partitions are added to
    the places inside the partition.  What meets in one task is a row for each partition that a group spans.  Rows that are
    equal in the whole order get numbers in any order; ``df`` is read twice, so it should be a table.
    """
    keys = [F.col(c) for c in within or []]
    spread = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn(PLACE, F.monotonically_increasing_id())
    kept = storage.cut(spread).withColumn(PART, F.shiftright(PLACE, LOCAL_BITS))
    joined = kept.join(F.broadcast(spans(kept)), PART) if not within else met(kept, few_sent(spans(kept, within)), within)  # one row for each partition
    return joined.select(*df.columns, (F.col("__before") + F.col(PLACE) - F.col("__first") + 1).alias(name))


def spans(kept: DataFrame, within: list[str] | None = None) -> DataFrame:
    """A row for each (group, partition): its first PLACE, its rows, those of the group in earlier partitions, and in all; with a column ``__block``, the least and greatest."""
    keys = [F.col(c) for c in within or []]
    blocks = [f("__block").alias(name) for f, name in ((F.min, "__low"), (F.max, "__high"))] if "__block" in kept.columns else []
    sizes = kept.groupBy(*keys, PART).agg(F.count(F.lit(1)).alias("__n"), F.min(PLACE).alias("__first"), *blocks)
    so_far = F.sum("__n").over(Window.partitionBy(*keys).orderBy(PART))
    return sizes.withColumn("__before", so_far - F.col("__n")).withColumn("__all", F.sum("__n").over(Window.partitionBy(*keys)))


def few_sent(spans_: DataFrame) -> DataFrame:
    """Written once; broadcast where it is small, which the planner would find out when all rows have been shuffled to meet it."""
    near = storage.cut(spans_)
    return F.broadcast(near) if near.count() <= FEW else near


def met(kept: DataFrame, near: DataFrame, within: list[str]) -> DataFrame:
    """Each row with what ``spans`` has of its group and partition."""
    near = near.withColumnsRenamed({c: f"__{c}" for c in [*within, PART]})
    on = F.col(PART) == F.col(f"__{PART}")
    for c in within:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return kept.join(near, on)
