"""Dense numbers without a window over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrydex.sources import written


def dense_numbers(df: DataFrame, group: list[str], key: str, out: str, span: int | None = None) -> DataFrame:
    """df with the 0-based number of each row in its group, by an ascending key that is unique in the group.

    Rows are sorted into ranges of (group, key), by samples of the keys, so sparse or
    clustered keys make ranges of like size; a row's place in its range is its place in
    the written file. Rows are counted by range and group, and the counts before are
    summed: a row for each range and group. No task holds a group. ``span``: rows of a
    range, about; else as Spark's settings say.
    """
    by = [*group, key]
    ranged = df.repartitionByRange(*by) if span is None else df.repartitionByRange(max(1, -(-df.count() // span)), *by)
    place = F.monotonically_increasing_id()
    ranged = ranged.sortWithinPartitions(*by).withColumns({"_range": F.shiftright(place, 33), "_at": place.bitwiseAND(F.lit((1 << 33) - 1))})
    rows = written(ranged, "numbers")
    counts = rows.groupBy(*group, "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*group, "_range", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_base"))
    return rows.join(base, [*group, "_range"]).withColumn(out, (F.col("_base") + F.col("_at")).cast("bigint")).select(*df.columns, out)
