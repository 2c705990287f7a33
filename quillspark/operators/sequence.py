"""Window and sequence operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Ranges that an ordering over the whole table is cut into.
RANGES = 64


def neighbours(rows: DataFrame, partition: list[str], order: list, value: str, before: str = "prev", after: str = "next") -> DataFrame:
    w = Window.partitionBy(*partition).orderBy(*order)
    return rows.withColumn(before, F.lag(value).over(w)).withColumn(after, F.lead(value).over(w))


def _ranged(rows: DataFrame, by: str) -> DataFrame:
    """Rows with ``__range``: which of RANGES even ranges of the number ``by`` they fall in."""
    shares = [i / RANGES for i in range(1, RANGES)]
    bounds = rows.agg(F.percentile_approx(by, shares, 10_000)).first()[0] or []
    starts = sorted(set(bounds))

    def search(a: int, b: int) -> Column:
        if a == b:
            return F.lit(a)
        m = (a + b) // 2
        return F.when(F.col(by) >= F.lit(starts[m]), search(m + 1, b)).otherwise(search(a, m))

    return rows.withColumn("__range", F.when(F.col(by).isNull(), -1).otherwise(search(0, len(starts))))


def global_number(rows: DataFrame, by: str, ties: list[str], name: str = "rank") -> DataFrame:
    """row_number over the whole table in order of the number ``by``, then ``ties``.

    Rows are numbered inside ranges; the ranges' row counts, at most RANGES + 1 of them, shift the
    numbers.  No task holds the table.
    """
    cut = _ranged(rows, by)
    counts = cut.groupBy("__range").agg(F.count("*").alias("__n"))
    shift = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__range", shift.alias("__shift"))  # RANGES + 1 rows at most
    w = Window.partitionBy("__range").orderBy(F.col(by).asc_nulls_first(), *ties)
    numbered = cut.withColumn("__at", F.row_number().over(w)).join(F.broadcast(offsets), "__range")
    return numbered.withColumn(name, F.col("__at") + F.col("__shift")).drop("__range", "__at", "__shift")


def chain(rows: DataFrame, by: str, ties: list[str], value: str) -> DataFrame:
    """Rows with rank, prev and next of ``value`` along the whole table's order, across all seams.

    Neighbours come from windows inside ranges; at the ends of a range from a table with one row for each range.
    """
    cut = _ranged(rows, by)
    w = Window.partitionBy("__range").orderBy(F.col(by).asc_nulls_first(), *ties)
    placed = cut.withColumn("__at", F.row_number().over(w)).withColumn("__before", F.lag(value).over(w)).withColumn("__after", F.lead(value).over(w))
    ends = placed.groupBy("__range").agg(F.max("__at").alias("__n"), F.min_by(value, "__at").alias("__first"), F.max_by(value, "__at").alias("__last"))
    order = Window.orderBy("__range")  # RANGES + 1 rows at most
    shift = F.coalesce(F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seam = ends.select("__range", "__n", shift.alias("__shift"), F.lag("__last").over(order).alias("__from"), F.lead("__first").over(order).alias("__to"))
    both = placed.join(F.broadcast(seam), "__range")
    both = both.withColumn("rank", F.col("__at") + F.col("__shift")).withColumn("prev", F.when(F.col("__at") == 1, F.col("__from")).otherwise(F.col("__before")))
    both = both.withColumn("next", F.when(F.col("__at") == F.col("__n"), F.col("__to")).otherwise(F.col("__after")))
    return both.drop("__range", "__at", "__before", "__after", "__n", "__shift", "__from", "__to")


def seams(sections: DataFrame, section: str, order: list, value: str) -> DataFrame:
    """(section, value, seam): the first and last row of each section, but for the first of the
    first section and the last of the last."""
    up, down = Window.partitionBy(section).orderBy(*order), Window.partitionBy(section).orderBy(*(c.desc() if isinstance(c, Column) else F.col(c).desc() for c in order))
    ends = sections.withColumn("__up", F.row_number().over(up)).withColumn("__down", F.row_number().over(down)).filter("__up = 1 or __down = 1")
    last = sections.agg(F.min(section).alias("__lo"), F.max(section).alias("__hi"))  # one row
    both = ends.join(F.broadcast(last))
    first_seam = (F.col("__up") == 1) & (F.col(section) != F.col("__lo"))
    last_seam = (F.col("__down") == 1) & (F.col(section) != F.col("__hi"))
    return both.filter(first_seam | last_seam).select(section, value).distinct()


def islands(rows: DataFrame, partition: list[str], order: list[str], same: Column, name: str = "island") -> DataFrame:
    """Rows with the number (from 1) of the run of neighbours of equal ``same``; nulls are equal to each other."""
    w = Window.partitionBy(*partition).orderBy(*order)
    marked = rows.withColumn("__same", same)
    begins = ~F.coalesce(F.lag("__same").over(w).eqNullSafe(F.col("__same")), F.lit(False)) | (F.row_number().over(w) == 1)
    return marked.withColumn("__begins", begins.cast("long")).withColumn(name, F.sum("__begins").over(w)).drop("__same", "__begins")


def carry_forward(rows: DataFrame, partition: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def merge_intervals(rows: DataFrame, partition: list[str], start: str, end: str, slack=0) -> DataFrame:
    """(partition, start, end) of intervals merged where the gap is at most ``slack``; one without a start comes last and opens
    none after a known end."""
    w = Window.partitionBy(*partition).orderBy(F.col(start).asc_nulls_last(), F.col(end).asc_nulls_last())
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("__new", F.when(reach.isNull() | (F.col(start) > reach + slack), 1).otherwise(0))
    numbered = marked.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*partition, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def occurrence(rows: DataFrame, partition: list[str], order: list[str], name: str = "occurrence") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
