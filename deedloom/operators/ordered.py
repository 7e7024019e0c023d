"""Running sums and numbers in document order in two levels, so that no task has to sort a whole hot document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(
    rows: DataFrame, doc: str, part: Column, order: list[str], sums: dict[str, Column], firsts: dict[str, Column] | None = None
) -> DataFrame:
    """Rows with running sums, each including its row, and with a document's first values that aren't null. ``part`` cuts
    a document into ranges in the same order (such as page ranges): the ranges' totals, combined map-side, are summed
    first, one row per range; then every range is sorted by itself.

    Rows without a document belong to none and are left out.
    """
    names, firsts = list(sums), firsts or {}
    cut = rows.where(F.col(doc).isNotNull()).withColumn("_part", part)
    at = F.struct(*order)
    totals = cut.groupBy(doc, "_part").agg(
        *[F.sum(e).alias(n) for n, e in sums.items()], *[F.min_by(e, F.when(e.isNotNull(), at)).alias(n) for n, e in firsts.items()]
    )
    ranges = Window.partitionBy(doc).orderBy("_part")
    earlier = ranges.rowsBetween(Window.unboundedPreceding, -1)
    whole = ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = totals.select(
        doc, "_part",
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_{n}") for n in names],
        *[F.first(n, ignorenulls=True).over(whole).alias(n) for n in firsts],
    )
    w = Window.partitionBy(doc, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.join(before, [doc, "_part"])
    out = out.withColumns({n: F.sum(e).over(w) + F.col(f"_{n}") for n, e in sums.items()})
    return out.drop("_part", *[f"_{n}" for n in names])


def dense_number(rows: DataFrame, doc: str, slot: str, name: str, size: int = 4096) -> DataFrame:
    """Rows, one per document and ``slot``, numbered from 0 in the slots' order without gaps."""
    return running(rows, doc, F.floor(F.col(slot) / size), [slot], {name: F.lit(1)}).withColumn(name, (F.col(name) - 1).cast("int"))
