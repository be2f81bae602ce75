"""Small column helpers shared by operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that the optimizer may not substitute into later expressions.

    Long CASE chains that are used several times would be copied into every use, and a filter on them pushed below and
    copied again. A one-element ``inline`` stays in the same stage and keeps them as they are.
    """
    names = set(columns)
    return df.select(*[c for c in df.columns if c not in names], F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


def ascii_lower(column: Column) -> Column:
    """Lower-case of A to Z only; all other letters stay."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """Add ``name``: 1, 2, 3 ... along ``order``, which should be total.

    Ranges of the order are numbered in parallel; only the number of rows of each range is summed up in one place.
    """
    ranges = cut_lineage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranges.withColumn("_place", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    out = placed.join(sizes.select("_range", before.alias("_before")), "_range")
    return out.withColumn(name, F.col("_before") + F.col("_place")).select(*df.columns, name)
