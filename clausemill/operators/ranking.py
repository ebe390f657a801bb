"""Ranks and numbers over groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clausemill.sources.tables import staged


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group. The rank limit is applied before the shuffle, so a hot group sends k rows a task."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col(name) <= k)


def numbered(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """Number the rows of each group from 1 in `order`, whatever the group's size.

    Rows are range-partitioned by group and order; every slice numbers its own rows, and the sizes of the slices before it
    are added, so that no task holds a whole hot group. `order` should be total.
    """
    keys = [F.col(g) for g in group]
    sliced = staged(df.repartitionByRange(*keys, *order).withColumn("_slice", F.spark_partition_id()), "numbered")
    own = F.row_number().over(W.partitionBy("_slice", *group).orderBy(*order))
    before = W.partitionBy(*group).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    sizes = sliced.groupBy("_slice", *group).agg(F.count("*").alias("_n"))
    ahead = sizes.withColumn("_ahead", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return sliced.withColumn("_own", own).join(ahead, ["_slice", *group]).withColumn(name, (F.col("_own") + F.col("_ahead")).cast("long")).drop("_own", "_ahead", "_slice")


def running(df: DataFrame, order: str, values: list[str], group: str | None = None) -> DataFrame:
    """Running sums (sum_x for each x of `values`) over all rows, or the rows of each group, in order of one column, equal ones counted together.

    Rows are range-partitioned by group and order; every slice sums its own rows and the totals of the slices before it are added, so that no
    task holds a whole hot group.
    """
    by = [group] if group else []
    sliced = staged(df.repartitionByRange(*by, order).withColumn("_slice", F.spark_partition_id()), "running")
    own = W.partitionBy("_slice", *by).orderBy(order).rangeBetween(W.unboundedPreceding, 0)
    totals = sliced.groupBy("_slice", *by).agg(*[F.sum(v).alias(f"_{v}") for v in values])
    # One row a slice and group in it: not many more than there are shuffle partitions and groups.
    before = W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    ahead = totals.select("_slice", *by, *[F.coalesce(F.sum(f"_{v}").over(before), F.lit(0)).alias(f"_{v}") for v in values])
    summed = sliced.select("*", *[F.sum(v).over(own).alias(f"sum_{v}") for v in values]).join(ahead, ["_slice", *by])
    return summed.select(*df.columns, *[(F.col(f"sum_{v}") + F.col(f"_{v}")).alias(f"sum_{v}") for v in values])
