"""Ranks and running sums over whole groups without sorting a group in one task.

Rows are cut into ranges of the wanted order, each range is ranked by itself and starts
where the totals of the ranges before it end. A group that holds any part of the table
is spread over as many tasks as its share of the ranges.

Defined cases: rows that tie in the order are ranked in no stated order, so the order
should end with a unique column; NULLs of the group columns form a group; NULLs of the
order come first; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apothecary.session import materialise, width

#: Hexadecimal digits of a hash that name its range: 256 ranges a group.
DIGITS = 2


def _offset(rows: DataFrame, by: list[str], amount: Column) -> DataFrame:
    """``rows`` with ``_before``, what the group's earlier ranges (``_p``) amount to."""
    totals = rows.groupBy(*by, "_p").agg(F.sum(amount).alias("_t"))
    # One row a group and range: few, whatever the table holds.
    earlier = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], F.col("_p").alias("_q"), F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_before"))
    same = F.col("_p") == F.col("_q")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return rows.join(totals, same).drop("_q", *[f"_g{i}" for i in range(len(by))])


def by_hash(df: DataFrame, by: list[str], digest: Column, tie: str, rank: str) -> DataFrame:
    """``df`` with ``rank`` from 1 within each group, in order of the hexadecimal ``digest`` and then ``tie``.

    Digests spread evenly, so their first digits are the ranges and nothing need be sampled.
    """
    rows = df.withColumn("_d", digest).withColumn("_p", F.substring("_d", 1, DIGITS))
    inner = Window.partitionBy(*by, "_p").orderBy("_d", tie)
    return _offset(rows, by, F.lit(1)).withColumn(rank, (F.row_number().over(inner) + F.col("_before")).cast("bigint")).drop("_d", "_p", "_before")


def _ranged(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """``df`` with its range as ``_p``; written once, since sampled bounds may differ from one reading to the next."""
    keys = [F.col(c) for c in by]
    return materialise(df.repartitionByRange(width(df.sparkSession), *keys, *order).withColumn("_p", F.spark_partition_id()), "ranges")


def numbered(df: DataFrame, by: list[str], order: list[Column], rank: str) -> DataFrame:
    """``df`` with ``rank`` from 1 within each group of ``by``, in ``order``."""
    rows = _ranged(df, by, order)
    inner = Window.partitionBy(*by, "_p").orderBy(*order)
    return _offset(rows, by, F.lit(1)).withColumn(rank, (F.row_number().over(inner) + F.col("_before")).cast("bigint")).drop("_p", "_before")


def running(df: DataFrame, by: list[str], order: list[Column], amount: str, total: str) -> DataFrame:
    """``df`` with ``total``, the sum of ``amount`` in its group up to and with the row."""
    rows = _ranged(df, by, order)
    inner = Window.partitionBy(*by, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return _offset(rows, by, F.col(amount)).withColumn(total, F.sum(amount).over(inner) + F.col("_before")).drop("_p", "_before")
