"""Row numbers without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a bucket, about; buckets are sorted by themselves.
BUCKET = 1_000_000


def number_rows(df: DataFrame, *keys: str, name: str = "_row") -> DataFrame:
    """Adds the place (from 1) of every row in the order of keys.

    Rows go to ranges of the first key, found from its quantiles; a row's number is its place in its
    range after the rows of all ranges before. A first key without arithmetic is numbered in one range.
    """
    first = df.schema[keys[0]].dataType
    ranges: list = []
    if isinstance(first, T.NumericType):
        n = df.count()
        if n > BUCKET:
            steps = [k * BUCKET / n for k in range(1, -(-n // BUCKET))]
            ranges = sorted(set(df.approxQuantile(keys[0], steps, 0.001)))
    bucket: Column = F.lit(0)
    if ranges:
        edges = F.array(*[F.lit(r) for r in ranges])
        bucket = F.size(F.filter(edges, lambda e: e < F.col(keys[0])))
    keyed = df.withColumn("_range", bucket)
    sizes = keyed.groupBy("_range").count()  # one row a range
    before = sizes.withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*keys))
    return keyed.withColumn("_place", place).join(F.broadcast(before), "_range").withColumn(name, (F.col("_before") + F.col("_place")).cast("long")).drop("_range", "_place", "_before")
