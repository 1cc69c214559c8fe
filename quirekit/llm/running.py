"""Running totals over all rows in one order, without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from quirekit.llm.common import store


def running_totals(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """``df`` with ``before``: the sum of the long column ``value`` over all rows that come earlier in ``order``.

    Rows are dealt by ranges of the order, so ties don't gather in one task as long as ``order`` ends in a column
    that tells rows apart. Each range adds up its own rows; one row a range then gives the ranges' starts. A null
    value counts as 0. Rows that are equal in all of ``order`` follow each other in any order. ``df`` is read twice
    (once to sample ranges): pass a stored table where it is costly. ``before`` must not be a column of ``df``.
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fields, at = df.columns, df.columns.index(value)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            own = batch.column(at).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            upto = total + np.cumsum(own)
            columns = [*batch.columns, pa.array(upto - own), pa.array(np.full(len(own), part, dtype=np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=[*fields, "before", "_range"])
            total = int(upto[-1]) if len(upto) else total

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", before long, _range long"
    placed = store(df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(add_up, schema), name)
    sums = placed.groupBy("_range").agg(F.sum(F.coalesce(F.col(value), F.lit(0))).alias("_sum"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_range_start"))  # as many rows as ranges
    return placed.join(F.broadcast(starts), "_range").withColumn("before", F.col("before") + F.col("_range_start")).select(*fields, "before")
