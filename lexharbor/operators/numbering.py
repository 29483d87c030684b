"""Numbers of rows within keys, where a key may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..sources.stored import stored


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "number", total: str | None = None) -> DataFrame:
    """df with the number, from 1, of each row among those of equal keys, in the given order; null keys are equal.

    Rows are dealt by range of keys and order, so that the rows of one key lie in as many partitions as they need, and
    stored. Numbers are counted within a partition; a table of a row for each key and partition says how many came
    before. total adds the number of the key's rows. Columns in keys and order are of types that sort.
    """
    part, at = (f"_{name}_{x}" for x in ("part", "at"))
    placed = stored(df.repartitionByRange(*keys, *order).withColumn(part, F.spark_partition_id()), "numbered")
    counts = placed.groupBy(*keys, part).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.select(*(F.col(k).alias(f"_{i}_key") for i, k in enumerate(keys)), F.col(part).alias(at), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*keys)).alias("_all"))
    same = F.col(part) == F.col(at)
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_{i}_key"))
    own = F.row_number().over(Window.partitionBy(part, *keys).orderBy(*order))
    out = placed.withColumn(name, own).join(sums, same).withColumn(name, F.col(name) + F.col("_before"))
    if total is not None:
        out = out.withColumn(total, F.col("_all"))
    return out.select(*df.columns, name, *([total] if total else []))
