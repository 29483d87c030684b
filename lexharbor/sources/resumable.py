"""Outputs that a stopped run leaves half-way and the next run completes.

Each output folder belongs to a fingerprint of what made it: parameters and inputs. Rows are written in numbered
batches of ids; a batch's folder appears under its final name in one rename, which marks it as done.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def fingerprint(parameters: dict, inputs: DataFrame) -> str:
    """Hash of the parameters and of all rows of the inputs, whatever their order; rows are summed up by Spark."""
    row = [F.col(c) for c in inputs.columns]
    n, low, high = inputs.agg(F.count("*"), *(F.sum(F.xxhash64(*row, F.lit(i)).cast("decimal(38,0)")) for i in (0, 1))).first()
    known = json.dumps([parameters, inputs.columns, n, str(low), str(high)], sort_keys=True, ensure_ascii=False, default=str)
    return hashlib.sha256(known.encode()).hexdigest()[:32]


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def done_batches(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches that are complete."""
    fs, path = _hadoop(spark, folder)
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n.removeprefix("done-")) for n in names if n.startswith("done-"))


def run(rows: DataFrame, key: str, make: Callable[[DataFrame], DataFrame], path: str, parameters: dict, batches: int = 16, watched: tuple[str, ...] = ()) -> DataFrame:
    """``make`` of all rows, batch by batch, written below ``path``; batches that an earlier run completed are read only.

    A row's batch follows from its key, so the batches of a run that goes on are those of the one that stopped. With
    other parameters, ids or values of the watched columns the fingerprint differs, and so does the folder. Left-overs of a batch that was not
    completed are removed first. ``make`` has to give columns of the same names and types for every batch.
    """
    spark = rows.sparkSession
    folder = f"{path.rstrip('/')}/{fingerprint({**parameters, 'batches': batches}, rows.select(key, *watched))}"
    fs, _ = _hadoop(spark, folder)
    have = set(done_batches(spark, folder))
    if len(have) < batches:
        fs.delete(_hadoop(spark, f"{folder}/open")[1], True)
    number = F.pmod(F.xxhash64(key), F.lit(batches))
    for i in range(batches):
        if i not in have:
            made = f"{folder}/open/{uuid.uuid4().hex}"
            make(rows.filter(number == i)).write.parquet(made)
            if not fs.rename(_hadoop(spark, made)[1], _hadoop(spark, f"{folder}/done-{i}")[1]):
                raise OSError(f"batch {i} of {folder} can't be completed")
    fs.delete(_hadoop(spark, f"{folder}/open")[1], True)
    return spark.read.parquet(*(f"{folder}/done-{i}" for i in range(batches)))
