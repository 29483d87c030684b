"""Intermediate tables in the folder that all executors share.

Iterative jobs cut their lineage by writing a table there and reading it again, so a lost executor
costs only the tasks that it ran.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where that is unset, as in tests, a new temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lexharbor-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Results of operators that the session still reads.
_KEPT: list[str] = []


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Results that operators keep within are removed at the end: what was made of them has been written by then."""
    before = len(_KEPT)
    try:
        yield
    finally:
        Scratch(spark, "passing").drop(*_KEPT[before:])
        del _KEPT[before:]


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any spelling of case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Scratch:
    """Tables of one operator run; ``keep`` writes the result and removes all others."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: list[str] = []
        self.tables: dict[int, str] = {}
        self.held: list[DataFrame] = []  # so that ids stay taken

    def path(self, name: str) -> str:
        self.paths.append(f"{self.root}/{uuid.uuid4().hex[:8]}-{name}")
        return self.paths[-1]

    def save(self, df: DataFrame, name: str, last_use_of: tuple[DataFrame, ...] = ()) -> DataFrame:
        """Write ``df`` and read it again; tables of this run that nothing needs from then on are removed.

        The written table replaces the shuffles behind it, so Spark is told to drop their files at once.
        """
        path = self.path(name)
        with self.tidy():
            df.write.option("compression", "zstd").parquet(path)
        for old in last_use_of:
            gone = self.tables.pop(id(old))
            self.drop(gone)
            self.paths.remove(gone)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables[id(out)] = path
        self.held.append(out)
        return out

    @contextmanager
    def tidy(self) -> Iterator[None]:
        """Shuffle files of the queries within are dropped as each of them ends."""
        key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(key)
        self.spark.conf.set(key, "true")
        try:
            yield
        finally:
            self.spark.conf.set(key, before)
            self.spark._jvm.System.gc()  # Spark removes a shuffle's files once the driver has let go of it

    def drop(self, *paths: str) -> None:
        hadoop = self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(hadoop).delete(p, True)

    def clear(self) -> None:
        """Remove every table of this run."""
        self.drop(*self.paths)
        self.paths, self.tables, self.held = [], {}, []

    def keep(self, df: DataFrame) -> DataFrame:
        """Write the result, remove everything else of this run, and return the result."""
        old = list(self.paths)
        out = self.save(df, "result")
        self.drop(*old)
        self.paths = self.paths[-1:]
        _KEPT.append(self.paths[0])
        return out
