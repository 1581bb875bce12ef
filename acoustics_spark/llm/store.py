"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..store import shared_folder


#: While a table is written its shuffle files go with it, and Python gets this many rows at a time: whole texts may be long.
SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
_open: list[list[Tables]] = []


class Tables:
    """Tables written to the shared folder by one call of an operator.

    Writing cuts the lineage: a lost executor costs only the tasks of the running job, as what was written before
    is read again from shared storage. So a written table's shuffle files are deleted at once, and local disks hold those
    of one table at a time.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.n = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0
        for made in _open:
            made.append(self)

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n}"
        conf = self.spark.conf
        before = {k: conf.get(k, None) for k in SETTINGS}
        for k, v in SETTINGS.items():
            conf.set(k, v)
        try:
            df.write.parquet(path)
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stored_at = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a table of :meth:`write` that nothing reads any more."""
        self._delete(df._stored_at)

    def keep_only(self, *dfs: DataFrame) -> None:
        """Deletes all tables but these, which are read later."""
        kept = {df._stored_at for df in dfs}
        for path in (f"{self.folder}/{i + 1}" for i in range(self.n)):
            if path not in kept:
                self._delete(path)

    def _delete(self, path: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def swept() -> Iterator[None]:
    """Deletes the tables that operators called inside have written; what they return must be written by then."""
    made: list[Tables] = []
    _open.append(made)
    try:
        yield
    finally:
        _open.remove(made)
    for tables in made:
        tables._delete(tables.folder)


def own_name(df: DataFrame, name: str) -> str:
    """name, lengthened until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
