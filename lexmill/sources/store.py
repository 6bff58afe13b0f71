"""The table store: Parquet folders below one root, replaced as a whole."""

from __future__ import annotations

import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.schemas import TABLES


#: How the name of a table begins while it is being replaced.
ASIDE = ".aside-"


class Store:
    """Reads and replaces the corpus tables below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}.parquet"

    def _fs(self):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.root)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def exists(self, name: str) -> bool:
        fs, path = self._fs()
        if not fs.exists(path(self.path(name))):
            self._recover(name)
        return fs.exists(path(self.path(name)))

    def read(self, name: str) -> DataFrame:
        """The table; one that was never written is empty."""
        if not self.exists(name):
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.parquet(self.path(name))

    def write(self, name: str, rows: DataFrame, sort: list[str] | None = None, partitions: int | None = None) -> None:
        """Replace a table: written beside the old one, then moved in its place, so a failed job changes nothing.

        The old table is moved aside before, and removed only when the new one is in its place; :meth:`read` puts it back if
        the program ended between the two moves.
        """
        if partitions:
            rows = rows.repartitionByRange(partitions, *sort) if sort else rows.repartition(partitions)
        if sort:
            rows = rows.sortWithinPartitions(*sort)
        fresh = f"{self.root}/.{name}-{uuid.uuid4().hex}"
        rows.write.parquet(fresh)
        fs, path = self._fs()
        place, aside = path(self.path(name)), path(f"{self.root}/{ASIDE}{name}")
        self._recover(name)
        had = fs.exists(place)
        if had and not fs.rename(place, aside):
            raise OSError(f"cannot move {name} aside")
        if not fs.rename(path(fresh), place):
            if had:
                fs.rename(aside, place)
            raise OSError(f"cannot move the new {name} into its place")
        fs.delete(aside, True)

    def _recover(self, name: str) -> None:
        """Put back a table that was moved aside and never replaced, and remove one that was replaced."""
        fs, path = self._fs()
        place, aside = path(self.path(name)), path(f"{self.root}/{ASIDE}{name}")
        if fs.exists(aside):
            if fs.exists(place):
                fs.delete(aside, True)
            elif not fs.rename(aside, place):
                raise OSError(f"cannot put {name} back")

    def count(self, name: str) -> int:
        return self.read(name).count() if self.exists(name) else 0

    def truncate(self, *names: str) -> dict[str, int]:
        """Drop the rows of these tables, all by default; the number of rows each had."""
        names = names or tuple(TABLES)
        had = {name: self.count(name) for name in names}
        fs, path = self._fs()
        for name in names:
            fs.delete(path(self.path(name)), True)
        return had

    def remove(self) -> None:
        """Remove the store as a whole."""
        fs, path = self._fs()
        fs.delete(path(self.root), True)

    def statistics(self) -> DataFrame:
        """``(table_name, n_rows, n_files, n_bytes)`` of the tables that exist."""
        spark, out = self.spark, []
        for name in TABLES:
            if self.exists(name):
                rows = self.read(name)
                out.append(rows.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows", F.lit(len(rows.inputFiles())).alias("n_files"), F.lit(self._bytes(name)).cast("long").alias("n_bytes")))
        if not out:
            return spark.createDataFrame([], "table_name string, n_rows long, n_files int, n_bytes long")
        both = out[0]
        for x in out[1:]:
            both = both.unionByName(x)
        return both

    def _bytes(self, name: str) -> int:
        fs, path = self._fs()
        return fs.getContentSummary(path(self.path(name))).getLength()

    def analyse(self, name: str, as_table: str) -> None:
        """Register a table in the catalogue and take its column statistics for the optimizer."""
        spark = self.spark
        spark.sql(f"create table if not exists `{as_table}` using parquet location '{self.path(name)}'")
        spark.sql(f"analyze table `{as_table}` compute statistics for all columns")


def clean_local(root: str) -> None:
    """Remove a local store as a whole."""
    if os.path.isdir(root):
        shutil.rmtree(root)
