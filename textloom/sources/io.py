"""Files under a data root: CSV, Parquet and other formats, safe overwriting, driver-side helpers."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table for costly work on its rows.

    A row group is read by one task. Where a table has fewer of them than the session has cores, its rows are spread
    over the cores; a larger one is left as it lies. Footers are looked at only of fewer files than cores.
    """
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    files = df.inputFiles()
    if len(files) >= cores:
        return df
    footer, conf = spark._jvm.org.apache.parquet.hadoop.ParquetFileReader.readFooter, spark._jsc.hadoopConfiguration()
    groups = sum(footer(conf, spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(f))).getBlocks().size() for f in files)
    return df if groups >= cores else df.repartition(cores)


@dataclass(frozen=True)
class DirectoryContent:
    files: tuple[str, ...]
    directories: tuple[str, ...]


@dataclass
class DataRoot:
    """Everything is named relative to ``root``; formats are suffixes."""

    spark: SparkSession
    root: str

    def path(self, leaf: str, suffix: str = "") -> str:
        return f"{self.root.rstrip('/')}/{leaf}" + (f".{suffix}" if suffix else "")

    def read_csv(self, leaf: str, delimiter: str = "\t") -> DataFrame:
        return self.spark.read.csv(self.path(leaf), sep=delimiter, header=True, inferSchema=True, quote='"', multiLine=True)

    def write_csv(self, df: DataFrame, leaf: str, delimiter: str = "\t") -> None:
        """One file: for small tables that people read."""
        df.coalesce(1).write.mode("overwrite").csv(self.path(leaf, "csv"), sep=delimiter, header=True)

    def read_frame(self, leaf: str, fmt: str = "parquet") -> DataFrame:
        return self.spark.read.format(fmt).load(self.path(leaf, fmt))

    def write_frame(self, df: DataFrame, leaf: str, fmt: str = "parquet") -> None:
        df.write.mode("overwrite").format(fmt).save(self.path(leaf, fmt))

    def overwrite_frame(self, leaf: str, change: Callable[[DataFrame], DataFrame], fmt: str = "parquet") -> None:
        """Rewrites a table from itself: the new one is complete under a name of its own before the old one goes."""
        fresh = f"{leaf}-{uuid.uuid4().hex}"
        self.write_frame(change(self.read_frame(leaf, fmt)), fresh, fmt)
        fs, target = self._fs(self.path(leaf, fmt))
        fs.delete(target, True)
        if not fs.rename(self._fs(self.path(fresh, fmt))[1], target):
            raise OSError(f"can't move {fresh} to {leaf}")
        self.spark.catalog.refreshByPath(self.path(leaf, fmt))

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def exists(self, leaf: str) -> bool:
        fs, target = self._fs(self.path(leaf))
        return fs.exists(target)

    def delete_path(self, leaf: str) -> bool:
        """Whether there was something, and it is gone."""
        fs, target = self._fs(self.path(leaf))
        return bool(fs.exists(target) and fs.delete(target, True))

    def delete_frame(self, leaf: str, fmt: str = "parquet") -> bool:
        return self.delete_path(f"{leaf}.{fmt}")

    def copy_snapshot(self, leaf: str, name: str) -> str:
        """A copy of a directory beside it, under ``.snapshots``."""
        target = f".snapshots/{leaf}/{name}"
        fs, source = self._fs(self.path(leaf))
        _, to = self._fs(self.path(target))
        fs.mkdirs(to.getParent())
        self.spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, source, fs, to, False, self.spark._jsc.hadoopConfiguration())
        return self.path(target)


def write_text(path: str, text: str) -> None:
    Path(path).write_text(text, encoding="utf-8")


def print_to_file(path: str, write: Callable) -> None:
    """Opens the file, hands it to ``write`` and closes it."""
    with Path(path).open("w", encoding="utf-8") as f:
        write(f)


def first_line(path: str) -> str | None:
    with Path(path).open(encoding="utf-8") as f:
        line = f.readline()
    return line.rstrip("\r\n") if line else None


def list_directory(path: str) -> DirectoryContent:
    """Files and directories in a local directory; a missing one is empty."""
    here = Path(path)
    entries = sorted(here.iterdir()) if here.is_dir() else []
    return DirectoryContent(tuple(str(p) for p in entries if p.is_file()), tuple(str(p) for p in entries if p.is_dir()))
