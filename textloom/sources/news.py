"""Message directories: a directory per group, a file per message, split in training and test by the directory above."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """(group, message, text) of every file two levels down; texts are ISO-8859-1."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    parts = F.split(F.regexp_replace("path", r"/+$", ""), "/")
    return files.select(F.element_at(parts, -2).alias("group"), F.element_at(parts, -1).alias("message"), F.decode("content", "ISO-8859-1").alias("text"))


def read_datasets(spark: SparkSession, root: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    return {n: read_messages(spark, f"{root}/{n}") for n in names}


def train_and_test(sets: dict[str, DataFrame]) -> tuple[DataFrame | None, DataFrame | None]:
    """Union of the sets whose name says ``train``, and of those that say ``test``."""

    def joined(word: str) -> DataFrame | None:
        found = None
        for name in sorted(sets):
            if word in name.lower():
                found = sets[name] if found is None else found.unionByName(sets[name])
        return found

    return joined("train"), joined("test")


def convert_to_parquet(spark: SparkSession, root: str, target: str, names: tuple[str, ...], process=lambda df: df, partitions: int | None = None) -> None:
    for name, df in read_datasets(spark, root, names).items():
        made = process(df)
        (made.repartition(partitions) if partitions else made).write.mode("overwrite").parquet(f"{target}/{name}.parquet")
