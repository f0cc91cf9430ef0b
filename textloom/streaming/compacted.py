"""A log of states as a base and the batches after it: written incrementally, compacted now and then, exact at any time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class HistoryMissing(LookupError):
    """Batches that the log should hold aren't there: what is left would be taken for all there ever was."""


def newest_rows(df: DataFrame, entity: str, produced: str) -> DataFrame:
    """The newest rows of each entity, ties and removals included."""
    newest = Window.partitionBy(entity).orderBy(F.desc(produced))
    return df.withColumn("_rank", F.rank().over(newest)).where("_rank = 1").drop("_rank")


@dataclass
class CompactedLog:
    """Under ``path``: ``base-N`` has the newest rows of all batches up to N, ``delta-M`` those of batch M.

    A batch costs its own size; every ``every`` batches the base and the batches since are merged into a new base. The
    base before stays for readers that have begun, what is older goes. A batch that runs again writes the same again.
    """

    spark: SparkSession
    path: str
    entity: str = "unique_entity_key"
    produced: str = "producer_timestamp"
    every: int = 20

    def _fs(self, leaf: str = ""):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{leaf}" if leaf else self.path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _complete(self) -> tuple[list[int], list[int]]:
        """Numbers of the bases and batches that were written to their end."""
        fs, root = self._fs()
        found: dict[str, list[int]] = {"base": [], "delta": []}
        if fs.exists(root):
            for status in fs.listStatus(root):
                kind, _, number = status.getPath().getName().partition("-")
                if kind in found and number.isdigit() and fs.exists(self._fs(f"{kind}-{number}/_SUCCESS")[1]):
                    found[kind].append(int(number))
        return sorted(found["base"]), sorted(found["delta"])

    def _parts(self, last: int | None = None) -> tuple[int, list[str]]:
        bases, deltas = self._complete()
        if last is not None:
            bases, deltas = [b for b in bases if b <= last], [d for d in deltas if d <= last]
        base = bases[-1] if bases else -1
        after = [d for d in deltas if d > base]
        lacking = sorted(set(range(base + 1, (after[-1] if last is None and after else base if last is None else last) + 1)) - set(after))
        if lacking:
            raise HistoryMissing(f"{self.path} has no batch {lacking[0]}")
        return base, [f"{self.path}/base-{base}"] * (base >= 0) + [f"{self.path}/delta-{d}" for d in after]

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``."""
        if batch_id:
            self._parts(batch_id - 1)  # before anything is written: an error if the history isn't whole
        keyed = batch.where(F.col(self.entity).isNotNull() & F.col(self.produced).isNotNull())
        newest_rows(keyed, self.entity, self.produced).write.mode("overwrite").parquet(f"{self.path}/delta-{batch_id}")
        base, parts = self._parts(batch_id)
        if batch_id - base >= self.every:
            self._read(parts).write.mode("overwrite").parquet(f"{self.path}/base-{batch_id}")
            self._remove_before(base, batch_id)

    def _remove_before(self, base: int, new: int) -> None:
        bases, deltas = self._complete()
        fs, _ = self._fs()
        for leaf in [f"base-{b}" for b in bases if b < base] + [f"delta-{d}" for d in deltas if d <= base]:
            fs.delete(self._fs(leaf)[1], True)

    def _read(self, parts: list[str]) -> DataFrame:
        whole = self.spark.read.option("mergeSchema", "true").parquet(*parts)
        return newest_rows(whole, self.entity, self.produced)

    def read(self) -> DataFrame:
        """The newest rows of each entity, ties and removals included, as of the last whole batch."""
        _, parts = self._parts()
        if not parts:
            raise LookupError(f"{self.path} is empty so far")
        return self._read(parts)
