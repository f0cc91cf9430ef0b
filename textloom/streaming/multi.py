"""Topics that carry several kinds of events, told apart by the schema id that frames each value."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.sources.avro import from_confluent_avro, schema_id
from textloom.sources.registry import SchemaRegistry
from textloom.streaming.topics import Transport


@dataclass(frozen=True)
class EventKind:
    subject: str
    latest_version: int
    schema_ids: tuple[int, ...]


def catalogue(registry: SchemaRegistry, domain: str) -> dict[str, dict[str, EventKind]]:
    """Topic -> event -> kind, of the subjects ``domain.…`` with exactly one dash; key schemas are left out."""
    found: dict[str, dict[str, EventKind]] = {}
    for subject in registry.subjects():
        if not subject.startswith(f"{domain}.") or subject.count("-") != 1:
            continue
        topic, name = subject.split("-")
        event = name.rsplit(".", 1)[-1]
        if event in ("Key", "DefaultKey"):
            continue
        ids = tuple(sorted(registry.schemas_by_id(subject)))
        found.setdefault(topic, {})[event] = EventKind(subject, len(ids), ids)
    return found


def stop_after_batch(query, timeout: float = 60.0, pause: float = 0.05) -> None:
    """Stops a query between two batches: at the next progress, or when nothing runs."""
    began = time.monotonic()
    last = query.lastProgress
    while query.isActive and query.status["isTriggerActive"] and time.monotonic() - began < timeout:
        now = query.lastProgress
        if now is not None and (last is None or now["batchId"] != last["batchId"]):
            break
        time.sleep(pause)
    if query.isActive:
        query.stop()


class EventTopics:
    """Router from topics to a directory of files per event."""

    def __init__(self, spark: SparkSession, transport: Transport, registry: SchemaRegistry, domain: str, root: str):
        self.spark, self.transport, self.registry, self.root = spark, transport, registry, root
        self.events = catalogue(registry, domain)
        self.queries: dict[tuple[str, str], object] = {}
        self.frames: dict[tuple[str, str], DataFrame] = {}

    def _framed(self, df: DataFrame) -> DataFrame:
        return df.where(F.col("value").isNotNull()).withColumn("schemaID", schema_id(F.col("value")))

    def raw(self, topic: str) -> DataFrame:
        """The topic in batch, without empty values, with the schema id of each."""
        return self._framed(self.transport.batch(self.spark, topic))

    def _decoded(self, df: DataFrame, kind: EventKind) -> DataFrame:
        own = df.where(F.col("schemaID").isin(*kind.schema_ids))
        return own.select(from_confluent_avro(F.col("value"), self.registry, kind.subject).alias("value")).select("value.*")

    def batch_frames(self, topic: str) -> dict[str, DataFrame]:
        raw = self.raw(topic)
        return {event: self._decoded(raw, kind) for event, kind in self.events[topic].items()}

    def path(self, topic: str, event: str) -> str:
        return f"{self.root}/{topic}/{event}"

    def start(self, topic: str, interval_ms: int | None = None, file_format: str = "parquet", event: str | None = None) -> None:
        """One query that reads the topic once and gives each event its rows; with ``event`` for that one alone.

        A batch of an event is a directory of its own, so that a batch that runs again writes the same again.
        """
        names = [event] if event else sorted(self.events[topic])
        names = [n for n in names if not ((topic, n) in self.queries and self.queries[topic, n].isActive)]
        if not names:
            return
        kinds = {n: self.events[topic][n] for n in names}

        def route(batch: DataFrame, batch_id: int) -> None:
            batch = batch.persist()
            try:
                there = {r[0] for r in batch.select("schemaID").distinct().collect()}  # as many as there are schemas
                for name, kind in kinds.items():
                    if there.intersection(kind.schema_ids):
                        self._decoded(batch, kind).write.format(file_format).mode("overwrite").save(f"{self.path(topic, name)}/batch-{batch_id}")
            finally:
                batch.unpersist()

        stream = self._framed(self.transport.stream(self.spark, topic))
        where = f"{self.root}/{topic}/{event or 'all'}-CHECKPOINT"
        writer = stream.writeStream.foreachBatch(route).option("checkpointLocation", where)
        writer = writer.trigger(availableNow=True) if interval_ms is None else writer.trigger(processingTime=f"{interval_ms} milliseconds")
        query = writer.start()
        for name in names:
            self.queries[topic, name] = query

    def stop(self, topic: str, event: str | None = None, timeout: float = 60.0) -> None:
        """Ends the query that serves the event (or all of the topic) when the batch that runs is done, however fast rows come in; after ``timeout`` seconds at once."""
        for query in {id(q): q for (t, e), q in self.queries.items() if t == topic and event in (None, e)}.values():
            stop_after_batch(query, timeout)

    def wait(self, topic: str) -> None:
        for query in {id(q): q for (t, _), q in self.queries.items() if t == topic}.values():
            query.awaitTermination()

    def _batches(self, topic: str, event: str) -> list[str]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(topic, event))
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        found = [s.getPath().toString() for s in fs.listStatus(root) if s.isDirectory()]
        return sorted(p for p in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{p}/_SUCCESS")))

    def get(self, topic: str, event: str, interval_ms: int | None = None, file_format: str = "parquet") -> DataFrame:
        """Reads and keeps the event's rows of all whole batches; its query goes on."""
        df = self.spark.read.format(file_format).load(self._batches(topic, event) or self.path(topic, event)).persist()
        df.count()
        old = self.frames.pop((topic, event), None)
        if old is not None:
            old.unpersist()
        self.frames[topic, event] = df
        return df

    def snapshot(self, topic: str, event: str, name: str) -> str:
        from textloom.sources.io import DataRoot

        return DataRoot(self.spark, self.root).copy_snapshot(f"{topic}/{event}", name)
