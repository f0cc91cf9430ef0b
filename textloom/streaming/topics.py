"""Topics as always-fresh tables: transports, event sourcing, sinks, collections."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.sources.connectors import kafka_read_options, kafka_write_options
from textloom.sources.registry import SchemaRegistry
from textloom.sources.serde import deserialize, serialize
from textloom.streaming.compacted import CompactedLog, HistoryMissing, newest_rows

Transform = Callable[[DataFrame], DataFrame]
ENVELOPE = "key binary, value binary, topic string, timestamp timestamp"
KAFKA_COLUMNS = tuple("key unique_entity_key producer_timestamp timestamp kafka_value_is_null".split())


# transports --


class Transport(Protocol):
    def stream(self, spark: SparkSession, topic: str) -> DataFrame: ...
    def batch(self, spark: SparkSession, topic: str) -> DataFrame: ...
    def write_stream(self, df: DataFrame, topic: str, checkpoint: str): ...


@dataclass(frozen=True)
class KafkaTransport:
    """Needs Spark's Kafka package on the cluster."""

    brokers: str

    def stream(self, spark: SparkSession, topic: str) -> DataFrame:
        return spark.readStream.format("kafka").options(**kafka_read_options(self.brokers, topic)).load()

    def batch(self, spark: SparkSession, topic: str) -> DataFrame:
        return spark.read.format("kafka").options(**kafka_read_options(self.brokers, topic, stream=False)).load()

    def write_stream(self, df: DataFrame, topic: str, checkpoint: str):
        return df.writeStream.format("kafka").options(**kafka_write_options(self.brokers, topic, checkpoint))


@dataclass(frozen=True)
class FileTransport:
    """A directory of Parquet files per topic with the same columns."""

    root: str

    def _path(self, topic: str) -> str:
        return f"{self.root}/{topic}"

    def publish(self, df: DataFrame, topic: str) -> None:
        """Appends (key, value and what else of the envelope is there)."""
        for name, kind in (("key", "binary"), ("value", "binary")):
            df = df.withColumn(name, F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind))
        df = df.withColumn("topic", F.lit(topic))
        if "timestamp" not in df.columns:
            df = df.withColumn("timestamp", F.current_timestamp())
        df.select("key", "value", "topic", "timestamp").write.mode("append").parquet(self._path(topic))

    def stream(self, spark: SparkSession, topic: str) -> DataFrame:
        return spark.readStream.schema(ENVELOPE).parquet(self._path(topic))

    def batch(self, spark: SparkSession, topic: str) -> DataFrame:
        return spark.read.schema(ENVELOPE).parquet(self._path(topic))

    def write_stream(self, df: DataFrame, topic: str, checkpoint: str):
        for name in ("key", "value"):
            df = df.withColumn(name, F.col(name).cast("binary") if name in df.columns else F.lit(None).cast("binary"))
        made = df.select("key", "value", F.lit(topic).alias("topic"), F.current_timestamp().alias("timestamp"))
        return made.writeStream.format("parquet").option("path", self._path(topic)).option("checkpointLocation", checkpoint)


# event sourcing --


def split_string_key(key: Column) -> tuple[Column, Column]:
    """(entity, producer timestamp) of ``entity.timestamp``, at the last dot; a suffix that is no number is an error."""
    return F.regexp_extract(key, r"^(.*)\.([^.]*)$", 1), F.substring_index(key, ".", -1).cast("long")


def split_struct_key(key: str, kind: T.StructType) -> tuple[Column, Column]:
    """The same of a struct whose last field is the timestamp; nulls read as the word null."""
    parts = [F.coalesce(F.col(f"{key}.{f.name}").cast("string"), F.lit("null")) for f in kind.fields]
    return split_string_key(F.concat_ws(".", *parts))


def with_event_columns(df: DataFrame, entity: Column, produced: Column, payload: Column) -> DataFrame:
    """Adds unique_entity_key, producer_timestamp and kafka_value_is_null."""
    return df.withColumns({"unique_entity_key": entity, "producer_timestamp": produced, "kafka_value_is_null": payload.isNull()})


def select_kafka_columns_and(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*KAFKA_COLUMNS, *columns)


def compact(df: DataFrame, entity: str = "unique_entity_key", produced: str = "producer_timestamp", removed: str = "kafka_value_is_null", drop: bool = True) -> DataFrame:
    """The latest state per entity: newest rows win (ties stay), a newest row without a payload deletes. One scan and one exchange.

    The rank is pre-filtered by the engine's window group limit, so an entity with very many versions costs a
    row a task, not all of its rows.
    """
    newest = Window.partitionBy(entity).orderBy(F.desc(produced))
    latest = df.where(F.col(entity).isNotNull() & F.col(produced).isNotNull()).withColumn("_rank", F.rank().over(newest)).where("_rank = 1").where(~F.col(removed)).drop("_rank")
    return latest.drop(*[c for c in KAFKA_COLUMNS if c in df.columns]) if drop else latest


def upsert_batch(spark: SparkSession, path: str, entity: str = "unique_entity_key", produced: str = "producer_timestamp", keep: int = 2):
    """A ``foreachBatch`` function that keeps a compacted table (with tombstones) whole in ``path/batch``, and the last ``keep`` of them.

    A batch whose predecessor isn't there is an error: what it holds would replace the history. For tables that are
    large beside a batch use ``compacted.CompactedLog``.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        merged = batch
        fs, before = _hadoop(spark, f"{path}/{batch_id - 1}")
        if batch_id:
            if not fs.exists(_hadoop(spark, f"{path}/{batch_id - 1}/_SUCCESS")[1]):
                raise HistoryMissing(f"{path} has no version {batch_id - 1}")
            merged = spark.read.parquet(f"{path}/{batch_id - 1}").unionByName(batch, allowMissingColumns=True)
        newest_rows(merged, entity, produced).write.mode("overwrite").parquet(f"{path}/{batch_id}")
        for old in fs.listStatus(before.getParent()):
            name = old.getPath().getName()
            if name.isdigit() and int(name) <= batch_id - keep:
                fs.delete(old.getPath(), True)

    return apply


def _hadoop(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


# configuration --


@dataclass(frozen=True)
class TopicName:
    name: str
    output: str | None = None

    @property
    def sink(self) -> str:
        return self.output or f"{self.name}.output"


@dataclass(frozen=True)
class SinkSettings:
    """Where a topic's rows go and how they are read back."""

    root: str
    trigger_ms: int | None = None
    refresh_seconds: float = 5.0
    partitions: int | None = None
    transformation: Transform | None = None
    post_process: Transform | None = None
    cache: bool = True
    #: Event-sourced topics are kept as a base and the batches since; so many batches make a new base. None: every row ever is kept.
    compact_every: int | None = 20

    def path(self, topic: str) -> str:
        return f"{self.root}/{topic}.parquet"

    def checkpoint(self, topic: str) -> str:
        return f"{self.root}/{topic}_Checkpoint.parquet"


@dataclass(frozen=True)
class TopicSettings:
    topic: TopicName
    transport: Transport
    sink: SinkSettings
    registry: SchemaRegistry | None = None
    schemas: dict[str, T.StructType] | None = None
    entity_key: Callable[[DataFrame], tuple[Column, Column]] | None = None
    payload: str = "value"


@dataclass(frozen=True)
class TableSettings:
    """One table of a collection of topics."""

    name: str
    topic: str
    transformation: Transform | None = None
    post_process: Transform | None = None
    entity_key: Callable[[DataFrame], tuple[Column, Column]] | None = None
    schemas: dict[str, T.StructType] | None = None


class TopicNotAvailable(RuntimeError):
    pass


# fresh tables --


class FreshTable:
    """A frame that is read again when it is older than ``refresh_seconds``. Safe to share between threads; the previous frame is released."""

    def __init__(self, load: Callable[[], DataFrame], refresh_seconds: float = 5.0, cache: bool = True, tries: int = 30, pause: float = 1.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep, heal: Callable[[], None] | None = None):
        self._load, self.refresh_seconds, self._cache, self._tries, self._pause = load, refresh_seconds, cache, tries, pause
        self._clock, self._sleep, self._heal = clock, sleep, heal
        self._lock = threading.RLock()
        self._frame: DataFrame | None = None
        self._at = float("-inf")

    @property
    def data(self) -> DataFrame:
        with self._lock:
            if self._frame is None or self._clock() - self._at >= self.refresh_seconds:
                self._refresh()
            return self._frame

    @property
    def fresh_data(self) -> DataFrame:
        with self._lock:
            self._at = float("-inf")
            return self.data

    def _refresh(self) -> None:
        if self._heal:
            self._heal()
        error: Exception | None = None
        for attempt in range(self._tries):
            try:
                fresh = self._load()
                if self._cache:
                    fresh = fresh.persist()
                old, self._frame, self._at = self._frame, fresh, self._clock()
                if old is not None and self._cache:
                    old.unpersist()
                return
            except (AnalysisException, LookupError) as e:
                error = e
                if attempt + 1 < self._tries:
                    self._sleep(self._pause)
        raise TopicNotAvailable(str(error))

    def release(self) -> None:
        with self._lock:
            if self._frame is not None and self._cache:
                self._frame.unpersist()
            self._frame, self._at = None, float("-inf")


class _TopicTable:
    """Lifecycle that both sinks share: start, stop, delete, reset, status, data."""

    def __init__(self, spark: SparkSession, settings: TopicSettings, read_only: bool = False):
        self.spark, self.settings, self.read_only = spark, settings, read_only
        self.query = None
        sink = settings.sink
        self.table = FreshTable(self._read_back, sink.refresh_seconds, sink.cache, heal=self._revive)

    def source(self) -> DataFrame:
        """The topic, decoded, with its value's fields as columns, event-sourcing columns where there is a key function, and the user's transformation."""
        s = self.settings
        df = deserialize(s.transport.stream(self.spark, s.topic.name), s.topic.name, s.registry, schemas=s.schemas, work_dir=f"{s.sink.root}/{s.topic.name}_Sample")
        payload = F.col(s.payload)
        if s.entity_key:
            df = with_event_columns(df, *s.entity_key(df), payload)
        if isinstance(df.schema["value"].dataType, T.StructType):
            rest = [c for c in df.columns if c not in ("value", "topic")]
            names = {f.name for f in df.schema["value"].dataType.fields}
            df = df.select(*[F.col(c) for c in rest if c not in names], "value.*")
        return s.sink.transformation(df) if s.sink.transformation else df

    def _trigger(self, writer):
        ms = self.settings.sink.trigger_ms
        return writer.trigger(availableNow=True) if ms is None else writer.trigger(processingTime=f"{ms} milliseconds")

    def start(self) -> None:
        if not self.read_only and (self.query is None or not self.query.isActive):
            self.query = self._trigger(self._writer(self.source())).outputMode("append").queryName(None or f"{self.settings.topic.name}-{id(self)}").start()

    def process_available(self) -> None:
        """Runs what is there to its end: for triggers that end by themselves, and for tests."""
        self.start()
        if self.query is not None:
            if self.settings.sink.trigger_ms is None:
                self.query.awaitTermination()
            else:
                self.query.processAllAvailable()

    def stop(self) -> None:
        if self.query is not None and self.query.isActive:
            self.query.stop()
        self.query = None

    def delete(self) -> None:
        """Stops and removes what was written, its checkpoint too."""
        if self.read_only:
            return
        self.stop()
        self.table.release()
        for path in self._paths():
            target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def reset(self) -> None:
        if not self.read_only:
            self.delete()
            self.start()

    def _revive(self) -> None:
        """A query that died of an error begins anew; one that ended well has nothing to be healed."""
        if not self.read_only and self.query is not None and not self.query.isActive and self.query.exception() is not None:
            self.reset()

    def status(self) -> str:
        try:
            return str(self.data.count())
        except (AnalysisException, TopicNotAvailable):
            return "fail"

    @property
    def data(self) -> DataFrame:
        return self.table.data

    @property
    def fresh_data(self) -> DataFrame:
        return self.table.fresh_data

    @property
    def schema(self) -> T.StructType:
        return self.data.schema

    def _finish(self, df: DataFrame) -> DataFrame:
        sink = self.settings.sink
        df = df.repartition(sink.partitions) if sink.partitions else df
        if self.settings.entity_key:
            df = compact(df)
        return sink.post_process(df) if sink.post_process else df


class ParquetTopicTable(_TopicTable):
    """Topic to Parquet files, read back as a table."""

    def _log(self) -> CompactedLog | None:
        s = self.settings
        return CompactedLog(self.spark, s.sink.path(s.topic.name), every=s.sink.compact_every) if s.entity_key and s.sink.compact_every else None

    def _writer(self, df: DataFrame):
        s, log = self.settings, self._log()
        writer = df.writeStream.option("checkpointLocation", s.sink.checkpoint(s.topic.name))
        return writer.foreachBatch(log.apply) if log else writer.format("parquet").option("path", s.sink.path(s.topic.name))

    def _paths(self) -> list[str]:
        s = self.settings
        return [s.sink.path(s.topic.name), s.sink.checkpoint(s.topic.name)]

    def _read_back(self) -> DataFrame:
        log = self._log()
        df = log.read() if log else self.spark.read.parquet(self.settings.sink.path(self.settings.topic.name))
        if df.isEmpty():
            raise LookupError(f"{self.settings.topic.name} is empty so far")
        return self._finish(df)


class TopicToTopicTable(_TopicTable):
    """Topic to another topic, which is read back in batch."""

    def _writer(self, df: DataFrame):
        s = self.settings
        out = serialize(df, s.topic.sink, s.registry)
        return s.transport.write_stream(out, s.topic.sink, s.sink.checkpoint(s.topic.sink))

    def _paths(self) -> list[str]:
        s = self.settings
        return [s.sink.checkpoint(s.topic.sink)]

    def _read_back(self) -> DataFrame:
        s = self.settings
        df = deserialize(s.transport.batch(self.spark, s.topic.sink), s.topic.sink, s.registry, key=None).select("value.*")
        if df.isEmpty():
            raise LookupError(f"{s.topic.sink} is empty so far")
        return self._finish(df)


class TopicTables:
    """Tables by name; lifecycle calls go to all of them in parallel."""

    def __init__(self, tables: dict[str, _TopicTable]):
        self.tables = tables

    @classmethod
    def of(cls, spark: SparkSession, transport: Transport, root: str, tables: list[TableSettings], refresh_seconds: float = 5.0, trigger_ms: int | None = None, registry: SchemaRegistry | None = None, partitions: int | None = None) -> TopicTables:
        made = {}
        for t in tables:
            sink = SinkSettings(root, trigger_ms, refresh_seconds, partitions, t.transformation, t.post_process)
            made[t.name] = ParquetTopicTable(spark, TopicSettings(TopicName(t.topic), transport, sink, registry, t.schemas, t.entity_key))
        return cls(made)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name].data

    def _each(self, call: Callable[[_TopicTable], object]) -> dict[str, object]:
        with ThreadPoolExecutor(max(1, min(8, len(self.tables)))) as pool:
            return dict(zip(self.tables, pool.map(call, self.tables.values()), strict=True))

    def start(self) -> None:
        self._each(lambda t: t.start())

    def process_available(self) -> None:
        self._each(lambda t: t.process_available())

    def stop(self) -> None:
        self._each(lambda t: t.stop())

    def reset(self) -> None:
        self._each(lambda t: t.reset())

    def delete(self) -> None:
        self._each(lambda t: t.delete())

    def status(self, name: str = "tables") -> dict[str, str]:
        return {f"{name}.{k}": v for k, v in self._each(lambda t: t.status()).items()}

    def names(self) -> list[str]:
        return sorted(self.tables)
