"""Settings with environment overrides."""

from __future__ import annotations

import os
import re
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: Romance, Germanic, Slavic and the others, as ISO 639-1 codes.
SUPPORTED_LANGUAGES = tuple(sorted("es fr it pt ro ca".split() + "en de nl da sv no".split() + "pl cs sk sl hr ru uk bg mk".split() + "ar he el hu fi et id tr vi".split()))
DEFAULT_LANGUAGE = "en"
DEFAULT_BOOSTS = {"en": 1.1, "de": 1.05}


def string_to_map(text: str | None, kind: type = str) -> dict[str, object]:
    """``"k,v;k,v"`` to a dictionary; pairs that are malformed or don't convert are left out."""
    found: dict[str, object] = {}
    for pair in (text or "").split(";"):
        parts = [p.strip() for p in pair.split(",")]
        if len(parts) != 2 or not parts[0]:
            continue
        try:
            found[parts[0]] = kind(parts[1])
        except ValueError:
            continue
    return found


def supported_languages() -> tuple[str, ...]:
    own = os.environ.get("SUPPORTED_LANGUAGES")
    return tuple(x.strip() for x in own.split(",") if x.strip()) if own else SUPPORTED_LANGUAGES


def default_boosts() -> dict[str, float]:
    own = os.environ.get("DEFAULT_OTHER_LANGUAGE_BOOSTS")
    return string_to_map(own, float) if own else dict(DEFAULT_BOOSTS)  # type: ignore[return-value]


@dataclass(frozen=True)
class SessionSettings:
    """What a session is built from; ``TESTING`` in the environment means a local one."""

    name: str = "textloom"
    master: str | None = None
    conf: dict[str, str] = field(default_factory=dict)
    cassandra_host: str | None = None
    elasticsearch_nodes: str | None = None

    def options(self) -> dict[str, str]:
        found = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
        if self.cassandra_host:
            found["spark.cassandra.connection.host"] = self.cassandra_host
        if self.elasticsearch_nodes:
            found |= {"es.nodes": self.elasticsearch_nodes, "es.index.auto.create": "true"}
        return found | self.conf


@contextmanager
def timed(label: str, report: Callable[[str], object] = print) -> Iterator[None]:
    """Reports how long a block took."""
    began = time.perf_counter()
    try:
        yield
    finally:
        report(f"{label}: {time.perf_counter() - began:.3f} s")


def is_testing() -> bool:
    return os.environ.get("TESTING", "").lower() in ("1", "true", "yes")


def is_debugging() -> bool:
    return os.environ.get("DEBUGGING", "").lower() in ("1", "true", "yes")


def build_session(settings: SessionSettings | None = None) -> SparkSession:
    settings = settings or SessionSettings()
    builder = SparkSession.builder.appName(settings.name).config(map=settings.options())
    master = "local[*]" if is_testing() else settings.master
    return (builder.master(master) if master else builder).getOrCreate()


_SCRATCH: dict[str, str] = {}
_MADE: dict[str, list[str]] = {}


def delete_scratch(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def scratch_root(spark: SparkSession) -> str:
    """A folder of this application in the one that executors share (``spark.checkpoint.dir``).

    Where that is unset, a local session gets a private folder and any other is an error, since executors on other
    machines couldn't read what one of them wrote. The folder goes when the session's JVM ends.
    """
    import tempfile

    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _SCRATCH[app] = f"{root.rstrip('/')}/textloom-{app}" if root else "file://" + tempfile.mkdtemp(prefix="textloom-")
        target = spark._jvm.org.apache.hadoop.fs.Path(_SCRATCH[app])
        fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(target)
        fs.deleteOnExit(target)
    return _SCRATCH[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    import uuid

    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession, keep: tuple[str, ...] = ()) -> Iterator[None]:
    """Removes at its end what was written to the scratch folder within, but for ``keep``: to put around an action that writes a result elsewhere."""
    made = _MADE.setdefault(spark.sparkContext.applicationId, [])
    before = len(made)
    try:
        yield
    finally:
        within = made[before:]
        made[before:] = [p for p in within if p in keep]
        for path in within:
            if path not in keep:
                delete_scratch(spark, path)


def materialized(df: DataFrame, label: str) -> DataFrame:
    """Written once to the scratch folder and read back: used more than once, computed once, and safe from lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows times bytes a row, in memory, up to which a table may go to every executor.
BROADCAST_BYTES = 64 << 20


def join_side(table: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A written table as the small side of a join: broadcast where its counted rows are known to fit, shuffled otherwise."""
    return table.hint("broadcast") if table.count() * row_bytes <= limit else table.hint("shuffle_hash")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores before it until no column of ``df`` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted
