"""Stateful queries over event time: windowed aggregates, joins of streams, latest values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed_lists(events: DataFrame, time: str, key: str, value: str, watermark: str, width: str, slide: str | None = None, output: str = "values") -> DataFrame:
    """Per key and (sliding) window the values in it, once the watermark has passed."""
    span = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, watermark).groupBy(span, key).agg(F.collect_list(value).alias(output))


def windowed_aggregate(events: DataFrame, time: str, keys: list[str], watermark: str, width: str, slide: str | None = None, **aggregates: Column) -> DataFrame:
    span = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, watermark).groupBy(span, *keys).agg(*[c.alias(n) for n, c in aggregates.items()])


def session_aggregate(events: DataFrame, time: str, keys: list[str], watermark: str, gap: str, **aggregates: Column) -> DataFrame:
    return events.withWatermark(time, watermark).groupBy(F.session_window(time, gap), *keys).agg(*[c.alias(n) for n, c in aggregates.items()])


def by_event_time(events: DataFrame, time: str, key: str, value: str, watermark: str, output: str = "values") -> DataFrame:
    """Groups of the very same time: lists that append mode can give out."""
    return events.withWatermark(time, watermark).groupBy(time, key).agg(F.collect_list(value).alias(output))


def interval_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, within: str, left_watermark: str, right_watermark: str) -> DataFrame:
    """Pairs of equal key whose times lie at most ``within`` apart; state is bounded by the watermarks on both sides."""
    a = left.withWatermark(left_time, left_watermark).alias("a")
    b = right.withWatermark(right_time, right_watermark).alias("b")
    near = F.expr(f"b.{right_time} between a.{left_time} - interval {within} and a.{left_time} + interval {within}")
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & near)


def window_join(aggregated: DataFrame, events: DataFrame, key: str, time: str, watermark: str) -> DataFrame:
    """Windowed aggregates with the events of the same key inside their window."""
    b = events.withWatermark(time, watermark).alias("b")
    a = aggregated.alias("a")
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col(f"b.{time}") >= F.col("a.window.start")) & (F.col(f"b.{time}") < F.col("a.window.end")))


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a streaming frame over what is available into Parquet, and reads it back."""
    query = df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)
