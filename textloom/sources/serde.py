"""Keys and values of a topic to columns and back: Avro where the registry knows the subject, else JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.operators.frames import infer_json_schema
from textloom.sources.avro import from_confluent_avro, to_confluent_avro
from textloom.sources.registry import SchemaRegistry


def sample_json_schema(stream: DataFrame, column: str, work_dir: str) -> T.StructType:
    """Schema of what a stream holds now, by one run over what is available."""
    spark = stream.sparkSession
    query = stream.select(F.col(column).cast("string").alias("json")).writeStream.format("parquet").option("path", f"{work_dir}/sample").option("checkpointLocation", f"{work_dir}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return infer_json_schema(spark.read.schema("json string").parquet(f"{work_dir}/sample"), "json")


def deserialize_json(df: DataFrame, column: str, schema: T.StructType | None = None, work_dir: str | None = None) -> DataFrame:
    """Parses a JSON column in place; without a schema it is inferred, for a stream from a sample kept under ``work_dir``."""
    text = df.withColumn(column, F.col(column).cast("string"))
    if schema is None:
        if df.isStreaming:
            if not work_dir:
                raise ValueError("a stream needs a schema, or a directory for its sample")
            schema = sample_json_schema(df, column, work_dir)
        else:
            schema = infer_json_schema(text, column)
    return text.withColumn(column, F.from_json(column, schema))


def deserialize(df: DataFrame, topic: str, registry: SchemaRegistry | None = None, key: str | None = "key", value: str | None = "value", schemas: dict[str, T.StructType] | None = None, work_dir: str | None = None) -> DataFrame:
    """Key and value by the subjects ``topic-key`` and ``topic-value``; a key that is no Avro stays a string."""
    for column, part in ((key, "key"), (value, "value")):
        if not column:
            continue
        subject = f"{topic}-{part}"
        if registry is not None and registry.has(subject):
            df = df.withColumn(column, from_confluent_avro(F.col(column), registry, subject))
        elif part == "key" and not (schemas and "key" in schemas):
            df = df.withColumn(column, F.col(column).cast("string"))
        else:
            df = deserialize_json(df, column, (schemas or {}).get(part), f"{work_dir}/{part}" if work_dir else None)
    return df


def serialize(df: DataFrame, topic: str, registry: SchemaRegistry | None = None, key_columns: list[str] | None = None, value_columns: list[str] | None = None, key: str = "key", value: str = "value") -> DataFrame:
    """``value`` (and ``key``) of the given columns, by default all but the key's."""
    own_key = [c for c in key_columns or [] if c in df.columns]
    own_value = value_columns or [c for c in df.columns if c not in own_key and c != key]
    if registry is None:
        made = [F.to_json(F.struct(*own_value)).alias(value)]
        return df.select(*([F.to_json(F.struct(*own_key)).alias(key)] if own_key else []), *made)
    both = df.select(F.struct(*own_key).alias("_k"), F.struct(*own_value).alias("_v")) if own_key else df.select(F.struct(*own_value).alias("_v"))
    out = to_confluent_avro(both.select(*(["_k"] if own_key else []), "_v.*"), registry, f"{topic}-value", value, own_value)
    return to_confluent_avro(out.select(value, "_k.*"), registry, f"{topic}-key", key, own_key) if own_key else out
