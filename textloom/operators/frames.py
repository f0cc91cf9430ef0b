"""DataFrame helpers: schema shapes, names, nested columns, merging."""

from __future__ import annotations

import json
from collections.abc import Iterable

import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.config import is_debugging


def _quoted(*parts: str) -> str:
    return ".".join(f"`{p.replace('`', '``')}`" for p in parts)


def flatten(df: DataFrame, prefix: tuple[str, ...] = ()) -> DataFrame:
    """Structs to their leaves, named as the leaves are; arrays and maps stay. ``prefix`` is the path of the struct to begin at."""

    def leaves(schema: T.StructType, path: tuple[str, ...]) -> list[Column]:
        found: list[Column] = []
        for f in schema.fields:
            here = (*path, f.name)
            found += leaves(f.dataType, here) if isinstance(f.dataType, T.StructType) else [F.col(_quoted(*here)).alias(f.name)]
        return found

    schema: T.DataType = df.schema
    for name in prefix:
        schema = schema[name].dataType
    return df.select(*leaves(schema, prefix))


def expand(df: DataFrame, column: str) -> DataFrame:
    """A struct column replaced, in its place, by its fields."""
    return df.select(*[F.col(f"{_quoted(c)}.*") if c == column else F.col(_quoted(c)) for c in df.columns])


def sanitize_column_names(df: DataFrame, replacement: str = "", inverse: dict[str, str] | None = None) -> DataFrame:
    """Names of letters with case and digits only; ``inverse`` gets new name -> old one."""
    names = [regex.sub(r"[^0-9\p{Lu}\p{Ll}]", replacement, c) for c in df.columns]
    if inverse is not None:
        inverse.update(zip(names, df.columns, strict=True))
    return df.toDF(*names)


def rename_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def prefix_column_names(df: DataFrame, prefix: str, exclusions: Iterable[str] = ()) -> DataFrame:
    keep = set(exclusions)
    return df.toDF(*[c if c in keep else f"{prefix}__{c}" for c in df.columns])


def original_columns(df: DataFrame) -> DataFrame:
    """Without what stages derived: names that hold two underscores."""
    return df.select(*[F.col(_quoted(c)) for c in df.columns if "__" not in c])


def with_nested_column(df: DataFrame, path: str, value: Column) -> DataFrame:
    """Sets a field by its dotted path: missing structs are made, a null struct stays null, what isn't a struct on the way is replaced."""
    top, *rest = path.split(".")
    if not rest:
        return df.withColumn(top, value)
    field = next((f for f in df.schema.fields if f.name == top), None)
    return df.withColumn(top, _nested(F.col(_quoted(top)) if field else None, field.dataType if field else None, rest, value))


def _nested(parent: Column | None, kind: T.DataType | None, path: list[str], value: Column) -> Column:
    name, *rest = path
    if parent is None or not isinstance(kind, T.StructType):
        for part in reversed(path):
            value = F.struct(value.alias(part))
        return value
    field = next((f for f in kind.fields if f.name == name), None)
    inner = value if not rest else _nested(parent.getField(name) if field else None, field.dataType if field else None, rest, value)
    fields = [inner.alias(f.name) if f.name == name else parent.getField(f.name).alias(f.name) for f in kind.fields]
    return F.when(parent.isNotNull(), F.struct(*fields, *([] if field else [inner.alias(name)])))


def merge_array_columns(df: DataFrame, output: str, inputs: list[str], drop: bool = False) -> DataFrame:
    """Arrays of one type joined in the order of ``inputs``; null where one is null."""
    kinds = {df.schema[c].dataType.simpleString() for c in inputs if c in df.columns}
    if len(kinds) != 1 or not next(iter(kinds)).startswith("array"):
        raise ValueError(f"columns {inputs} must exist and share one array type, not {sorted(kinds)}")
    merged = df.withColumn(output, F.concat(*[F.col(_quoted(c)) for c in inputs if c in df.columns]))
    return merged.drop(*[c for c in inputs if c != output]) if drop else merged


def set_nullable(df: DataFrame, nullable: bool) -> DataFrame:
    """The same rows with every column nullable or not; a null in a column that may not have any fails at run time."""
    if nullable:
        return df.to(T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in df.schema.fields]))
    # the default is never reached: it tells the engine that the column can't be null
    return df.select(*[F.coalesce(F.col(_quoted(f.name)), F.raise_error(F.lit(f"null in {f.name}")).cast(f.dataType), _some(f.dataType)).alias(f.name) for f in df.schema.fields])


def _some(kind: T.DataType) -> Column:
    """Any value of a type."""
    if isinstance(kind, T.StructType):
        return F.struct(*[_some(f.dataType).alias(f.name) for f in kind.fields]).cast(kind)
    if isinstance(kind, T.ArrayType):
        return F.array().cast(kind)
    if isinstance(kind, T.MapType):
        return F.create_map().cast(kind)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit("1970-01-01").cast(kind)
    return F.lit(False) if isinstance(kind, T.BooleanType) else F.lit("").cast(kind) if isinstance(kind, (T.StringType, T.BinaryType)) else F.lit(0).cast(kind)


def empty_like(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], df.schema)


def limit_if_nonzero(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n) if n else df


def merge_dataframes(frames: list[DataFrame]) -> DataFrame:
    """Side by side by position: rows are numbered in their present order, so the result doesn't hang on partitions that match."""

    def numbered(df: DataFrame) -> DataFrame:
        # numbers per partition and one offset for each, instead of all rows in one window
        at = df.withColumn("_g", F.monotonically_increasing_id())
        sizes = at.groupBy(F.shiftright("_g", 33).alias("_part")).agg(F.count("*").alias("_n"), F.min("_g").alias("_g0"))
        before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sizes.withColumn("_o", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_part", "_g0", "_o")
        at = at.withColumn("_part", F.shiftright("_g", 33)).join(offsets, "_part")
        return at.withColumn("_row", F.col("_g") - F.col("_g0") + F.col("_o")).drop("_g", "_g0", "_o", "_part")

    merged = numbered(frames[0])
    for other in frames[1:]:
        merged = merged.join(numbered(other), "_row")
    return merged.drop("_row")


def transform_with(df: DataFrame, pipeline) -> DataFrame:
    """Applies a pipeline of this library, a pipeline, estimator or transformer of Spark's, or a function."""
    if hasattr(pipeline, "fit"):
        return pipeline.fit(df).transform(df)
    return pipeline.transform(df) if hasattr(pipeline, "transform") else df.transform(pipeline)


def debug_show(df: DataFrame, n: int = 20) -> DataFrame:
    if is_debugging():
        df.show(n, truncate=False)
    return df


def debug_print_schema(df: DataFrame) -> DataFrame:
    if is_debugging():
        df.printSchema()
    return df


def to_json_string(df: DataFrame) -> str:
    """A JSON array of the rows, on the driver: for small results."""
    return "[" + ",".join(r[0] for r in df.select(F.to_json(F.struct("*"))).collect()) + "]"


def to_dicts(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def ids_to_strings(df: DataFrame, column: str = "id") -> DataFrame:
    return df.withColumn(column, F.col(_quoted(column)).cast("string"))


def same_type(a: T.DataType, b: T.DataType) -> bool:
    """Equal but for nullability."""
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return [f.name for f in a] == [f.name for f in b] and all(same_type(x.dataType, y.dataType) for x, y in zip(a, b, strict=True))
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return same_type(a.elementType, b.elementType)
    if isinstance(a, T.MapType) and isinstance(b, T.MapType):
        return same_type(a.keyType, b.keyType) and same_type(a.valueType, b.valueType)
    return a == b


def require_type(schema: T.StructType, column: str, kind: T.DataType) -> None:
    if column not in schema.names:
        raise ValueError(f"there is no column {column!r}")
    if not same_type(schema[column].dataType, kind):
        raise ValueError(f"column {column!r} is {schema[column].dataType.simpleString()}, not {kind.simpleString()}")


_PYTHON = {"string": "str", "binary": "bytes", "boolean": "bool", "tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "float": "float", "double": "float", "timestamp": "datetime.datetime", "date": "datetime.date"}


def schema_to_dataclass(schema: T.StructType, name: str) -> str:
    """Source text of dataclasses for a schema; what may be null is ``| None``."""
    classes: list[str] = []

    def kind(t: T.DataType, hint: str) -> str:
        if isinstance(t, T.StructType):
            return declare(t, hint)
        if isinstance(t, T.ArrayType):
            return f"list[{kind(t.elementType, hint)}{' | None' * t.containsNull}]"
        if isinstance(t, T.MapType):
            return f"dict[{kind(t.keyType, hint + 'Key')}, {kind(t.valueType, hint)}{' | None' * t.valueContainsNull}]"
        if isinstance(t, T.DecimalType):
            return "decimal.Decimal"
        return _PYTHON.get(t.simpleString(), "str")

    def declare(s: T.StructType, own: str) -> str:
        lines = [f"    {f.name}: {kind(f.dataType, own + f.name[:1].upper() + f.name[1:])}{' | None = None' * f.nullable}" for f in sorted(s.fields, key=lambda f: f.nullable)]
        classes.append("\n".join(["@dataclass", f"class {own}:", *(lines or ["    pass"])]))
        return own

    declare(schema, name)
    return "\n\n\n".join(classes) + "\n"


def infer_json_schema(df: DataFrame, column: str) -> T.StructType:
    """Schema of all the JSON texts in a column, by one aggregation on the executors."""
    row = df.select(F.schema_of_variant_agg(F.try_parse_json(F.col(_quoted(column)))).alias("s")).first()
    text = (row["s"] if row else None) or "OBJECT<>"
    return T._parse_datatype_string(_ddl(text)) if text.startswith("OBJECT<") and text != "OBJECT<>" else T.StructType([])


def _ddl(variant: str) -> str:
    return variant.replace("OBJECT<", "struct<").replace("ARRAY<", "array<").replace("VOID", "string")


def from_inferred_json(df: DataFrame, column: str, output: str | None = None) -> DataFrame:
    schema = infer_json_schema(df, column)
    return df.withColumn(output or column, F.from_json(F.col(_quoted(column)), schema))


def to_json_lines(df: DataFrame) -> list[str]:
    return [json.dumps(d, default=str) for d in to_dicts(df)]
