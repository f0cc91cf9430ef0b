"""Score columns: aggregation, weights, boosts, distances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.config import materialized
from textloom.functions.vectors import ROW_AGGREGATES, boosted, linear_weighted, similarity


def aggregate_columns(df: DataFrame, inputs: list[str], output: str, how: str = "max") -> DataFrame:
    if output in df.columns:
        raise ValueError(f"column {output!r} exists")
    return df.withColumn(output, ROW_AGGREGATES[how]([F.col(c) for c in inputs]))


def weigh_columns(df: DataFrame, inputs: list[str], weights: str, output: str) -> DataFrame:
    """``weights`` is a struct of a divisor ``_1`` and an array ``_2``."""
    return df.withColumn(output, linear_weighted([F.col(c) for c in inputs], F.col(weights)["_1"], F.col(weights)["_2"]))


def score_documents(df: DataFrame, vector: str, language: str, query_vector: list[float], query_language: str, boosts: dict[str, float], output: str) -> DataFrame:
    """Inner product with one constant query, boosted across languages."""
    query = F.array(*[F.lit(float(x)).cast("float") for x in query_vector])
    return df.withColumn(output, boosted(similarity(F.col(vector), query), F.lit(query_language), F.col(language), boosts))


#: Rows of a tile as a power of two, and its queries: so many meet at once. Queries that one task reads, about. Queries for
#: which rows have one part more, so that a task's pairs grow as the rows only.
TILE_BITS, TILE_QUERIES, TASK_QUERIES, PART_QUERIES = 8, 1024, 1 << 16, 32


def _matrix(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of any lengths in double precision, zeros after their ends; where elements are; where vectors are."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0), np.int64)
    there = np.arange(sizes.max(initial=0)) < sizes[:, None]
    elements = vectors.flatten()
    values, known = np.zeros(there.shape), there.copy()
    values[there] = np.asarray(pc.fill_null(elements.cast(pa.float64(), safe=False), 0.0))
    known[there] = np.asarray(pc.is_valid(elements))
    return values, known, np.asarray(pc.is_valid(vectors))


def _in_order(a: np.ndarray, b: np.ndarray, a_known: np.ndarray, b_known: np.ndarray) -> np.ndarray:
    """Sums of products over the first axis, in its order, of what ``a`` and ``b`` broadcast to."""
    total = np.zeros(np.broadcast_shapes(a.shape[1:], b.shape[1:]))
    product = np.empty_like(total)
    for x, y, p, q in zip(a, b, a_known, b_known, strict=True):
        np.multiply(x, y, out=product)
        if not (p.all() and q.all()):  # what meets a null counts as zero, even where it is infinite
            product[~(p & q)] = 0.0
        total += product
    return total


def _lengths(values: np.ndarray) -> np.ndarray:
    """Euclidean lengths, a little too large rather than too small; infinite where squares can't tell."""
    squares = np.einsum("ik,ik->i", values, values)
    return np.where(squares < 1e300, np.where(values.any(axis=1), np.sqrt(squares) + 1e-150, 0.0), np.inf)


def tile_scores(rows: pa.Array, queries: pa.Array) -> pa.Array:
    """``similarity`` of every row with every query, row by row, and not a digit differs.

    A matrix product sums in an order of its own. Sums of n products in two orders differ by no more than n times the
    machine's precision times both lengths, so where that can't change the rounded float, it is the one; elsewhere, about
    six pairs in 100,000 of the bundled vectors, products are summed in the vectors' order.
    """
    (a, a_known, a_there), (b, b_known, b_there) = _matrix(rows), _matrix(queries)
    width = min(a.shape[1], b.shape[1])
    a, b, a_known, b_known = (np.ascontiguousarray(x[:, :width]) for x in (a, b, a_known, b_known))
    scores, doubt = np.empty((len(a), len(b)), np.float32), np.empty((len(a), len(b)), bool)
    with np.errstate(all="ignore"):
        own, other = _lengths(a), _lengths(b)
        near = a @ b.T
        near += 0.0  # no negative zeros
        step = 2 * (width + 2) * np.finfo(float).eps * other  # twice the bound, for the roundings here
        for i in range(0, len(a), 32):  # few rows at once stay in the processor's cache
            part = near[i : i + 32]
            apart = own[i : i + 32, None] * step
            low, scores[i : i + 32] = (part - apart).astype(np.float32), part + apart
            np.not_equal(low.view(np.int32), scores[i : i + 32].view(np.int32), out=doubt[i : i + 32])
        doubt[np.isinf(own)] = True
        doubt[:, np.isinf(other)] = True
        many = np.flatnonzero(doubt.sum(axis=1) > len(b) // 8)
        doubt[many] = False
        columns = [np.ascontiguousarray(x.T) for x in (a, b, a_known, b_known)]
        for i in range(0, len(many), 32):
            k = many[i : i + 32]
            scores[k] = _in_order(columns[0][:, k, None], columns[1][:, None, :], columns[2][:, k, None], columns[3][:, None, :])
        i, j = np.nonzero(doubt)
        if len(i):
            scores[i, j] = _in_order(columns[0][:, i], columns[1][:, j], columns[2][:, i], columns[3][:, j])
    if a_there.all() and b_there.all():
        return pa.array(scores.ravel())
    return pa.array(scores.ravel(), mask=~(a_there[:, None] & b_there).ravel())


@F.arrow_udf(T.ArrayType(T.FloatType()))
def _tile_scores(tiles: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for rows, queries in tiles:
        for i in range(len(rows)):  # a tile at a time, however many came at once
            scores = tile_scores(rows[i].values, queries[i].values)
            yield pa.ListArray.from_arrays(pa.array([0, len(scores)], pa.int32()), scores)


def _packed(df: DataFrame, vector: str, key: Column, tasks: int, name: str) -> DataFrame:
    """Rows of equal key as an array ``name`` of structs with fields by position, and their vectors."""
    position = df.columns.index(vector)
    kept = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    grouped = kept.select(F.struct("*").alias(name), key.alias("key")).repartition(tasks, "key").groupBy("key").agg(F.collect_list(name).alias(name))
    vectors = F.col(f"{name}.c{position}")
    exact = isinstance(kept.schema[position].dataType.elementType, T.FloatType | T.DoubleType)
    return grouped.select(name, (vectors if exact else vectors.cast("array<array<double>>")).alias(f"{name}_vectors"))


def score_pairs(df: DataFrame, queries: DataFrame, vector: str, query_vector: str, output: str, max_queries: int = 10_000, spread: int = 64) -> DataFrame:
    """Every row against every query of a stated set: the queries are counted and, up to ``max_queries``, shared.

    Beyond that nothing is shared. Rows are packed by the hundred in ``spread`` parts or, for many queries, more, each of which meets the packed
    queries, so many of them a task; a tile of both is scored at once and taken apart again by position. A row is
    shuffled once and never copied. The result has rows times queries rows either way; to find the nearest few only,
    search an index.
    """
    for frame, column in ((df, vector), (queries, query_vector)):
        if frame.schema[column].dataType.typeName() != "array":
            raise ValueError(f"column {column!r} holds no vectors")
    n = queries.count()
    if n <= max_queries:
        return df.crossJoin(F.broadcast(queries)).withColumn(output, similarity(F.col(vector), F.col(query_vector)))
    left = _packed(df, vector, F.shiftright(F.monotonically_increasing_id(), TILE_BITS), max(spread, -(-n // PART_QUERIES)), "rows")
    right = _packed(materialized(queries, "queries"), query_vector, F.floor(F.rand(7) * -(-n // TILE_QUERIES)), -(-n // TASK_QUERIES), "queries")
    tiles = left.join(right.hint("shuffle_replicate_nl")).withColumn("scores", _tile_scores("rows_vectors", "queries_vectors"))
    at = tiles.select("rows", "queries", F.posexplode_outer("scores").alias("at", "score"))  # never empty; without "outer", a filter for that has the scores computed twice
    row, query = F.get("rows", F.expr("at div size(queries)")), F.get("queries", F.expr("at % size(queries)"))
    names = [*df.columns, *queries.columns]
    columns = [of[f"c{i}"] for of, frame in ((row, df), (query, queries)) for i in range(len(frame.columns))]
    made = [(F.col("score") if c.lower() == output.lower() else x).alias(c) for c, x in zip(names, columns, strict=True)]
    return at.select(*made, *[F.col("score").alias(output)] * (output.lower() not in map(str.lower, names)))
