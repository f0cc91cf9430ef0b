"""Relaxed word mover's distance between bags of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.config import free_name, materialized
from textloom.functions.vectors import DISTANCES
from textloom.operators.embeddings import FREQUENT_BYTES, _places, frequent, loaded

FLOAT_MAX = float(np.finfo(np.float32).max)


def _matrix(a: np.ndarray, b: np.ndarray, kind: str) -> np.ndarray:
    ab = a @ b.T
    aa, bb = (a * a).sum(axis=1)[:, None], (b * b).sum(axis=1)[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        return {
            "euclidean": lambda: np.sqrt(np.maximum(0, aa + bb - 2 * ab)),
            "euclidean_normalized": lambda: np.sqrt(np.maximum(0, 2 - 2 * ab)),
            "cosine": lambda: 1 - ab / np.sqrt(aa * bb),
            "cosine_normalized": lambda: 1 - ab,
            "tanimoto": lambda: 1 - ab / (aa + bb - ab),
            "tanimoto_normalized": lambda: 1 - ab / (2 - ab),
        }[kind]()


def relaxed_distance(one: list[tuple[str, int]], other: list[tuple[str, int]], vector_one, vector_other, kind: str = "euclidean_normalized") -> float:
    """The larger of the two one-sided sums of share times least distance; words without a vector count in the length but can't be compared."""

    def known(bag, vector):
        found = [(n, v) for w, n in bag if (v := vector(w)) is not None]
        return np.array([n for n, _ in found], float), np.array([v for _, v in found], float), sum(n for _, n in bag)

    (n_a, a, len_a), (n_b, b, len_b) = known(one, vector_one), known(other, vector_other)
    return _relaxed(n_a, a, len_a, n_b, b, len_b, kind)


def _relaxed(n_a: np.ndarray, a: np.ndarray, len_a: int, n_b: np.ndarray, b: np.ndarray, len_b: int, kind: str) -> float:
    if not len(n_a) or not len(n_b):
        return FLOAT_MAX
    d = _matrix(a, b, kind)
    return float(np.float32(max((n_a * d.min(axis=1)).sum() / len_a, (n_b * d.min(axis=0)).sum() / len_b)))


#: Vectors of the words that occur may be sent to every worker up to this many bytes; beyond, those of rare words are joined.
BROADCAST_BYTES = 256 << 20
#: Words whose vectors are laid out at a time.
_ENTRIES = 1 << 16


def with_distance(df: DataFrame, table: DataFrame, base: str, base_language: str, varying: str, varying_language: str, output: str, kind: str = "euclidean_normalized", max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Adds the distance of two bag columns. Only words that occur are taken from the dictionary (lang, word, vector); their vectors are shared or joined by their size."""
    words = materialized(table.join(_used(df, base, base_language, varying, varying_language).distinct(), ["lang", "word"], "left_semi").select("lang", "word", F.col("vector").cast("array<float>").alias("vector")), "words")
    numbers, dim = words.agg(F.coalesce(F.sum(F.size("vector").cast("long")), F.lit(0)), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    if 4 * numbers > max_bytes:
        return with_distance_by_join(df, words, base, base_language, varying, varying_language, output, kind, min(max_bytes, FREQUENT_BYTES) // (4 * dim))
    shared = df.sparkSession.sparkContext.broadcast(loaded(words, dim))

    @F.arrow_udf(T.FloatType())
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for la, a, lb, b in batches:
            yield _distances(la, a, None, lb, b, None, shared.value, kind)

    return df.withColumn(output, run(F.col(base_language), F.col(base), F.col(varying_language), F.col(varying)))


def _used(df: DataFrame, base: str, base_language: str, varying: str, varying_language: str) -> DataFrame:
    """(lang, word) of both bags of every row."""
    one = lambda language, bag: df.select(F.col(language).alias("lang"), F.explode(F.col(bag)["_1"]).alias("word"))
    return one(base_language, base).unionByName(one(varying_language, varying))


def with_distance_by_join(df: DataFrame, table: DataFrame, base: str, base_language: str, varying: str, varying_language: str, output: str, kind: str = "euclidean_normalized", shared_words: int | None = None) -> DataFrame:
    """The same for a dictionary of any size: the vectors of the ``shared_words`` most frequent words are sent to the workers; only a row's rarer words meet theirs in a join and come together again by row."""
    dim = table.agg(F.coalesce(F.max(F.size("vector")), F.lit(1))).first()[0]
    most = FREQUENT_BYTES // (4 * dim) if shared_words is None else shared_words
    shared = df.sparkSession.sparkContext.broadcast(loaded(frequent(table, _used(df, base, base_language, varying, varying_language), most), dim))

    @F.arrow_udf(_RARE)
    def rare(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for codes, bags in batches:
            flat, _ = _words(bags)
            at, owner, words = _places(codes, _lists(bags, flat), shared.value[0])
            off = np.flatnonzero(at < 0)
            cuts = np.searchsorted(owner[off], np.arange(len(bags) + 1)).astype(np.int32)
            begins = np.searchsorted(owner, np.arange(len(bags)))
            found = pa.StructArray.from_arrays([pa.array(off - begins[owner[off]], pa.int32()), words.take(pa.array(off))], ["at", "word"])
            yield pa.ListArray.from_arrays(pa.array(cuts), found)

    @F.arrow_udf(T.FloatType())
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for la, a, more_a, lb, b, more_b in batches:
            yield _distances(la, a, more_a, lb, b, more_b, shared.value, kind)

    row, left, right, sides = (free_name(df, n) for n in ("row", "left", "right", "sides"))
    keyed = df.withColumn(row, F.monotonically_increasing_id()).withColumns({left: rare(F.col(base_language), F.col(base)), right: rare(F.col(varying_language), F.col(varying))})
    keyed = materialized(keyed, "rows")
    there = F.col(base).isNotNull() & F.col(varying).isNotNull()

    def words(side: int, off: str, language: str) -> DataFrame:
        own = keyed.where(there).select(F.col(row).alias("row"), F.lit(side).alias("side"), F.col(language).alias("lang"), F.explode(off).alias("x"))
        return own.select("row", "side", "lang", F.col("x.word").alias("word"), F.col("x.at").alias("at"))

    met = words(0, left, base_language).unionByName(words(1, right, varying_language)).join(table.select("lang", "word", F.col("vector").cast("array<float>").alias("vector")), ["lang", "word"])
    own = [F.collect_list(F.when(F.col("side") == k, F.struct("at", "vector"))).alias(f"side{k}") for k in (0, 1)]
    gathered = met.groupBy("row").agg(*own).select(F.col("row").alias(row), F.struct("side0", "side1").alias(sides))
    joined = keyed.join(gathered, row, "left")
    found = run(F.col(base_language), F.col(base), F.col(sides)["side0"], F.col(varying_language), F.col(varying), F.col(sides)["side1"])
    return joined.select(*[F.col(f"`{c}`") for c in df.columns if c != output], found.alias(output))


_RARE = T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("word", T.StringType())]))


def _words(bags: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the bags, and their counts."""
    words, counts = bags.flatten().flatten()
    return words, np.asarray(counts, np.float64)


def _lengths(lists: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)


def _lists(bags: pa.Array, flat: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(_lengths(bags))]).astype(np.int32)), flat)


def _distances(la: pa.Array, a: pa.Array, more_a: pa.Array | None, lb: pa.Array, b: pa.Array, more_b: pa.Array | None, shared: tuple, kind: str) -> pa.Array:
    """Row by row, with the vectors of some thousand words at a time. ``more``: (place in the bag, vector) of words that aren't shared."""
    index, matrix = shared

    def side(codes: pa.Array, bags: pa.Array, more: pa.Array | None):
        words, n = _words(bags)
        at, _, _ = _places(codes, _lists(bags, words), index)
        vectors = matrix[np.maximum(at, 0)].astype(np.float64) if len(matrix) else np.zeros((len(at), matrix.shape[1]))
        known, cuts = at >= 0, np.concatenate([[0], np.cumsum(_lengths(bags))])
        if more is not None and len(flat := more.flatten()):
            place, own = flat.flatten()
            here = np.repeat(cuts[:-1], _lengths(more)) + np.asarray(place, np.int64)
            vectors[here] = np.asarray(own.flatten(), np.float64).reshape(len(here), -1)
            known[here] = True
        return n, vectors, known, cuts

    out: list[float | None] = []
    ends = np.cumsum(_lengths(a) + _lengths(b))
    nothing = np.asarray(pc.or_(pc.is_null(a), pc.is_null(b)))
    first = 0
    while first < len(a):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + _ENTRIES, "right")))
        cut = lambda x: None if x is None else x.slice(first, last - first)  # noqa: B023, E731
        (n_a, v_a, k_a, c_a), (n_b, v_b, k_b, c_b) = side(cut(la), cut(a), cut(more_a)), side(cut(lb), cut(b), cut(more_b))
        for i in range(last - first):
            if nothing[first + i]:
                out.append(None)
                continue
            x, y = slice(c_a[i], c_a[i + 1]), slice(c_b[i], c_b[i + 1])
            out.append(_relaxed(n_a[x][k_a[x]], v_a[x][k_a[x]], n_a[x].sum(), n_b[y][k_b[y]], v_b[y][k_b[y]], n_b[y].sum(), kind))
        first = last
    return pa.array(out, pa.float32())


def native_distance(one: Column, other: Column, kind: str = "euclidean_normalized") -> Column:
    """Of two arrays of structs (n, vector or null), by native expressions."""
    distance = DISTANCES[kind]

    def side(a: Column, b: Column) -> Column:
        known = F.filter(b, lambda y: y["vector"].isNotNull())
        total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x["n"])
        costs = F.transform(F.filter(a, lambda x: x["vector"].isNotNull()), lambda x: x["n"] * F.array_min(F.transform(known, lambda y: distance(x["vector"], y["vector"]))))
        return F.when((F.size(costs) > 0) & (F.size(known) > 0), F.aggregate(costs, F.lit(0.0), lambda s, c: s + c) / total)

    return F.coalesce(F.greatest(side(one, other), side(other, one)).cast("float"), F.lit(FLOAT_MAX).cast("float"))
