"""Word vectors as a table (lang, word, vector): document vectors, lookups, synonyms, analogies, caches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.config import free_name, materialized
from textloom.functions.text import or_default, word_counts
from textloom.functions.vectors import dot
from textloom.operators.text import vocabulary

#: A dictionary whose vectors take up to this many bytes may be sent whole to every worker; a larger one is joined.
BROADCAST_BYTES = 128 << 20
#: Of a larger one, the vectors of the most frequent words up to this many bytes are sent, and the rare words are joined.
FREQUENT_BYTES = 64 << 20

_REST = T.ArrayType(T.StructType([T.StructField("_1", T.StringType()), T.StructField("_2", T.IntegerType())]))


class WordVectors:
    """A dictionary table and the operators on it; vectors are taken for unit vectors where a similarity is asked for."""

    def __init__(self, table: DataFrame, supported: tuple[str, ...], default_language: str, dim: int):
        self.table, self.supported, self.default, self.dim = table, supported, default_language, dim

    # documents --

    def embed(self, df: DataFrame, language: str, words: str, output: str, max_broadcast: int = BROADCAST_BYTES) -> DataFrame:
        """Sum of the vectors of the lower-cased words, scaled to length one; zeros where no word is known, null where an input is null."""
        if self.table.count() * self.dim * 4 <= max_broadcast:
            return self.embed_with_broadcast(df, language, words, output)
        return self.embed_with_join(df, language, words, output, min(max_broadcast, FREQUENT_BYTES))

    def embed_with_broadcast(self, df: DataFrame, language: str, words: str, output: str) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(loaded(self.table, self.dim))

        @F.arrow_udf(T.ArrayType(T.FloatType()))
        def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for codes, lists in batches:
                yield _sums(codes, lists, *shared.value)

        code = F.when(F.col(language).isNotNull(), or_default(F.col(language), self.supported, self.default))
        # lower-cased by the engine, as the join below does it, so that both find the same words
        return df.withColumn(output, run(code, F.transform(words, lambda w: F.lower(w))))

    def embed_with_join(self, df: DataFrame, language: str, words: str, output: str, max_broadcast: int = FREQUENT_BYTES) -> DataFrame:
        """The same for a dictionary of any size: the vectors of the most frequent words are sent to the workers, which sum them; only a row's rare words meet theirs in a join by (language, word)."""
        code = or_default(F.col(language), self.supported, self.default)
        lowered = F.transform(words, lambda w: F.lower(w))
        there = F.col(language).isNotNull() & F.col(words).isNotNull()
        used = df.where(there).select(code.alias("lang"), F.explode(lowered).alias("word"))
        shared = df.sparkSession.sparkContext.broadcast(loaded(frequent(self.table, used, max_broadcast // (4 * self.dim)), self.dim))
        dim = self.dim

        @F.arrow_udf(T.StructType([T.StructField("total", T.ArrayType(T.DoubleType())), T.StructField("rest", _REST)]))
        def split(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for codes, lists in batches:
                index, matrix = shared.value
                at, owner, flat = _places(codes, lists, index)
                totals = _totals(at[at >= 0], owner[at >= 0], len(lists), matrix)
                rare = at < 0
                cuts = np.concatenate([[0], np.cumsum(np.bincount(owner[rare], minlength=len(lists)))]).astype(np.int32)
                rest = word_counts(pa.ListArray.from_arrays(pa.array(cuts), flat.filter(pa.array(rare))))
                yield pa.StructArray.from_arrays([_vectors(totals, pa.float64()), rest], ["total", "rest"])

        @F.arrow_udf(T.ArrayType(T.FloatType()))
        def finish(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for totals, more in batches:
                sums = np.asarray(totals.flatten(), np.float64).reshape(-1, dim).copy()
                n, vectors = more.flatten().flatten()
                owner = np.repeat(np.arange(len(more)), np.asarray(pc.fill_null(pc.list_value_length(more), 0), np.int64))
                if len(owner):
                    begins = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                    own = np.asarray(vectors.flatten(), np.float64).reshape(-1, dim) * np.asarray(n, np.float64)[:, None]
                    sums[owner[begins]] += np.add.reduceat(own, begins, axis=0)
                yield _vectors(_scaled(sums), pa.float32())

        # written with their numbers, so that these stay the same whatever is computed again
        row, parts, more = (free_name(df, n) for n in ("row", "parts", "more"))
        keyed = materialized(df.withColumn(row, F.monotonically_increasing_id()).withColumn(parts, split(F.when(there, code), F.when(there, lowered))), "rows")
        rare = keyed.where(there).select(F.col(row).alias("row"), code.alias("lang"), F.explode(F.col(parts)["rest"]).alias("x")).select("row", "lang", F.col("x._1").alias("word"), F.col("x._2").alias("n"))
        met = rare.join(self.table.select("lang", "word", F.col("vector").cast("array<float>").alias("vector")), ["lang", "word"])
        gathered = met.groupBy("row").agg(F.collect_list(F.struct("n", "vector")).alias("more")).select(F.col("row").alias(row), F.col("more").alias(more))
        joined = keyed.withColumn(parts, F.col(parts)["total"]).join(gathered, row, "left")
        vector = F.when(there, finish(F.col(parts), F.col(more)))
        return joined.select(*[F.col(f"`{c}`") for c in df.columns], vector.alias(output))

    # words --

    def _require(self, lang: str) -> None:
        if lang not in self.supported:
            raise ValueError(f"no dictionary for language {lang!r}")

    def lookup(self, words: DataFrame, lang: str = "lang", word: str = "word") -> DataFrame:
        """Adds the vector of the lower-cased word, null where it is unknown."""
        table = self.table.select(F.col("lang").alias("_lang"), F.col("word").alias("_word"), "vector")
        return words.join(table, (F.col(lang) == F.col("_lang")) & (F.lower(word) == F.col("_word")), "left").drop("_lang", "_word")

    def vector(self, lang: str, word: str) -> list[float] | None:
        self._require(lang)
        row = self.table.where((F.col("lang") == lang) & (F.col("word") == word.lower())).select("vector").first()
        return list(row["vector"]) if row else None

    def exists(self, lang: str, word: str) -> bool:
        return self.vector(lang, word) is not None

    def with_index(self) -> DataFrame:
        """The dictionary with each word's place in its language's vocabulary, from 0 in byte order."""
        return self.table.withColumn("index", F.row_number().over(Window.partitionBy("lang").orderBy("word")) - 1)

    def _top(self, lang: str, target: Column, n: int, without: list[str]) -> DataFrame:
        rows = self.table.where((F.col("lang") == lang) & ~F.col("word").isin(*without)) if without else self.table.where(F.col("lang") == lang)
        return rows.select("word", dot(F.col("vector"), target).cast("float").alias("similarity")).orderBy(F.desc("similarity"), "word").limit(n)

    def synonyms(self, lang: str, of: str | list[float], n: int) -> DataFrame:
        """(word, similarity) of the n nearest words to a word (itself left out) or a vector; one row ("", 0) for an unknown word."""
        self._require(lang)
        if isinstance(of, str):
            vector = self.vector(lang, of)
            if vector is None:
                return self.table.sparkSession.createDataFrame([("", 0.0)], "word string, similarity float")
            return self._top(lang, _literal(vector), n, [of.lower()])
        return self._top(lang, _literal(_unit(of)), n, [])

    def analogy(self, lang: str, positive: list[str], negative: list[str] = (), n: int = 10) -> DataFrame:
        """Nearest to the sum of the positive words less the negative ones, without any of them."""
        self._require(lang)
        names = [w.lower() for w in (*positive, *negative)]
        known = {r["word"]: np.array(r["vector"], np.float64) for r in self.table.where((F.col("lang") == lang) & F.col("word").isin(*names)).collect()}
        target = sum((known[w.lower()] for w in positive if w.lower() in known), np.zeros(self.dim)) - sum((known[w.lower()] for w in negative if w.lower() in known), np.zeros(self.dim))
        return self._top(lang, _literal(_unit(target)), n, names)

    # caches --

    def restricted_to(self, frames: list[tuple[DataFrame, str, str]]) -> WordVectors:
        """The dictionary less the words that the (frame, language, words) don't use: a cache to persist or store."""
        used = vocabulary(frames).withColumnRenamed("language", "lang")
        return WordVectors(self.table.join(used, ["lang", "word"], "left_semi"), self.supported, self.default, self.dim)

    def cache_sizes(self) -> DataFrame:
        return self.table.groupBy("lang").count()

    def save(self, path: str) -> None:
        self.table.write.mode("overwrite").partitionBy("lang").parquet(path)

    def status(self) -> str:
        return f"{self.table.count()} words in {self.table.select('lang').distinct().count()} languages"


def frequent(table: DataFrame, used: DataFrame, words: int) -> DataFrame:
    """Rows of the dictionary for at most ``words`` of the words that occur most often in ``used`` (lang, word; a row an occurrence)."""
    counts = materialized(used.groupBy("lang", "word").agg(F.count("*").alias("n")), "counts")
    return table.join(F.broadcast(counts.where(F.col("n") >= _least(counts, words)).select("lang", "word")), ["lang", "word"], "left_semi")


def _least(counts: DataFrame, words: int) -> int:
    """The least count that no more than ``words`` rows reach; the driver sees a row for each count that there is."""
    least, room = 1, words
    for n, many in sorted(counts.groupBy("n").count().toLocalIterator(), reverse=True):
        room -= many
        if room < 0:
            return n + 1
        least = n
    return least


def loaded(table: DataFrame, dim: int) -> tuple[dict[str, dict[str, int]], np.ndarray]:
    """Places of the words by language, and the matrix of their vectors."""
    rows = table.select("lang", "word", F.col("vector").cast("array<float>").alias("vector")).toArrow()
    langs, words = rows.column("lang").to_pylist(), rows.column("word").to_pylist()
    matrix = np.asarray(rows.column("vector").combine_chunks().flatten().to_numpy(), np.float32).reshape(len(langs), dim)
    index: dict[str, dict[str, int]] = {}
    for i, (lang, word) in enumerate(zip(langs, words, strict=True)):
        index.setdefault(lang, {})[word] = i
    return index, matrix


def _places(codes: pa.Array, lists: pa.Array, index: dict[str, dict[str, int]]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of each word of the lists its place (-1 where unknown), its list, and the words; looked up by different words, not one by one."""
    owner = np.repeat(np.arange(len(lists)), np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64))
    flat = lists.flatten()
    words = pc.dictionary_encode(flat)
    names, place = words.dictionary.to_pylist(), np.asarray(pc.fill_null(words.indices, -1), np.int64)
    kinds = pc.dictionary_encode(codes)
    kind = np.asarray(pc.fill_null(kinds.indices, -1), np.int64)[owner]
    at = np.full(len(owner), -1, np.int64)
    for k, code in enumerate(kinds.dictionary.to_pylist()):
        own = index.get(code)
        if own:
            mine = np.flatnonzero((kind == k) & (place >= 0))
            used = np.unique(place[mine])
            found = np.full(len(names), -1, np.int64)
            found[used] = [own.get(names[i], -1) for i in used.tolist()]
            at[mine] = found[place[mine]]
    return at, owner, flat


def _totals(at: np.ndarray, owner: np.ndarray, n: int, matrix: np.ndarray, entries: int = 1 << 22) -> np.ndarray:
    """Sums of the vectors at these places by their owners, of whom there are ``n``."""
    dim = matrix.shape[1]
    out = np.zeros((n, dim))
    begins = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
    step = max(1, entries // dim)
    first = 0
    while first < len(begins):  # whole lists, some millions of numbers at a time
        last = max(first + 1, int(np.searchsorted(begins, begins[first] + step, "right")) - 1)
        end = begins[last] if last < len(begins) else len(at)
        sums = np.zeros((last - first, dim))
        part, cuts = at[begins[first] : end], begins[first:last] - begins[first]
        for b in range(0, len(part), step):  # a list may be longer than that
            piece = part[b : b + step]
            inside = np.searchsorted(cuts, [b, b + len(piece) - 1], "right") - 1
            here = cuts[inside[0] : inside[1] + 1] - b
            here[0] = 0
            sums[inside[0] : inside[1] + 1] += np.add.reduceat(matrix[piece].astype(np.float64), here, axis=0)
        out[owner[begins[first:last]]] = sums
        first = last
    return out


def _scaled(sums: np.ndarray) -> np.ndarray:
    norms = np.sqrt((sums * sums).sum(axis=1))
    return (sums / np.where(norms > 0, norms, 1)[:, None]).astype(np.float32)


def _vectors(rows: np.ndarray, kind: pa.DataType, empty: np.ndarray | None = None) -> pa.Array:
    cuts = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(cuts), pa.array(rows.ravel(), kind), mask=None if empty is None else pa.array(empty))


def _sums(codes: pa.Array, lists: pa.Array, index: dict[str, dict[str, int]], matrix: np.ndarray, entries: int = 1 << 22) -> pa.Array:
    """Unit-length sums of the vectors of each list's words."""
    at, owner, _ = _places(codes, lists, index)
    sums = _totals(at[at >= 0], owner[at >= 0], len(lists), matrix, entries)
    return _vectors(_scaled(sums), pa.float32(), np.asarray(pc.or_(pc.is_null(codes), pc.is_null(lists))))


def load(spark, path: str, supported: tuple[str, ...], default_language: str, dim: int) -> WordVectors:
    return WordVectors(spark.read.parquet(path), supported, default_language, dim)


def _literal(vector) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def _unit(vector) -> np.ndarray:
    v = np.array(vector, np.float64)
    norm = np.sqrt((v * v).sum())
    return v / norm if norm > 0 else v


def top_k(df: DataFrame, vector: str, query: list[float], k: int, output: str = "score") -> DataFrame:
    """The k rows of the largest inner product with a constant vector: one pass, no full sort."""
    return df.withColumn(output, dot(F.col(vector), _literal(query))).orderBy(F.desc(output)).limit(k)
