"""Nearest neighbours by inner product with an inverted multi-index.

Vectors get one more component that makes their norms equal, so that the largest inner product is the smallest
distance; the two halves are quantised apart by k-means. An entry's cell is its pair of centroids. A query walks
the pairs by summed distance with a heap over the two sorted lists until the cells hold the share of all entries
that the index was tuned to, and what lies in them is reranked by the true product in double precision.

The codebooks and the share are fitted on at most ``SAMPLE`` rows (the first by a hash of the id); the share is
the one within which ``RECALL`` of the sample's true neighbours lie, which errs to the safe side since the
neighbours among all rows are nearer than those within a sample. Every row is indexed. Cells are cut into
blocks of about ``ROWS`` rows; a query goes once to each block that holds one of its cells, with the cells it has
there; a task holds one block and streams the queries past it. The codebooks grow with the fourth root of the rows
up to ``MAX_CENTROIDS`` a half, so that the driver sees a million cell sizes at most; larger cells are cut, not lost.

Defined results: vectors that are null, empty, zero, of another length than most, or hold null or non-finite
components take no part, nor do rows without an id; rows that share an id count once (the smallest vector);
ties go to the smaller id; with fewer candidates all are returned; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import join_side, staged, without

SAMPLE, RECALL, ROWS, QUERIES_A_BLOCK, MAX_CENTROIDS = 16384, 0.95, 8192, 65536, 1024


def _kmeans(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    rng = np.random.default_rng(7)
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        sizes = np.bincount(near, minlength=k)
        full = sizes > 0
        centres[full] = sums[full] / sizes[full, None]
    return centres


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return _distances(x, centres).argmin(axis=1)


class MultiIndex:
    """Codebooks of both halves, and after ``count`` the sizes of the cells."""

    def __init__(self, sample: np.ndarray, top_norm: float, k: int):
        self.top, self.cut = top_norm, (sample.shape[1] + 1) // 2
        left, right = self._halves(sample, False)
        self.books = [_kmeans(h, min(k, len(h))) for h in (left, right)]
        self.width = len(self.books[1])
        self.n_cells = len(self.books[0]) * self.width
        self.sizes = np.bincount(self.cells(sample), minlength=self.n_cells)
        self.share = 1.0

    def _halves(self, x: np.ndarray, query: bool) -> tuple[np.ndarray, np.ndarray]:
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.top**2 - (x * x).sum(axis=1)))
        return x[:, : self.cut], np.concatenate([x[:, self.cut :], extra[:, None]], axis=1)

    def cells(self, x: np.ndarray) -> np.ndarray:
        left, right = self._halves(x, False)
        return _nearest(left, self.books[0]) * self.width + _nearest(right, self.books[1])

    def traverse(self, a: np.ndarray, b: np.ndarray, wanted: float) -> list[int]:
        """Cells by growing a[i] + b[j], until they hold ``wanted`` entries."""
        first, second = np.argsort(a, kind="stable").tolist(), np.argsort(b, kind="stable").tolist()
        left, right = a[first].tolist(), b[second].tolist()
        sizes, width = self.sizes, self.width
        heap = [(left[0] + right[0], 0, 0)]
        found, held = [], 0
        while heap and held < wanted:
            _, i, j = heapq.heappop(heap)
            cell = first[i] * width + second[j]
            if sizes[cell]:
                found.append(cell)
                held += int(sizes[cell])
            if j + 1 < len(right):
                heapq.heappush(heap, (left[i] + right[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(left):  # every pair enters once, by its row
                heapq.heappush(heap, (left[i + 1] + right[0], i + 1, 0))
        return found

    def walk(self, queries: np.ndarray) -> Iterator[list[int]]:
        left, right = self._halves(queries, True)
        da, db = _distances(left, self.books[0]), _distances(right, self.books[1])
        wanted = self.share * self.sizes.sum()
        for a, b in zip(da, db, strict=True):
            yield self.traverse(a, b, wanted)

    def tune(self, sample: np.ndarray, k: int, recall: float, probes: int = 256) -> None:
        """Sets the share of entries within which ``recall`` of the sample's own neighbours lie."""
        queries = sample[np.random.default_rng(3).choice(len(sample), min(probes, len(sample)), replace=False)]
        cells, needed = self.cells(sample), []
        truth = np.argsort(-(queries @ sample.T), axis=1, kind="stable")[:, : k + 1]
        for found, near in zip(self.walk(queries), truth, strict=True):
            held = np.cumsum(self.sizes[found])
            place = dict(zip(found, held.tolist(), strict=True))
            needed += [place[c] for c in cells[near[1:]].tolist()]
        if needed:
            self.share = min(1.0, float(np.quantile(needed, recall)) / len(sample) * 1.02)


def _index(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("v").flatten().to_numpy()
            if batch.num_rows:
                cell = shared.value.cells(flat.reshape(batch.num_rows, -1))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cell)], ["vec_id", "v", "cell"])

    return run


def _route(shared, blocks):
    """Queries to the blocks of their cells, each with the cells it has there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, pieces = blocks.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
            rows, targets, cells, cuts, at = [], [], [], [np.zeros(1, np.int64)], 0
            for i, found in enumerate(shared.value.walk(x)):
                own = np.array(found, np.int64)
                times = pieces[own]
                cell = np.repeat(own, times)
                block = first[cell] + np.arange(len(cell)) - np.repeat(np.cumsum(times) - times, times)
                order = np.argsort(block, kind="stable")
                cell, block = cell[order].astype(np.int32), block[order]
                begins = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, np.int64)
                rows.append(np.full(len(begins), i))
                targets.append(block[begins])
                cells.append(cell)
                cuts.append(at + np.append(begins[1:], len(cell)) if len(begins) else begins)
                at += len(cell)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(cuts), pa.int32()), pa.array(np.concatenate(cells)))
            take = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(targets)), batch.column("vec_id").take(take), batch.column("v").take(take), lists], ["block", "vec_id", "v", "cells"])

    return run


def _best(queries: np.ndarray, own: np.ndarray, asked: np.ndarray, x: np.ndarray, ids: np.ndarray, cells: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per query the k best rows of the cells it asks for, by the exact product, smaller ids first."""
    use = np.flatnonzero(asked.any(axis=0)[cells])
    rough = queries @ x[use].T
    rough[~asked[:, cells[use]]] = -np.inf
    rough[own[:, None] == ids[use][None, :]] = -np.inf
    for i in range(len(queries)):
        row = rough[i]
        there = np.flatnonzero(row > -np.inf)
        if len(there) > k:
            bar = np.partition(row[there], len(there) - k)[len(there) - k]
            there = there[row[there] >= bar - 1e-9 * max(1.0, abs(bar))]
        if len(there):
            at = use[there]
            score = (x[at] * queries[i]).sum(axis=1)  # in one order of addition, whatever the block
            pick = np.lexsort((ids[at], -score))[:k]
            yield i, ids[at][pick], score[pick]


def _search(k: int):
    """Blocks, each its rows first and then its queries, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        parts: list[tuple] = []
        here: tuple | None = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            block = batch.column("block").to_numpy() * (1 << 20) + batch.column("salt").to_numpy()
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            ids, cell = batch.column("vec_id").to_numpy(), batch.column("cell").to_numpy()
            x = batch.column("v").flatten().to_numpy().reshape(n, -1)
            cuts = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (asks[1:] != asks[:-1])])).tolist() + [n]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if now != (block[a],):
                    now, parts, here = (block[a],), [], None
                if not asks[a]:
                    parts.append((x[a:b], ids[a:b], cell[a:b]))
                    continue
                if not parts and here is None:
                    continue
                if here is None:
                    rows, row_ids, row_cells = (np.concatenate(p) for p in zip(*parts, strict=True))
                    there, place = np.unique(row_cells, return_inverse=True)
                    here, parts = (rows, row_ids, place), []
                lists = batch.column("cells")[a:b]
                wanted, owner = lists.flatten().to_numpy(), np.repeat(np.arange(b - a), lists.value_lengths().to_numpy())
                at = np.minimum(np.searchsorted(there, wanted), len(there) - 1)
                held = there[at] == wanted  # a piece of a cell may hold none of its rows
                asked = np.zeros((b - a, len(there)), bool)
                asked[owner[held], at[held]] = True
                out: list[list] = [[], [], []]
                for s in range(a, b, 512):
                    e = min(b, s + 512)
                    for i, near, score in _best(x[s:e], ids[s:e], asked[s - a : e - a], *here, k):
                        out[0] += [int(ids[s + i])] * len(near)
                        out[1] += near.tolist()
                        out[2] += score.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, sample: int = SAMPLE, recall: float = RECALL, rows: int = ROWS, centroids: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of (vec_id, embedding) to each of the queries, their own ids left out."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"

    def usable(df: DataFrame) -> DataFrame:
        wide = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
        bad = F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
        return wide.where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~bad & F.exists("v", lambda e: e != 0))

    def distinct(df: DataFrame) -> DataFrame:
        # ids alone are shuffled to find the repeated ones, and vectors only of these
        again = staged(df.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id"), "repeated")
        if again.isEmpty():
            return df
        twice = df.join(join_side(again, 48), "vec_id", "left_semi").groupBy("vec_id").agg(F.min("v").alias("v"))
        return without(df, ["vec_id"], again, staged(df.select("vec_id"), "ids")).unionByName(twice)

    base = distinct(staged(usable(vectors), "vectors"))
    shapes = base.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e)).alias("top")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not shapes:
        return spark.createDataFrame([], schema)
    dim, count, top = shapes[0]["d"], shapes[0]["n"], math.sqrt(shapes[0]["top"])
    base = base.where(F.size("v") == dim)
    # only rows of low hash are ordered, about twice as many as wanted, whatever the number of tasks
    grain, order = 1 << 30, F.xxhash64("vec_id")
    low = F.pmod(order, F.lit(grain)) < min(grain, math.ceil(grain * 2 * sample / count))
    some = np.array([r["v"] for r in base.where(low).orderBy(F.pmod(order, F.lit(grain)), order).limit(sample).collect()])
    k_book = centroids or min(MAX_CENTROIDS, max(4, math.ceil(2 * count**0.25)))
    index = MultiIndex(some, top, k_book)
    index.tune(some, k, recall)

    first = spark.sparkContext.broadcast(index)
    entries = staged(base.mapInArrow(_index(first), "vec_id long, v array<double>, cell long"), "entries")
    sizes = np.zeros(index.n_cells, np.int64)
    for r in entries.groupBy("cell").count().collect():  # as many rows as cells, a million at most
        sizes[r["cell"]] = r["count"]
    index.sizes = sizes
    # small cells share a block, a large one gets several
    first_block, pieces = np.zeros(index.n_cells, np.int64), np.maximum(1, -(-sizes // rows))
    block, held = 0, 0
    for c, need in enumerate(sizes.tolist()):
        if held and held + need > rows:
            block, held = block + 1, 0
        first_block[c] = block
        if pieces[c] > 1:
            block, held = block + int(pieces[c]), 0
        else:
            held += need
    tuned, blocks = spark.sparkContext.broadcast(index), spark.sparkContext.broadcast((first_block, pieces))

    asked = distinct(staged(usable(queries).where(F.size("v") == dim), "asked"))
    asked = staged(asked.mapInArrow(_route(tuned, blocks), "block long, vec_id long, v array<double>, cells array<int>"), "queries")
    loads = asked.groupBy("block").agg(F.ceil(F.count("*") / QUERIES_A_BLOCK).cast("int").alias("salts"))
    used = np.flatnonzero(sizes)
    firsts = spark.createDataFrame(pd.DataFrame({"cell": used, "first": first_block[used], "pieces": pieces[used]}), "cell long, first long, pieces int")
    placed = entries.join(F.broadcast(firsts), "cell").withColumn("block", F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("pieces")))
    loads = join_side(staged(loads, "loads"), 48)  # as many rows as blocks
    placed = placed.join(loads, "block").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    none = F.lit(None).cast("array<int>")
    left = placed.select("block", F.col("salt").cast("long").alias("salt"), F.lit(False).alias("asks"), "vec_id", "cell", "v", none.alias("cells"))
    right = asked.join(loads, "block").select("block", F.pmod(F.xxhash64("vec_id"), F.col("salts")).cast("long").alias("salt"), F.lit(True).alias("asks"), "vec_id", F.lit(-1).cast("long").alias("cell"), "v", "cells")
    found = left.unionByName(right).repartition("block", "salt").sortWithinPartitions("block", "salt", "asks").mapInArrow(_search(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_multi_index_search(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


QUERIES = {"op7_multi_index_search": op7_multi_index_search}
SQL: dict[str, str] = {}
