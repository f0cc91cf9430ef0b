"""Best-fit packing of tokenised documents into sequences, by patterns fitted to the length histogram.

A document's ids are cut into pieces of ``CAPACITY`` only where it is longer. The histogram of piece lengths has
at most ``CAPACITY`` entries and is all the driver sees. Patterns of one to three lengths that fill a sequence
are enumerated, their repeat counts fitted to the histogram by non-negative least squares (accelerated projected
gradient), rounded and clipped to what is there; what is left is packed best-fit decreasing, whole groups of
equal lengths at a time. Of several damped versions of the fit the one with the fewest sequences is used, the
purely residual one among them.

Pieces get their rank among those of their length without a shuffle by length: a task counts its own while it
tokenises, and the counts per (length, task) give each task its first rank. A rank then finds its sequence in
a table of runs that is bounded by the number of patterns, not of documents.

Defined results: a null or empty text is the single id 0; repeated rows are separate documents; a null id stays
null; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import staged
from textloom.sources.io import read_table

CAPACITY = 2048
CACHE_WORDS = 600_000
#: Longer words are encoded each time: the cache is bounded in bytes too.
CACHE_CHARS = 64
_SEGMENT = 1 << 20
#: Characters for which the tokenizer's normaliser only lower-cases, as str.lower does.
_PLAIN = re.compile("[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*\\Z")
_WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+")
_SPECIAL = re.compile("<\\|(?:start|end)oftext\\|>")


class WordEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers; words are encoded once and remembered."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # how the byte-level step writes the plain characters that aren't ASCII
        self.spelled = {ord(c): self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"}
        self.known: dict[str, bytes] = {}

    def _direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: Iterable[str], known: dict[str, bytes]) -> None:
        """Plain words go to the model as they are; every other step of the tokenizer would leave them alone."""
        tokenize, spelled = self.model.tokenize, self.spelled
        for word in words:
            known[word] = array("I", [t.id for t in tokenize(word if word.isascii() else word.translate(spelled))]).tobytes()

    def _room(self, n: int) -> None:
        """Keeps the words that were learned first, which are the frequent ones."""
        if len(self.known) + n > CACHE_WORDS:
            self.known = dict(islice(self.known.items(), CACHE_WORDS // 2))

    def encode(self, text: str) -> bytes:
        out, at = [], 0
        special = _SPECIAL.search(text) is not None
        while at < len(text):
            end = min(len(text), at + _SEGMENT)
            while end < len(text) and text[end] not in " \n\t":
                end += 1
            part = text[at:end]
            at = end
            if special or not _PLAIN.match(part):
                out.append(self._direct(part))
                continue
            words = _WORD.findall(part.lower())
            new = set(words).difference(self.known)
            if new:
                self._room(len(new))
                new = set(words).difference(self.known)
                long_ones: dict[str, bytes] = {}
                self._learn([w for w in new if len(w) > CACHE_CHARS], long_ones)
                self._learn(new.difference(long_ones), self.known)
                if long_ones:
                    out += [long_ones[w] if w in long_ones else self.known[w] for w in words]
                    continue
            out.append(b"".join(map(self.known.__getitem__, words)))
        return b"".join(out)


@lru_cache(4)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _cut(path: str, capacity: int, tail: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        part = TaskContext.get().partitionId()
        ranks = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                raw = (encoder.encode(text.as_py()) if text.is_valid else b"") + tail
                for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                    own = raw[at : at + 4 * capacity]
                    length = len(own) // 4
                    rows.append((doc, piece, at // 4, length, zlib.crc32(own), part, int(ranks[length])))
                    ranks[length] += 1
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "own_rank"])

    return run


Pattern = tuple[tuple[int, int], ...]


def _patterns(hist: np.ndarray, capacity: int) -> np.ndarray:
    """Triples of lengths that fill a sequence (0: none), all of them present in the histogram."""
    there = np.flatnonzero(hist[:capacity])
    there = there[there > 0]
    rest = capacity - there
    found = [np.stack([there, rest, np.zeros_like(there)], axis=1)[(hist[rest] > 0) & (rest < capacity)]]
    for eighths in (1, 2, 3, 4):
        a = rest * eighths // 8
        b = rest - a
        ok = (a > 0) & (b > 0)
        ok[ok] &= (hist[a[ok]] > 0) & (hist[b[ok]] > 0)
        found.append(np.stack([there, a, b], axis=1)[ok])
    return np.unique(np.sort(np.concatenate(found), axis=1), axis=0)


def fit_counts(patterns: np.ndarray, hist: np.ndarray, rounds: int = 600) -> np.ndarray:
    """Non-negative least squares of pattern repeats against the histogram, each length weighted by its standard error."""
    if not len(patterns):
        return np.zeros(0)
    weight = 1 / np.sqrt(hist + 1.0)
    weight[0] = 0.0
    target = weight * hist
    wide = weight[patterns]

    def forward(x: np.ndarray) -> np.ndarray:
        return np.bincount(patterns.ravel(), (wide * x[:, None]).ravel(), len(hist))

    probe = np.ones(len(patterns))
    for _ in range(20):
        probe = (wide * forward(probe)[patterns]).sum(axis=1)
        norm = np.linalg.norm(probe)
        probe /= norm
    step = 1 / (1.05 * norm)
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        slope = (wide * (forward(y) - target)[patterns]).sum(axis=1)
        new = np.maximum(0, y - step * slope)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y = new + (before - 1) / t * (new - x)
        x = new
    return x


def _residual(hist: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing on a histogram: equal lengths go into equal gaps in bulk."""
    open_bins: dict[int, list[tuple[Pattern, int]]] = {capacity: []}
    gaps = np.zeros(capacity + 1, np.int64)

    def put(gap: int, pattern: Pattern, count: int) -> None:
        if count:
            open_bins.setdefault(gap, []).append((pattern, count))
            gaps[gap] += count

    for length in range(capacity, 0, -1):
        left = int(hist[length])
        while left:
            fits = np.flatnonzero(gaps[length:])
            if not len(fits):
                each = capacity // length
                put(capacity - each * length, ((length, each),), left // each)
                if left % each:
                    put(capacity - left % each * length, ((length, left % each),), 1)
                break
            gap = length + int(fits[0])
            pattern, count = open_bins[gap].pop()
            gaps[gap] -= count
            each = gap // length
            full = min(count, left // each)
            put(gap - each * length, (*pattern, (length, each)), full)
            left, count = left - full * each, count - full
            if count and 0 < left < each:
                put(gap - left * length, (*pattern, (length, left)), 1)
                left, count = 0, count - 1
            put(gap, pattern, count)
    return [x for gap in open_bins.values() for x in gap]


def plan(hist: np.ndarray, capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Patterns ((length, times), ...) with their counts; they use up the histogram exactly."""
    hist = hist.astype(np.int64)
    patterns = _patterns(hist, capacity)
    fitted = fit_counts(patterns, hist.astype(float))
    order = np.argsort(-fitted, kind="stable")
    best: list[tuple[Pattern, int]] = []
    fewest = None
    for damping in (1.0, 0.97, 0.9, 0.7, 0.4, 0.0):
        left, chosen = hist.copy(), []
        for p in order.tolist() if damping else []:
            want = round(damping * fitted[p])
            if want < 1:
                break
            lengths = [int(v) for v in patterns[p] if v]
            times = {v: lengths.count(v) for v in lengths}
            count = min(want, *(int(left[v]) // k for v, k in times.items()))
            if count:
                for v, k in times.items():
                    left[v] -= k * count
                chosen.append((tuple(sorted(times.items(), reverse=True)), count))
        chosen += _residual(left, capacity)
        total = sum(c for _, c in chosen)
        if fewest is None or total < fewest:
            best, fewest = chosen, total
    return best


class Runs:
    """Where the pieces of each length go: for a rank, the sequence and the place in it."""

    def __init__(self, chosen: list[tuple[Pattern, int]], capacity: int):
        used = np.zeros(capacity + 1, np.int64)
        rows, sequence = [], 0
        for pattern, count in chosen:
            offset = 0
            for length, times in pattern:
                rows.append((length, int(used[length]), times, sequence, offset))
                used[length] += times * count
                offset += length * times
            sequence += count
        self.sequences = sequence
        table = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.key, self.rank, self.times, self.base, self.offset = table[:, 0] << 44 | table[:, 1], table[:, 1], table[:, 2], table[:, 3], table[:, 4]

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, length << 44 | rank, "right") - 1
        step = rank - self.rank[at]
        return self.base[at] + step // self.times[at], self.offset[at] + step % self.times[at] * length


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    tail = np.array([end_id], "<u4").tobytes()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, own_rank long"
    pieces = staged(docs.select("doc_id", "text").mapInArrow(_cut(tokenizer_path, capacity, tail), schema), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("c"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = staged(counts.select("length", "part", "c", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("first")), "ranks")
    hist = np.zeros(capacity + 1, np.int64)
    for r in firsts.groupBy("length").agg(F.sum("c").alias("c")).collect():
        hist[r["length"]] = r["c"]
    shared = spark.sparkContext.broadcast(Runs(plan(hist, capacity), capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = shared.value.place(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    # the ranks grow with the tasks and are far larger in memory than in their files: never a broadcast
    ranked = pieces.join(firsts.drop("c").hint("shuffle_hash"), ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("own_rank")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read_table(spark, f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op1_best_fit_packing": op1_best_fit_packing}
SQL: dict[str, str] = {}
