"""SimHash near-duplicate detection by anchor-point covering.

Fingerprints of 64 bits link when they differ in at most three of them. Two such fingerprints differ in at
most one bit of one 32-bit half, so each half is covered on its own with threshold one. The covering code of a
half is the product of the perfect binary Golay code (23 bits, radius 3), the perfect Hamming code (7 bits,
radius 1) and two plain bits (radius 0). A fingerprint's home anchor is the nearest code word; it is replicated
to every anchor that can be home to a fingerprint one bit away (radius plus one in one component, the nearest
code word in the others; about ten of them a half). Every directed link is counted exactly once: at the home
anchor of its first end, in the first half in which the two differ in at most one bit.

Copies collapse to distinct fingerprints before anything is replicated; anchors with many fingerprints are cut
into a grid of blocks, so no task holds more than ``block`` rows a side. Per block the links are only counted
and a spanning forest is emitted, never the pairs.

Defined results: a null or empty text has fingerprint zero, which links like any other; repeated rows are
separate documents; rows without an id count as documents but never name a component unless all its rows lack
one (then null); an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import free_name, join_side, staged, without
from textloom.sources.io import read_table

THRESHOLD = 3
#: Rows a side of one comparison block; two of them make about 10^9 comparisons at most.
BLOCK = 32768
_SEGMENT = 1 << 20
_SPACE = b" \t\n\x0b\x0c\r"


def _shingle_hashes(text: str) -> np.ndarray:
    """XXH64 (seed 42) of every 3-word shingle; long texts go through in segments that overlap by two words."""
    raw = text.encode("utf-8", "surrogatepass").lower()
    digest = partial(xxhash.xxh64_intdigest, seed=42)
    parts, carry, at, total = [], [], 0, len(raw)
    while at < total:
        end = min(total, at + _SEGMENT)
        while end < total and raw[end] not in _SPACE:
            end += 1
        words = carry + raw[at:end].split()
        if len(words) >= 3:
            n = len(words) - 2
            parts.append(np.fromiter(map(digest, map(b" ".join, zip(words, words[1:], words[2:], strict=False))), np.uint64, n))
        carry, at = words[-2:], end
    if parts:
        return parts[0] if len(parts) == 1 else np.concatenate(parts)
    return np.array([digest(b" ".join(carry))] if carry else [], np.uint64)


@lru_cache(1)
def _lanes() -> np.ndarray:
    """For each byte value its eight bits, one to a byte of a 64-bit lane."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(bits).view(np.uint64).ravel()


def _majority(hashes: list[np.ndarray]) -> np.ndarray:
    """One fingerprint per array of hashes: the bits set in more than half of them."""
    out = np.zeros(len(hashes), np.uint64)
    full = [i for i, h in enumerate(hashes) if len(h)]
    if not full:
        return out
    flat = np.concatenate([hashes[i] for i in full])
    sizes = np.array([len(hashes[i]) for i in full])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    # a byte of a lane counts to 255 at most
    chunks = -(-sizes // 255)
    first_chunk = np.concatenate([[0], np.cumsum(chunks)[:-1]])
    within = np.arange(chunks.sum()) - np.repeat(first_chunk, chunks)
    cuts = np.repeat(starts, chunks) + within * 255
    lanes = _lanes()[flat.view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(lanes, cuts, axis=0).view(np.uint8).reshape(len(cuts), 64)
    counts = np.add.reduceat(sums.astype(np.int64), first_chunk, axis=0)
    bits = (2 * counts > sizes[:, None]).astype(np.uint8)
    out[full] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """Unsigned 64-bit SimHash of each text."""
    out, group, first, held = np.zeros(len(texts), np.uint64), [], 0, 0
    for i, text in enumerate(texts):
        group.append(_shingle_hashes(text) if text else np.array([], np.uint64))
        held += len(group[-1])
        if held > 200_000 or i == len(texts) - 1:
            out[first : i + 1] = _majority(group)
            group, first, held = [], i + 1, 0
    return out


@F.pandas_udf(T.LongType())
def fingerprint_column(texts: pd.Series) -> pd.Series:
    """SimHash as a signed long with the same 64 bits."""
    return pd.Series(fingerprints([None if x is None or x is pd.NA else x for x in texts]).view(np.int64))


@lru_cache(1)
def _codes() -> dict[str, np.ndarray]:
    """Syndrome tables: per coset the error vectors of weight up to the covering radius plus one, lightest first."""
    generator = 0b101011100011
    rows = []
    for i in range(11, 23):  # remainder of x^i by the generator polynomial
        value = 1 << i
        for bit in range(22, 10, -1):
            if value >> bit & 1:
                value ^= generator << (bit - 11)
        rows.append(value)
    columns = np.array([1 << i for i in range(11)] + rows, np.int64)
    syndrome = np.zeros(1 << 12, np.int64), np.zeros(1 << 11, np.int64)
    for part, low, width in ((0, 0, 12), (1, 12, 11)):
        for bit in range(width):
            on = (np.arange(1 << width) >> bit & 1).astype(bool)
            syndrome[part][on] ^= columns[low + bit]
    near: dict[int, list[int]] = {}
    for weight in range(5):
        for e in _weight_vectors(23, weight):
            near.setdefault(int(syndrome[0][e & 4095] ^ syndrome[1][e >> 12]), []).append(e)
    width = max(map(len, near.values()))
    golay = np.full((1 << 11, width), -1, np.int64)
    for s, errors in near.items():
        golay[s, : len(errors)] = errors
    ham_syndrome = np.zeros(128, np.int64)
    for bit in range(7):
        ham_syndrome[(np.arange(128) >> bit & 1).astype(bool)] ^= bit + 1
    hamming = np.full((8, 4), -1, np.int64)
    for s in range(8):
        errors = sorted((e for w in range(3) for e in _weight_vectors(7, w) if ham_syndrome[e] == s), key=lambda e: (e.bit_count(), e))
        hamming[s, : len(errors)] = errors
    return {"g0": syndrome[0], "g1": syndrome[1], "golay": golay, "h": ham_syndrome, "hamming": hamming}


def _weight_vectors(width: int, weight: int) -> Iterator[int]:
    from itertools import combinations

    for places in combinations(range(width), weight):
        yield sum(1 << p for p in places)


def anchors(half_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of 32-bit words (int64): rows and anchors, the home anchor of each row first among its own."""
    t = _codes()
    g, h, plain = half_words & 0x7FFFFF, half_words >> 23 & 0x7F, half_words >> 30 & 3
    g_errors = t["golay"][t["g0"][g & 4095] ^ t["g1"][g >> 12]]
    h_errors = t["hamming"][t["h"][h]]
    home_g, home_h = g ^ g_errors[:, 0], h ^ h_errors[:, 0]
    parts = [home_g | home_h << 23 | plain << 30]
    rows = [np.arange(len(half_words))]
    for k in range(1, g_errors.shape[1]):
        at = np.flatnonzero(g_errors[:, k] >= 0)
        rows.append(at)
        parts.append((g[at] ^ g_errors[at, k]) | home_h[at] << 23 | plain[at] << 30)
    for k in range(1, h_errors.shape[1]):
        at = np.flatnonzero(h_errors[:, k] >= 0)
        rows.append(at)
        parts.append(home_g[at] | (h[at] ^ h_errors[at, k]) << 23 | plain[at] << 30)
    for flip in (1, 2):
        rows.append(rows[0])
        parts.append(home_g | home_h << 23 | (plain ^ flip) << 30)
    return np.concatenate(rows), np.concatenate(parts)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp, n = batch.column("fp").to_numpy(), batch.column("n").to_numpy()
        for half in (0, 1):
            rows, keys = anchors(fp >> (32 * half) & 0xFFFFFFFF)
            home = np.zeros(len(rows), bool)
            home[: len(fp)] = True
            yield pa.RecordBatch.from_arrays([pa.array(keys | half << 32), pa.array(fp[rows]), pa.array(n[rows]), pa.array(home)], ["anchor", "fp", "n", "home"])


def _forest(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the classes of a and b in ``labels`` (smallest index as label), in place."""
    while True:
        x, y = labels[a], labels[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up


def count_links(block: np.ndarray, half: np.ndarray, fp: np.ndarray, n: np.ndarray, query: np.ndarray, budget: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Links of sorted blocks: for each row that is a query, the copies it links to; and for every row the smallest row it hangs together with."""
    edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    sizes = np.diff(np.append(edges, len(block)))
    group = np.repeat(np.arange(len(edges)), sizes)
    stop = edges + sizes
    # within a block the queries come first
    n_query = np.add.reduceat(query.astype(np.int64), edges)
    begin = edges + n_query
    links = np.zeros(len(fp), np.int64)
    labels = np.arange(len(fp))
    rows = np.flatnonzero(query)
    width = (stop - begin)[group[rows]]
    rows, width = rows[width > 0], width[width > 0]
    at = 0
    ends = np.cumsum(width)
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + budget, "right")))
        r, w = rows[at:to], width[at:to]
        left = np.repeat(r, w)
        offset = np.arange(len(left)) - np.repeat(np.cumsum(w) - w, w)
        right = begin[group[left]] + offset
        differ = fp[left] ^ fp[right]
        hit = np.flatnonzero((np.bitwise_count(differ) <= THRESHOLD) & (differ != 0))
        if len(hit):
            left, right, low = left[hit], right[hit], np.bitwise_count(differ[hit] & np.uint64(0xFFFFFFFF))
            first = np.where(half[left] == 0, low <= 1, low > 1)
            left, right = left[first], right[first]
            np.add.at(links, left, n[right])
            _forest(labels, left, right)
        at = to
    return links, labels


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (anchor, i, j, role) -> (fp, links, root); the last block of a batch waits for the next one."""

    def solve(rows: list[np.ndarray]) -> pa.RecordBatch:
        anchor, i, j, fp, n, query = rows
        same = (anchor[1:] == anchor[:-1]) & (i[1:] == i[:-1]) & (j[1:] == j[:-1])
        block = np.concatenate([[0], np.cumsum(~same)])
        unsigned = fp.view(np.uint64)
        links, labels = count_links(block, anchor >> 32, unsigned, n, query)
        # a label is the smallest row of its tree; its fingerprint stands for the tree
        use = np.flatnonzero((links > 0) | (labels != np.arange(len(labels))))
        return pa.RecordBatch.from_arrays([pa.array(fp[use]), pa.array(links[use]), pa.array(fp[labels[use]])], ["fp", "links", "root"])

    held: list[np.ndarray] | None = None
    waiting: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [np.ascontiguousarray(c.to_numpy(zero_copy_only=False)) for c in batch.columns]
        waiting.append(now)
        # only a batch that begins another block completes the ones before it
        last = tuple(x[-1] for x in now[:3])
        if len(waiting) > 1 and tuple(x[0] for x in waiting[0][:3]) == last:
            continue
        held = [np.concatenate(x) for x in zip(*waiting, strict=True)]
        cut = int(np.searchsorted((held[0] == last[0]) & (held[1] == last[1]) & (held[2] == last[2]), True))
        if cut:
            yield solve([x[:cut] for x in held])
        waiting = [[x[cut:] for x in held]]
    if waiting:
        yield solve([np.concatenate(x) for x in zip(*waiting, strict=True)])


def link_table(groups: DataFrame, block: int = BLOCK) -> DataFrame:
    """From distinct fingerprints (fp, n) to (fp, links, root) pieces: sum the links; the roots are forest edges."""
    replicas = groups.select("fp", "n").mapInArrow(_replicate, "anchor long, fp long, n long, home boolean")
    hot = replicas.groupBy("anchor").agg(F.sum(F.col("home").cast("long")).alias("homes"), F.count("*").alias("all_rows")).where(f"homes > 0 and all_rows > {block}")
    hot = hot.select("anchor", F.ceil(F.col("homes") / block).cast("int").alias("si"), F.ceil(F.col("all_rows") / block).cast("int").alias("sj"))
    hot = join_side(staged(hot, "hot"), 64)
    grid = replicas.join(hot, "anchor", "left").withColumn("si", F.coalesce("si", F.lit(1))).withColumn("sj", F.coalesce("sj", F.lit(1)))
    pick = F.xxhash64("fp")
    compared = grid.withColumn("j", F.pmod(pick, F.col("sj")).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("si") - 1))).withColumn("query", F.lit(False))
    asking = grid.where("home").withColumn("i", F.pmod(pick, F.col("si")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("sj") - 1))).withColumn("query", F.lit(True))
    columns = ["anchor", "i", "j", "fp", "n", "query"]
    rows = compared.select(columns).unionByName(asking.select(columns))
    rows = rows.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j", F.desc("query"))
    return rows.mapInArrow(_links, "fp long, links long, root long")


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Connected components of (a, b) edges by alternating large-star and small-star; gives (node, root) for every node on an edge.

    Minima are pre-aggregated, so a node on very many edges costs one combined row a task; the join back is left
    to adaptive skew splitting. Every round is written to the shared folder.
    """
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least.hint("shuffle_hash"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("shuffle_hash"), "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = staged(small, "edges")
        seen = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if seen == mark or seen[0] == 0:
            break
        mark = seen
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(documents, classes): (doc_id, fp, n_near, component_id), and (fp, copies, n_near, root, component_id) per fingerprint."""
    own = staged(docs.select(F.col(id_col).alias("doc_id"), fingerprint_column(F.col(text_col)).alias("fp")), "fingerprints")
    groups = staged(own.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")), "groups")
    pieces = staged(link_table(groups, block), "links")
    roots = components(pieces.select(F.col("fp").alias("a"), F.col("root").alias("b")))
    none = F.lit(None).cast("long")
    per_fp = (
        groups.select("fp", "n", "first_id", F.lit(0).cast("long").alias("links"), none.alias("root"))
        .unionByName(pieces.select("fp", F.lit(0).cast("long").alias("n"), none.alias("first_id"), "links", none.alias("root")))
        .unionByName(roots.select(F.col("node").alias("fp"), F.lit(0).cast("long").alias("n"), none.alias("first_id"), F.lit(0).cast("long").alias("links"), "root"))
        .groupBy("fp")
        .agg(F.sum("n").alias("copies"), F.min("first_id").alias("first_id"), F.sum("links").alias("links"), F.min("root").alias("root"))
        .withColumn("root", F.coalesce("root", "fp"))
    )
    linked = per_fp.where("links > 0").groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = per_fp.join(linked.hint("shuffle_hash"), "root", "left").select("fp", "copies", (F.col("links") + F.col("copies") - 1).alias("n_near"), "root", F.coalesce("component_id", "first_id").alias("component_id"))
    classes = staged(classes, "classes")
    return own.join(classes.hint("merge"), "fp").select("doc_id", "fp", "n_near", "component_id"), classes


def keep_one_per_group(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The documents less all but one of each group of near duplicates, with their columns as they are.

    The row with the smallest ``doc_id`` stays. Rows whose id is null or repeated can't be told apart by it, so
    they go by their fingerprint: one row stays of a group that has no other representative.
    """
    marked, classes = near_duplicates(docs.select("doc_id", "text"), block=block)
    marked = staged(marked, "marked")
    per_id = marked.groupBy("doc_id").agg(F.count("*").alias("c"), F.max((F.col("doc_id") != F.col("component_id")).cast("int")).alias("other"))
    odd = staged(per_id.where("c > 1 or doc_id is null").select("doc_id"), "odd")
    gone = staged(per_id.where("c = 1 and other = 1 and doc_id is not null").select("doc_id"), "gone")
    if odd.isEmpty():
        return without(docs, ["doc_id"], gone, marked)
    regular = without(docs, ["doc_id"], staged(odd.unionByName(gone), "apart"), marked.select("doc_id").distinct())
    odd = join_side(odd, 48)
    held = docs.join(odd, docs["doc_id"].eqNullSafe(odd["doc_id"]), "left_semi")
    fp = free_name(held, "fp")
    held = held.withColumn(fp, fingerprint_column("text"))
    root, component = free_name(held, "root"), free_name(held, "component")
    tagged = held.join(classes.select(F.col("fp").alias(fp), F.col("root").alias(root), F.col("component_id").alias(component)), fp)
    tagged = tagged.where(F.col(component).isNull() | (F.col("doc_id") == F.col(component)))
    return regular.unionByName(tagged.dropDuplicates([root]).select(docs.columns))


def op10_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, f"{sf_dir}/documents.parquet")
    marked, _ = near_duplicates(docs)
    return marked.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "n_near", "component_id")


QUERIES = {"op10_simhash_near_dedup": op10_simhash_near_dedup}
SQL: dict[str, str] = {}
