"""Document quality by a regularised quadratic discriminant.

Thirteen statistics of the whole text, each put through a logarithm or an arcsine square root, are modelled as
one Gaussian per class. The class covariances are shrunk towards the pooled one and towards its diagonal; their
Cholesky factors are computed once and cached in the model. A score is the logistic of the difference of the
two log densities (Mahalanobis terms by triangular solves) plus the log prior odds, tempered by ``TEMPER``
because the statistics aren't really independent Gaussians.

Statistics are computed once per document; the class moments are summed over all labelled rows, so nothing is
sampled. Only the sums (one small row a task) reach the driver.

Defined results: a null or empty text has the statistics of an empty text; rows with a null id or label don't
teach; a label repeated for a document counts as often as it is there; with fewer than two classes every score
is the learned prior (0.5 when nothing was learned); repeated rows are scored alike; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import doc_crc, free_name, staged
from textloom.sources.io import read_table

THRESHOLD = 0.3
TEMPER = 0.3
TO_POOLED, TO_DIAGONAL, FLOOR = 0.1, 0.05, 1e-3
NAMES = ("length", "words", "upper", "digit", "comma_stop", "rare_sign", "space", "breaks", "word_length", "distinct", "top_word", "double_line", "adjacent_copy")
D = len(NAMES)

_CLASS = np.zeros(256, np.uint8)  # letters and bytes beyond ASCII: 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[ord(c) for c in ".,;:'?-\"()"]] = 3
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'?-\"()"]] = 4
_CLASS[[9, 11, 12, 13, 32]] = 5
_CLASS[10] = 6


def _row(text: str) -> tuple[float, ...]:
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = len(raw)
    kinds = np.zeros(7, np.int64)
    for at in range(0, n, 1 << 22):
        kinds += np.bincount(_CLASS[raw[at : at + (1 << 22)]], minlength=7)
    words = text.split()
    m = len(words)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x.strip()]
    copies = sum(map(str.__eq__, words, words[1:]))
    share = lambda x, of: x / of if of else 0.0
    rare = sorted(counts.values())[-1] if counts else 0
    return (n, m, share(kinds[1], n), share(kinds[2], n), share(kinds[3], m), share(kinds[4], m), share(kinds[5], n), share(kinds[6], m), share(n, m), share(len(counts), m), share(rare, m), share(len(lines) - len(set(lines)), len(lines)), share(copies, m))


def statistics(texts: list[str | None]) -> np.ndarray:
    """(texts, D) transformed statistics."""
    x = np.array([_row(t or "") for t in texts], np.float64).reshape(len(texts), D)
    out = np.arcsin(np.sqrt(np.clip(x, 0, 1)))
    for k, log in ((0, True), (1, True), (8, True)):
        out[:, k] = np.log1p(x[:, k]) if log else x[:, k]
    out[:, [4, 5]] = np.log1p(10 * x[:, [4, 5]])
    # how many different words a text of its length has, so that length itself doesn't decide
    out[:, 9] = np.where(x[:, 1] > 0, np.log1p(x[:, 9] * x[:, 1]) / np.log1p(np.maximum(x[:, 1], 1)), 1.0)
    out[:, 10] = np.sqrt(x[:, 10] * np.sqrt(x[:, 1]))
    return out


def statistics_column():
    @F.pandas_udf("array<double>")
    def compute(texts: pd.Series) -> pd.Series:
        return pd.Series(list(statistics([x if isinstance(x, str) else None for x in texts])))

    return compute


class Discriminant:
    """Two Gaussians with cached Cholesky factors."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]]):
        self.prior = 0.5
        self.classes: list[tuple[np.ndarray, np.ndarray, float]] = []
        total = sum(m[0] for m in moments.values())
        if total:
            self.prior = moments[1][0] / total if 1 in moments else 0.0
        if set(moments) != {0, 1} or min(m[0] for m in moments.values()) < 2:
            return
        means = {c: s / n for c, (n, s, _) in moments.items()}
        covs = {c: q / n - np.outer(means[c], means[c]) for c, (n, _, q) in moments.items()}
        pooled = sum(moments[c][0] * covs[c] for c in (0, 1)) / total
        for c in (0, 1):
            cov = (1 - TO_POOLED) * covs[c] + TO_POOLED * pooled
            cov = (1 - TO_DIAGONAL) * cov + TO_DIAGONAL * np.diag(np.diag(cov)) + FLOOR * np.eye(D)
            factor = np.linalg.cholesky(cov)
            self.classes.append((means[c], np.linalg.inv(factor), float(np.log(np.diag(factor)).sum())))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.classes:
            return np.full(len(x), self.prior)
        logs = [-0.5 * (((x - mean) @ inverse.T) ** 2).sum(axis=1) - half_det for mean, inverse, half_det in self.classes]
        odds = TEMPER * (logs[1] - logs[0]) + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per class: count, sums and sums of products of the statistics."""
    sums: dict[int, list] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        label = batch.column("quality").to_numpy()
        x = batch.column("x").flatten().to_numpy().reshape(-1, D)
        for c in (0, 1):
            own = x[label == c]
            if len(own):
                now = sums.setdefault(c, [0, np.zeros(D), np.zeros((D, D))])
                now[0] += len(own)
                now[1] += own.sum(axis=0)
                now[2] += own.T @ own
    for c, (n, s, q) in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([float(n)]), pa.array([s.tolist()]), pa.array([q.ravel().tolist()])], ["c", "n", "s", "q"])


def learn(measured: DataFrame, labels: DataFrame) -> Discriminant:
    """Fits on the labelled rows of ``measured`` (doc_id, x) whose id's crc32 is no multiple of five."""
    known = labels.where("doc_id is not null and quality in (0, 1)").where(doc_crc() % 5 != 0).select("doc_id", F.col("quality").cast("int").alias("quality"))
    # the sums of a task stay apart and are added up in pairs on the executors
    parts = measured.join(known.hint("shuffle_hash"), "doc_id").select("quality", "x").mapInArrow(_moments, "c long, n double, s array<double>, q array<double>")
    add = lambda name, width: F.array(*[F.sum(F.col(name)[k]) for k in range(width)]).alias(name)
    rows = parts.groupBy("c").agg(F.sum("n").alias("n"), add("s", D), add("q", D * D)).collect()
    return Discriminant({r["c"]: (r["n"], np.array(r["s"]), np.array(r["q"]).reshape(D, D)) for r in rows})


def scorer(spark, model: Discriminant):
    """Column function: statistics -> score."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(np.stack(x.to_numpy())) if len(x) else np.zeros(0))

    return score


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    measured = staged(docs.select("doc_id", statistics_column()("text").alias("x")), "statistics")
    model = learn(measured, labels)
    scored = measured.select("doc_id", F.coalesce(doc_crc() % 5 == 0, F.lit(False)).alias("held_out"), scorer(docs.sparkSession, model)("x").alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least ``threshold``, columns as they are.

    Documents are written once with their statistics, which then teach and are scored: every text is measured once,
    and only (id, statistics) of the documents meet the labels, so that texts are never shuffled.
    """
    own = free_name(docs, "statistics")
    measured = staged(docs.withColumn(own, statistics_column()("text")), "measured")
    model = learn(measured.select("doc_id", F.col(own).alias("x")), labels)
    return measured.where(scorer(docs.sparkSession, model)(own) >= threshold).drop(own)


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return score_documents(read_table(spark, f"{sf_dir}/documents.parquet"), read("labels"))


QUERIES = {"op8_quality_classifier": op8_quality_classifier}
SQL: dict[str, str] = {}
