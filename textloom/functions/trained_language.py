"""A language detector trained on labelled texts: naive Bayes over character n-grams, for short texts and any script.

Every 1- to 3-gram of characters, words marked off by blanks, is hashed to one of ``BUCKETS`` counters a language. What
is kept are the log-probabilities, ``BUCKETS`` numbers a language: 256 KB, whatever it was trained on. A text is
scored whole, in pieces, by the sum over its n-grams; texts without a letter and nulls get the default.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 1 << 16
_PIECE = 1 << 20
_FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _grams(text: str) -> np.ndarray:
    """Buckets of all n-grams of a text in lower case, whatever isn't a letter being one blank."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = np.array([chr(c).isalpha() for c in np.unique(points).tolist()], bool)
    points = np.where(letters[np.searchsorted(np.unique(points), points)], points, 32)
    points = points[np.concatenate([[True], (points[1:] != 32) | (points[:-1] != 32)])].astype(np.uint64)
    if len(points) < 3:
        return np.zeros(0, np.int64)
    mixed = [points * f for f in _FACTORS]
    found = [points[points != 32] * _FACTORS[0]]
    found += [mixed[1][:-1] + mixed[0][1:], mixed[2][:-2] + mixed[1][1:-1] + mixed[0][2:]]
    flat = np.concatenate(found)
    return ((flat ^ flat >> np.uint64(29)) * _FACTORS[2] >> np.uint64(48)).astype(np.int64)


def _counts(text: str) -> np.ndarray:
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(text), _PIECE):
        total += np.bincount(_grams(text[at : at + _PIECE]), minlength=BUCKETS)
    return total


@dataclass
class LanguageModel:
    """Log-probabilities (languages, buckets)."""

    languages: tuple[str, ...]
    weights: np.ndarray

    def detect(self, text: str | None, default: str, supported: frozenset[str] | None = None) -> str:
        """The likeliest language; the default for texts without a letter, or where the likeliest one isn't supported."""
        if not text or not self.languages:
            return default
        scores = np.zeros(len(self.languages))
        seen = 0
        for at in range(0, len(text), _PIECE):
            grams = _grams(text[at : at + _PIECE])
            seen += len(grams)
            for begin in range(0, len(grams), 1 << 16):
                scores += self.weights[:, grams[begin : begin + (1 << 16)]].sum(axis=1, dtype=np.float64)
        best = self.languages[int(scores.argmax())] if seen else default
        return best if supported is None or best in supported else default

    def column(self, spark, default: str, supported: tuple[str, ...] | None = None):
        """Column function text -> language."""
        shared = spark.sparkContext.broadcast(self)
        allowed = frozenset(supported) if supported is not None else None

        @F.pandas_udf(T.StringType())
        def run(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: shared.value.detect(t if isinstance(t, str) else None, default, allowed))

        return run


def train(df: DataFrame, text: str, language: str) -> LanguageModel:
    """Counts over all labelled rows: a task adds up its own, so that one small row a language leaves it."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, code in zip(batch["t"], batch["code"], strict=True):
                sums[code] = sums.get(code, 0) + _counts(t)
        for code, total in sums.items():
            used = np.flatnonzero(total)
            yield pd.DataFrame({"code": code, "bucket": used, "n": total[used]})

    rows = df.select(F.col(text).alias("t"), F.col(language).alias("code")).where("t is not null and code is not null")
    table = rows.mapInPandas(count, "code string, bucket long, n long").groupBy("code", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(table["code"].unique().tolist()))
    weights = np.full((len(languages), BUCKETS), 0.5)
    for k, code in enumerate(languages):
        own = table[table["code"] == code]
        weights[k, own["bucket"].to_numpy()] += own["n"].to_numpy()
    return LanguageModel(languages, np.log(weights / weights.sum(axis=1, keepdims=True)).astype(np.float32) if languages else weights.astype(np.float32))
