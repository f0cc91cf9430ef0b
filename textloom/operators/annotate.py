"""Annotators per language: rule-based tokens, sentences and markup removal; taggers are plug-ins."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.text import piecewise

#: Rows of a batch that are Python objects at once.
ROWS = 256
_TOKEN = re.compile(r"\w+(?:['’]\w+)?|[^\w\s]")
_SENTENCE = re.compile(r"[^.!?]+(?:[.!?]+(?=\s|$)|$)|[^.!?]*[.!?]+")
_TAG = re.compile(r"<[^>]*>")

Annotate = Callable[[str], list[str] | None]


def tokenize(text: str) -> list[str]:
    return _TOKEN.findall(text)


def split_sentences(text: str) -> list[str]:
    return [s.strip() for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()]


def clean_xml(text: str) -> list[str]:
    return tokenize(html.unescape(_TAG.sub(" ", text)))


@dataclass(frozen=True)
class Annotator:
    """One output column; ``needs`` names annotators that have to run before it."""

    name: str
    column: str
    run: Annotate | None = None
    needs: tuple[str, ...] = ()


BUILT_IN = {
    "tokenize": Annotator("tokenize", "corenlpTokens", tokenize),
    "cleanxml": Annotator("cleanxml", "cleanxml", clean_xml),
    "ssplit": Annotator("ssplit", "sentences", split_sentences, ("tokenize",)),
}
_REQUIRED = {"pos": ("tokenize", "ssplit"), "lemma": ("pos",), "ner": ("pos", "lemma"), "sentiment": ("tokenize", "ssplit"), "depparse": ("pos",)}


class Annotators:
    """Registry of annotators; what isn't built in (pos, lemma, ner, sentiment, depparse) is registered with a function."""

    def __init__(self) -> None:
        self.known = dict(BUILT_IN)

    def register(self, name: str, run: Annotate, column: str | None = None, needs: tuple[str, ...] | None = None) -> None:
        self.known[name] = Annotator(name, column or name, run, _REQUIRED.get(name, ()) if needs is None else needs)

    def get(self, name: str) -> Annotator:
        if name not in self.known:
            raise ValueError(f"no annotator {name!r}; register one")
        return self.known[name]

    def closure(self, names: list[str]) -> list[str]:
        """The names with all they need, each after what it needs."""
        done: list[str] = []

        def visit(name: str, path: tuple[str, ...]) -> None:
            if name in path:
                raise ValueError(f"annotators need each other: {' > '.join((*path, name))}")
            for need in (self.known[name].needs if name in self.known else _REQUIRED.get(name, ())):
                visit(need, (*path, name))
            if name not in done:
                done.append(name)

        for n in names:
            visit(n, ())
        return done

    def check_order(self, names: list[str]) -> None:
        for i, n in enumerate(names):
            lacking = set(self.get(n).needs) - set(names[:i])
            if lacking:
                raise ValueError(f"{n} needs {sorted(lacking)} before it")

    def udf(self, name: str):
        """Column function text -> array<string> of one annotator."""
        on_arrays = piecewise(self.get(name).run, T.ArrayType(T.StringType()))

        @F.arrow_udf(T.ArrayType(T.StringType()))
        def annotate(texts: pa.Array) -> pa.Array:
            return on_arrays(texts)

        return annotate


@dataclass
class LanguagePipelines:
    """Annotators by language, merged to one schema: a column a language has no annotator for is null there."""

    annotators: Annotators
    by_language: dict[str, list[str]]
    default_language: str
    columns: list[str] = field(init=False)

    def __post_init__(self) -> None:
        if self.default_language not in self.by_language:
            raise ValueError("the default language has no pipeline")
        for names in self.by_language.values():
            for n in names:
                self.annotators.get(n)
        self.columns = list(dict.fromkeys(self.annotators.get(n).column for names in self.by_language.values() for n in names))

    def local(self, row: dict, text: str, language: str, prefix: str) -> dict:
        code = row.get(language) if row.get(language) in self.by_language else self.default_language
        own = {self.annotators.get(n).column: self.annotators.get(n).run for n in self.by_language[code]}
        value = row.get(text)
        return row | {f"{prefix}__{c}": own[c](value) if c in own and isinstance(value, str) else None for c in self.columns}

    def transform(self, df: DataFrame, text: str, language: str, prefix: str) -> DataFrame:
        """Adds ``prefix__column`` arrays; rows of an unknown language go the default one's way."""
        for c in self.columns:
            if f"{prefix}__{c}" in df.columns:
                raise ValueError(f"column {prefix}__{c} exists")
        out = T.StructType([T.StructField(c, T.ArrayType(T.StringType())) for c in self.columns])
        # the built-in ones and whatever was registered travel with the closure
        plans = {code: [(self.annotators.get(n).column, self.annotators.get(n).run) for n in names] for code, names in self.by_language.items()}
        default, columns = self.default_language, self.columns

        words = pa.list_(pa.string())

        def annotated(texts: list, codes: list) -> pa.Array:
            found: dict[str, list] = {c: [None] * len(texts) for c in columns}
            for i, (t, code) in enumerate(zip(texts, codes, strict=True)):
                if t is not None:
                    for column, annotate in plans.get(code) or plans[default]:
                        found[column][i] = annotate(t)
            return pa.StructArray.from_arrays([pa.array(found[c], words) for c in columns], columns)

        @F.arrow_udf(out)
        def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for texts, codes in batches:  # some rows at a time are Python objects
                parts = [annotated(texts.slice(i, ROWS).to_pylist(), codes.slice(i, ROWS).to_pylist()) for i in range(0, len(texts), ROWS)]
                yield pa.concat_arrays(parts or [annotated([], [])])

        made: Column = run(F.col(text), F.col(language))
        return df.withColumn("_annotated", made).select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"_annotated.{c}").alias(f"{prefix}__{c}") for c in columns])
