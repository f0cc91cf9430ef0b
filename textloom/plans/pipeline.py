"""Pipelines of named stages over column families, on DataFrames or, without a job, on lists of dictionaries."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom import config
from textloom.functions import language as L
from textloom.functions import text as X
from textloom.functions import urls as U
from textloom.functions.geo import distance_score, min_distance_km
from textloom.functions.vectors import boosted, similarity
from textloom.operators import scoring
from textloom.operators.text import with_clean_text
from textloom.plans.columns import AggregatedColumns, DistanceColumns, LocationColumns, SimilarityColumns, TextColumns, UrlColumns

Rows = list[dict]


@dataclass
class Stage:
    """One step: the columns it reads by parameter, the one it writes, and how."""

    name: str
    inputs: dict[str, str | list[str]]
    output: str
    apply: Callable[[DataFrame], DataFrame]
    local: Callable[[dict], object] | None = None
    #: Inputs that parameter names don't give away as columns.
    unnamed: tuple[str, ...] = ()

    def required(self, strict: bool = True) -> list[str]:
        found: list[str] = []
        for key, value in self.inputs.items():
            if strict or key not in self.unnamed:
                found += [value] if isinstance(value, str) else value
        return found

    def transform(self, df: DataFrame) -> DataFrame:
        if self.output in df.columns:
            raise ValueError(f"{self.name}: column {self.output!r} exists")
        lacking = [c for c in self.required() if c not in df.columns]
        if lacking:
            raise ValueError(f"{self.name}: no columns {lacking}")
        return self.apply(df)


class Pipeline:
    def __init__(self, stages: list[Stage]):
        self.stages = stages

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.transform(df)

    def transform(self, df: DataFrame) -> DataFrame:
        for stage in self.stages:
            df = stage.transform(df)
        return df

    def fit(self, data: DataFrame | Rows) -> Pipeline | LocalPipeline:
        """Stages aren't trained; for rows it gives the form that runs on the driver."""
        return LocalPipeline(self.stages) if isinstance(data, list) else self

    @property
    def added(self) -> list[str]:
        return [s.output for s in self.stages]


class LocalPipeline:
    def __init__(self, stages: list[Stage]):
        without = [s.name for s in stages if s.local is None]
        if without:
            raise ValueError(f"stages without a local form: {without}")
        self.stages = stages

    def transform(self, rows: Rows) -> Rows:
        made = []
        for row in rows:
            row = dict(row)
            for s in self.stages:
                row[s.output] = s.local(row)
            made.append(row)
        return made


def required_columns(wanted: list[str], provided: list[str], stages: list[Stage], strict: bool = True) -> list[str]:
    """What has to be selected: the wanted columns and all that stages read, less what is provided or made by a stage.

    Not ``strict`` leaves out inputs whose parameter isn't named like a column, as callers may still expect.
    """
    made = {*provided, *(s.output for s in stages)}
    need = [*wanted, *(c for s in stages for c in s.required(strict))]
    return list(dict.fromkeys(c for c in need if c not in made))


# stages --


@dataclass
class Settings:
    """What stages need besides columns: dictionaries, places, resolvers."""

    supported: tuple[str, ...] = config.SUPPORTED_LANGUAGES
    default_language: str = config.DEFAULT_LANGUAGE
    boosts: dict[str, float] = field(default_factory=config.default_boosts)
    acronyms: dict[str, str] = field(default_factory=X.builtin_acronyms)
    stop_languages: tuple[str, ...] = tuple(X.STOP_WORD_LANGUAGES)
    dictionary: object = None
    gazetteer: DataFrame | None = None
    url_resolver: Callable[[], Callable[[str], str | None]] = U.http_resolver
    #: A trained ``functions.trained_language.LanguageModel``; without one, languages are told by script and stop words.
    language_model: object = None
    spark: object = None


def local_clean(text: str | None, acronyms: dict[str, str] | None) -> str | None:
    """The cleaning rules on the driver, for single records."""
    if text is None:
        return None
    import regex

    for _, pattern, new in X.RULES:
        text = regex.sub(pattern, re.sub(r"\$(\d)", r"\\\1", new), text)
    if acronyms and regex.search(r"[\p{L}--\p{Lu}]", text, regex.V1):
        for a in sorted(acronyms):
            text = regex.sub(rf"(^|[ \t\n\x0b\f\r]){re.escape(a)}($|[ \t\n\x0b\f\r!-/:-@\[-`{{-~])", lambda m, e=acronyms[a]: m[1] + e + m[2], text)
    return text


def _clean(c: TextColumns, s: Settings, acronyms: bool = True) -> Stage:
    table = s.acronyms if acronyms else None
    return Stage("TextCleaner" if acronyms else "TextCleanerWithoutAcronyms", {"inputCol": c.text}, c.clean, lambda df: with_clean_text(df, c.text, c.clean, table), lambda r: local_clean(r.get(c.text), table))


def local_language(text: str | None, supported: tuple[str, ...], default: str) -> str:
    import regex

    lowered = (text or "").lower()
    if not lowered:
        return default
    words = regex.split(r"[^\p{L}\p{N}]+", lowered)
    codes = sorted(set(supported))
    hits = [(sum(w in set(X.stop_words(k)) for w in words), -i, k) for i, k in enumerate(k for k in codes if k in X.STOP_WORD_LANGUAGES and k != "ru")]
    best = max(hits, default=(0, 0, default))
    if best[0] > 0:
        return best[2]
    for code, letters in L._SCRIPTS:
        if code in codes and regex.search(letters.replace(r"\p{Is", r"\p{Script="), lowered):
            return code
    return default


def _language(c: TextColumns, s: Settings) -> Stage:
    if s.language_model is not None:
        allowed = frozenset(s.supported)
        detect = lambda df: df.withColumn(c.language, s.language_model.column(df.sparkSession, s.default_language, s.supported)(F.col(c.text)))
        return Stage("LanguageDetector", {"inputCol": c.text}, c.language, detect, lambda r: s.language_model.detect(r.get(c.text), s.default_language, allowed))
    return Stage("LanguageDetector", {"inputCol": c.text}, c.language, lambda df: df.withColumn(c.language, L.detect_language(F.col(c.text), s.supported, s.default_language)), lambda r: local_language(r.get(c.text), s.supported, s.default_language))


def _tokenizer(c: TextColumns, s: Settings) -> Stage:
    import regex

    def local(r: dict):
        text = r.get(c.clean)
        return None if text is None else [t for t in regex.split(r"[^\p{Lu}\p{Ll}0-9]", text) if len(t) >= 2]

    return Stage("Tokenizer", {"inputCol": c.clean}, c.tokens, lambda df: df.withColumn(c.tokens, X.tokens(F.col(c.clean))), local)


def _stop_words(c: TextColumns, s: Settings) -> Stage:
    lists = X.stop_word_map(s.stop_languages)

    def local(r: dict):
        words, code = r.get(c.tokens), r.get(c.language)
        if words is None or code is None:
            return None
        own = {w.lower() for w in lists.get(code, lists[s.default_language])}
        return [w for w in words if w.lower() not in own]

    return Stage("StopWordsRemover", {"inputCol": c.tokens, "languageCol": c.language}, c.words, lambda df: df.withColumn(c.words, X.remove_stop_words(F.col(c.tokens), F.col(c.language), lists, s.default_language)), local)


def _embed(c: TextColumns, s: Settings) -> Stage:
    def local(r: dict):
        import numpy as np

        if r.get(c.words) is None or r.get(c.language) is None:
            return None
        code = r[c.language] if r[c.language] in s.dictionary.supported else s.dictionary.default
        names = [w.lower() for w in r[c.words]]
        table = s.dictionary.table.where((F.col("lang") == code) & F.col("word").isin(*names)) if names else None
        known = {x["word"]: np.array(x["vector"], float) for x in table.collect()} if names else {}
        total = sum((known[w] for w in names if w in known), np.zeros(s.dictionary.dim))
        norm = float(np.sqrt((total * total).sum()))
        return (total / norm if norm else total).tolist()

    return Stage("EmbeddingsModel", {"inputCol": c.words, "languageCol": c.language}, c.vector, lambda df: s.dictionary.embed(df, c.language, c.words, c.vector), local)


def _bag(c: TextColumns, s: Settings) -> Stage:
    def local(r: dict):
        words = r.get(c.tokens)
        return None if words is None else [(w, words.count(w)) for w in dict.fromkeys(words)]

    return Stage("NormalizedBagOfWords", {"inputCol": c.tokens}, c.bag, lambda df: df.withColumn(c.bag, X.bag_of_words(F.col(c.tokens))), local)


def _similarity(c: SimilarityColumns, s: Settings) -> Stage:
    return Stage("SimilarityScorer", {"inputCol": c.varying.vector, "baseVectorCol": c.base.vector}, c.similarity, lambda df: df.withColumn(c.similarity, similarity(F.col(c.base.vector), F.col(c.varying.vector))))


def _wmd(c: SimilarityColumns, s: Settings) -> Stage:
    from textloom.operators.wmd import with_distance

    inputs = {"inputCol": c.varying.bag, "languageCol": c.varying.language, "baseDocumentCol": c.base.bag, "baseLanguageCol": c.base.language}
    return Stage("WordMoverDistance", inputs, c.similarity, lambda df: with_distance(df, s.dictionary.table, c.base.bag, c.base.language, c.varying.bag, c.varying.language, c.similarity))


def _booster(c: SimilarityColumns, s: Settings) -> Stage:
    inputs = {"inputCol": c.similarity, "languageCol": c.varying.language, "baseLanguageCol": c.base.language}
    return Stage("OtherLanguageBooster", inputs, c.score, lambda df: df.withColumn(c.score, boosted(F.col(c.similarity), F.col(c.base.language), F.col(c.varying.language), s.boosts)))


def _places(c: LocationColumns, s: Settings) -> Stage:
    from textloom.operators.places import fetch_coordinates

    return Stage("CoordinatesFetcher", {"locationCol": c.location}, c.coordinates, lambda df: fetch_coordinates(df, s.gazetteer, c.location, c.coordinates, c.country))


def _distance(c: DistanceColumns, s: Settings) -> Stage:
    inputs = {"inputCol": c.a.coordinates, "baseLocation": c.b.coordinates}

    def apply(df: DataFrame) -> DataFrame:
        base = F.col(c.b.coordinates)
        base = base if df.schema[c.b.coordinates].dataType.typeName() == "array" else F.array(base)
        return df.withColumn(c.distance, min_distance_km(base, F.col(c.a.coordinates)))

    return Stage("DistanceCalculator", inputs, c.distance, apply, unnamed=("baseLocation",))


def _distance_score(c: DistanceColumns, s: Settings) -> Stage:
    inputs = {"inputCol": c.distance, "distanceFactor": c.factor}
    return Stage("DistanceScorer", inputs, c.score, lambda df: df.withColumn(c.score, distance_score(F.col(c.distance), F.col(c.factor))), unnamed=("distanceFactor",))


def _aggregator(how: str):
    return lambda c, s: Stage(f"ColumnAggregator{how.title()}", {"inputCols": c.scores}, c.output, lambda df: scoring.aggregate_columns(df, c.scores, c.output, how))


def _weigher(c: AggregatedColumns, s: Settings) -> Stage:
    return Stage("LinearWeigher", {"inputCols": c.scores, "linearWeightsCol": c.weights}, c.output, lambda df: scoring.weigh_columns(df, c.scores, c.weights, c.output))


def _latin(c: UrlColumns, s: Settings) -> Stage:
    def apply(df: DataFrame) -> DataFrame:
        from textloom.functions.translit import transliterator

        return df.withColumn(c.latin, transliterator(df.sparkSession, "Emoji-Remover; Any-Latin; Latin-ASCII")(F.col(c.text)))

    return Stage("URLAllLatin", {"inputCol": c.text}, c.latin, apply)


def _detect(c: UrlColumns, s: Settings) -> Stage:
    return Stage("URLDetector", {"inputCol": c.latin}, c.urls, lambda df: df.withColumn(c.urls, U.detect_urls(F.col(c.latin))))


def _validate(c: UrlColumns, s: Settings) -> Stage:
    return Stage("URLValidator", {"inputCol": c.urls}, c.valid, lambda df: df.withColumn(c.valid, U.valid_urls(F.col(c.urls))))


def _expand(c: UrlColumns, s: Settings) -> Stage:
    return Stage("URLExpander", {"inputCol": c.urls}, c.expanded, lambda df: df.withColumn(c.expanded, U.expand_urls(s.url_resolver)(F.col(c.urls))))


#: Every stage by its name; add your own.
STAGES: dict[str, Callable[[object, Settings], Stage]] = {
    "LanguageDetector": _language, "TextCleaner": _clean, "TextCleanerWithoutAcronyms": lambda c, s: _clean(c, s, False), "Tokenizer": _tokenizer, "StopWordsRemover": _stop_words, "EmbeddingsModel": _embed,
    "NormalizedBagOfWords": _bag, "SimilarityScorer": _similarity, "OtherLanguageBooster": _booster, "WordMoverDistance": _wmd, "CoordinatesFetcher": _places, "DistanceCalculator": _distance, "DistanceScorer": _distance_score,
    "ColumnAggregatorMax": _aggregator("max"), "ColumnAggregatorMin": _aggregator("min"), "ColumnAggregatorSum": _aggregator("sum"), "ColumnAggregatorMean": _aggregator("mean"), "LinearWeigher": _weigher,
    "URLAllLatin": _latin, "URLDetector": _detect, "URLValidator": _validate, "URLExpander": _expand,
}

TEXT_PREPROCESSING = ("LanguageDetector", "TextCleaner", "Tokenizer", "StopWordsRemover", "EmbeddingsModel")
TEXT_SCORING = ("SimilarityScorer", "OtherLanguageBooster")
DISTANCE_SCORING = ("DistanceCalculator", "DistanceScorer")
URL_PROCESSING = ("URLAllLatin", "URLDetector", "URLExpander")


@dataclass
class PipelineInput:
    """Column families and the stages each goes through."""

    columns: list
    stages: tuple[str, ...]


def build(inputs: list[PipelineInput], settings: Settings | None = None) -> Pipeline:
    """Stages in the order of the inputs, then of their stages, then of their columns."""
    settings = settings or Settings()
    unknown = [n for i in inputs for n in i.stages if n not in STAGES]
    if unknown:
        raise ValueError(f"no stages {unknown}")
    return Pipeline([STAGES[name](c, settings) for i in inputs for name in i.stages for c in i.columns])


def udf_stage(name: str, input_col: str, output_col: str, function: Callable, return_type) -> Stage:
    """A stage from a Python function of one value; it runs in Arrow batches, of which few values are Python objects at once."""

    def transform(df: DataFrame) -> DataFrame:
        kind = T._parse_datatype_string(return_type) if isinstance(return_type, str) else return_type
        if any(isinstance(t, (T.TimestampType, T.TimestampNTZType)) for t in (kind, df.schema[input_col].dataType)):
            # pandas has them in the session's zone

            @F.pandas_udf(kind)
            def run(values: pd.Series) -> pd.Series:
                return values.map(lambda v: None if v is None else function(v))

        else:
            on_arrays = X.piecewise(function, kind)

            @F.arrow_udf(kind)
            def run(values: pa.Array) -> pa.Array:
                return on_arrays(values)

        return df.withColumn(output_col, run(F.col(input_col)))

    return Stage(name, {"inputCol": input_col}, output_col, transform, lambda r: None if r.get(input_col) is None else function(r[input_col]))


def word_count_stage(c: TextColumns) -> Stage:
    return Stage("WordCounter", {"inputCol": c.text}, c.score, lambda df: df.withColumn(c.score, X.word_count(F.col(c.text))), lambda r: None if r.get(c.text) is None else len(r[c.text].rstrip(" ").split(" ")) if r[c.text].rstrip(" ") or not r[c.text] else 0)
