"""Families of column names: what stages read and write follows from the names of the inputs."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

SEP = "__"


class Scored(Protocol):
    @property
    def score(self) -> str: ...


@dataclass(frozen=True)
class TextColumns:
    """A text column and what is derived from it."""

    text: str

    def __getattr__(self, part: str) -> str:
        own = {"language": "language", "clean": "clean", "tokens": "tokens", "words": "words", "vector": "vector", "score": "score", "pos": "pos", "lemma": "lemma", "ner": "ner", "annotated_tokens": "corenlpTokens", "bag": "nBOW"}
        if part in own:
            return f"{self.text}{SEP}{own[part]}"
        raise AttributeError(part)


@dataclass(frozen=True)
class SimilarityColumns:
    """A base text that others are compared with."""

    base: TextColumns
    varying: TextColumns

    @property
    def similarity(self) -> str:
        return f"{self.base.vector}{SEP}similarity{SEP}{self.varying.vector}"

    @property
    def score(self) -> str:
        return f"{self.base.vector}{SEP}score{SEP}{self.varying.vector}"


@dataclass(frozen=True)
class UrlColumns:
    text: str

    @property
    def latin(self) -> str:
        return f"{self.text}{SEP}allLatin"

    @property
    def urls(self) -> str:
        return f"{self.text}{SEP}urls"

    @property
    def valid(self) -> str:
        return f"{self.text}{SEP}valid"

    @property
    def expanded(self) -> str:
        return f"{self.text}{SEP}expanded"

    @property
    def score(self) -> str:
        return f"{self.text}{SEP}score"


@dataclass(frozen=True)
class LocationColumns:
    """``compat`` keeps the braces that the score's name has always had."""

    location: str
    country: str | None = None
    compat: bool = True

    @property
    def coordinates(self) -> str:
        return f"{self.location}{SEP}coords"

    @property
    def score(self) -> str:
        return f"{{{self.location}}}{SEP}score" if self.compat else f"{self.location}{SEP}score"


@dataclass(frozen=True)
class DistanceColumns:
    a: LocationColumns
    b: LocationColumns

    def _between(self, what: str) -> str:
        return f"{self.a.location}{SEP}{what}{SEP}{self.b.location}"

    @property
    def distance(self) -> str:
        return self._between("distance")

    @property
    def factor(self) -> str:
        return self._between("distanceFactor")

    @property
    def score(self) -> str:
        return self._between("score")


@dataclass(frozen=True)
class AggregatedColumns:
    output: str
    inputs: tuple[Scored, ...]

    @property
    def score(self) -> str:
        return self.output

    @property
    def scores(self) -> list[str]:
        return [c.score for c in self.inputs]

    @property
    def weights(self) -> str:
        return SEP.join([*self.scores, "linearWeights"])
