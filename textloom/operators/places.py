"""Coordinates of places from a gazetteer table (place, country, latitude, longitude)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fetch_coordinates(df: DataFrame, gazetteer: DataFrame, place: str, output: str, country: str | None = None) -> DataFrame:
    """Adds a struct of latitude and longitude; (0, 0) for a null or unknown place. The country counts only if that column is there. The join's kind follows the gazetteer's size."""
    names = gazetteer.select(F.lower("place").alias("_place"), F.lower("country").alias("_country"), "latitude", "longitude")
    if country and country in df.columns:
        at = names.groupBy("_place", "_country").agg(F.min(F.struct("latitude", "longitude")).alias("_at"))
        joined = df.join(at, (F.lower(place) == F.col("_place")) & F.lower(country).eqNullSafe(F.col("_country")), "left")
    else:
        at = names.groupBy("_place").agg(F.min(F.struct("latitude", "longitude")).alias("_at"))
        joined = df.join(at, F.lower(place) == F.col("_place"), "left")
    zero = F.struct(F.lit(0.0).alias("latitude"), F.lit(0.0).alias("longitude"))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce("_at", zero).alias(output))


def distinct_places(frames: list[tuple[DataFrame, str, str | None]]) -> DataFrame:
    """Distinct (place, country) of many frames."""
    parts = [df.select(F.col(p).alias("place"), (F.col(c) if c and c in df.columns else F.lit(None).cast("string")).alias("country")) for df, p, c in frames]
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    return found.where("place is not null").distinct()


def fill_gazetteer(frames: list[tuple[DataFrame, str, str | None]], gazetteer: DataFrame, resolver: Callable[[], Callable[[str, str | None], tuple[float, float] | None]]) -> DataFrame:
    """The gazetteer with the places it lacks, asked for through ``resolver()`` in parallel tasks; (0, 0) for what isn't found."""
    missing = distinct_places(frames).alias("m").join(gazetteer.select(F.lower("place").alias("p"), F.lower("country").alias("c")), (F.lower("m.place") == F.col("p")) & F.lower("m.country").eqNullSafe(F.col("c")), "left_anti")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = resolver()
        for batch in batches:
            at = [find(p, c) or (0.0, 0.0) for p, c in zip(batch["place"], batch["country"], strict=True)]
            yield batch.assign(latitude=[a for a, _ in at], longitude=[b for _, b in at])

    found = missing.mapInPandas(ask, "place string, country string, latitude double, longitude double")
    return gazetteer.select("place", "country", "latitude", "longitude").unionByName(found)


def http_geocoder(url: str, timeout: float = 5.0) -> Callable[[], Callable[[str, str | None], tuple[float, float] | None]]:
    """A resolver that posts ``{"name", "country"}`` to a service and reads latitude and longitude from its answer."""

    def make():
        import json
        import urllib.request

        def find(place: str, country: str | None):
            body = json.dumps({"name": place, "country": country}).encode()
            request = urllib.request.Request(url, data=body, headers={"Content-Type": "application/json"})
            try:
                with urllib.request.urlopen(request, timeout=timeout) as answer:
                    found = json.load(answer)
                    return float(found["latitude"]), float(found["longitude"])
            except (OSError, ValueError, KeyError, TypeError):
                return None

        return find

    return make
