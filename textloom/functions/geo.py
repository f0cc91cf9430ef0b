"""Geographic functions as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
UNKNOWN_KM = 100_000.0


def coordinates(latitude: Column, longitude: Column) -> Column:
    return F.struct(latitude.cast("double").alias("latitude"), longitude.cast("double").alias("longitude"))


def haversine_km(a: Column, b: Column) -> Column:
    """Great-circle kilometres between two coordinate structs; 100,000 where one is missing."""
    lat_a, lat_b = F.radians(a["latitude"]), F.radians(b["latitude"])
    half_lat, half_lon = (lat_b - lat_a) / 2, (F.radians(b["longitude"]) - F.radians(a["longitude"])) / 2
    h = F.pow(F.sin(half_lat), 2) + F.cos(lat_a) * F.cos(lat_b) * F.pow(F.sin(half_lon), 2)
    h = F.when(h > 1, F.lit(1.0)).otherwise(h)
    return F.coalesce((2 * EARTH_KM * F.atan2(F.sqrt(h), F.sqrt(1 - h))).cast("float"), F.lit(UNKNOWN_KM).cast("float"))


def min_distance_km(bases: Column, place: Column) -> Column:
    """Least distance from a place to an array of places; an empty array is an error."""
    return F.when(F.size(bases) == 0, F.raise_error(F.lit("no base location")).cast("float")).otherwise(F.array_min(F.transform(bases, lambda b: haversine_km(b, place))))


def distance_score(distance: Column, factor: Column) -> Column:
    """1 - tanh(factor * distance), in single precision."""
    return (1 - F.tanh(factor.cast("double") * distance.cast("double"))).cast("float")


#: English names of countries by ISO code.
COUNTRIES = dict(
    pair.split("=")
    for pair in "AT=Austria;AU=Australia;BE=Belgium;BG=Bulgaria;BR=Brazil;CA=Canada;CH=Switzerland;CL=Chile;CN=China;CZ=Czechia;DE=Germany;DK=Denmark;EE=Estonia;EG=Egypt;ES=Spain;FI=Finland;FR=France;GB=United Kingdom;GR=Greece;HR=Croatia;HU=Hungary;IE=Ireland;IL=Israel;IN=India;IS=Iceland;IT=Italy;JP=Japan;KR=South Korea;LT=Lithuania;LU=Luxembourg;LV=Latvia;MA=Morocco;MX=Mexico;NL=Netherlands;NO=Norway;NZ=New Zealand;PL=Poland;PT=Portugal;RO=Romania;RS=Serbia;RU=Russia;SE=Sweden;SI=Slovenia;SK=Slovakia;TR=Türkiye;UA=Ukraine;US=United States;VN=Vietnam;ZA=South Africa".split(";")
)


def country_name(code: Column) -> Column:
    """English name of a two-letter code in any case, else null."""
    table = F.create_map(*[F.lit(x) for pair in sorted(COUNTRIES.items()) for x in pair])
    return F.try_element_at(table, F.upper(code))
