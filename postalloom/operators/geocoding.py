"""Geocoding as joins: providers are tables or table functions, keys are looked up once."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postalloom.functions import geo, similarity

RESULT = "latitude double, longitude double, formatted_address string, province string, city string, district string, street string, street_number string, confidence double, source string, ts double"
RESULT_FIELDS = tuple(x.split(" ")[0] for x in RESULT.split(", "))


class Geocoder(Protocol):
    name: str

    def lookup(self, keys: DataFrame) -> DataFrame:
        """(key, RESULT fields) for those of the distinct ``keys`` (key) that are found."""


class NullGeocoder:
    """Finds nothing; the default where no provider is at hand."""

    name = "none"

    def lookup(self, keys: DataFrame) -> DataFrame:
        return keys.where("false").select("key", *[F.lit(None).cast(kind).alias(n) for n, kind in (x.split(" ") for x in RESULT.split(", "))])


class TableGeocoder:
    """A dimension of known addresses (key and any RESULT fields). Keys are trimmed and lower-cased; the first row of a key counts."""

    def __init__(self, table: DataFrame, name: str = "table"):
        self.name = name
        have = [c for c in RESULT_FIELDS if c in table.columns]
        keyed = table.withColumn("key", F.lower(F.btrim("key")))
        self.table = keyed.groupBy("key").agg(F.min(F.struct(*have)).alias("_r")).select("key", *[F.col(f"_r.{c}").alias(c) for c in have])

    def lookup(self, keys: DataFrame) -> DataFrame:
        kinds = dict(x.split(" ") for x in RESULT.split(", "))
        known = [F.col(c) if c in self.table.columns else F.lit(None).cast(kinds[c]).alias(c) for c in RESULT_FIELDS]
        return keys.join(self.table, "key").select("key", *known)


def geocoded(df: DataFrame, column: str, *providers: Geocoder, into: str = "geo_info") -> DataFrame:
    """``df`` with a struct of the first provider's result that is found, null for null and blank text.

    Distinct texts are looked up once each, in place of a cache.
    """
    key = F.lower(F.btrim(F.col(column)))
    keys = df.select(key.alias("key")).where("key <> ''").distinct()
    out = df.withColumn("_key", key)
    found = []
    for i, provider in enumerate(providers or (NullGeocoder(),)):
        fields = [F.lit(provider.name).alias("source") if c == "source" else F.col(c) for c in RESULT_FIELDS]
        hits = provider.lookup(keys).select(F.col("key").alias(f"_k{i}"), F.struct(*fields).alias(f"_g{i}"))
        out = out.join(hits, F.col("_key") == F.col(f"_k{i}"), "left")
        found.append(F.col(f"_g{i}"))
    return out.select(*[F.col(c) for c in df.columns if c != into], F.coalesce(*found).alias(into))


def with_coordinates(df: DataFrame, offline: str | None, info: str = "geo_info", faithful: bool = False) -> DataFrame:
    """``df`` with lat and lon: from the offline document, else from the geocoder, each time as a pair."""
    points = [geo.offline_point(F.col(offline), faithful)] if offline else []
    points.append(F.struct(F.col(f"{info}.latitude").alias("lat"), F.col(f"{info}.longitude").alias("lon")))
    return df.withColumn("_point", geo.first_pair(*points)).withColumns({"lat": F.col("_point.lat"), "lon": F.col("_point.lon")}).drop("_point")


def user_coordinates(df: DataFrame, lon: str, lat: str) -> DataFrame:
    """Given columns as coordinates; what is no number, or not both, is null."""
    x, y = F.col(lon).try_cast("double"), F.col(lat).try_cast("double")
    both = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    return df.withColumns({"_x": F.when(both, x), "_y": F.when(both, y)}).withColumns({"lon": F.col("_x"), "lat": F.col("_y")}).drop("_x", "_y")


def geocode_stats(df: DataFrame, info: str = "geo_info") -> DataFrame:
    """One row: total, found, distinct keys asked, and the rate of hits among all requests, never above 1."""
    found = F.col(info).isNotNull()
    return df.agg(F.count("*").alias("total"), F.count_if(found).alias("found"), F.coalesce(F.avg(found.cast("int")), F.lit(0.0)).alias("success_rate"))


def source_stats(df: DataFrame, info: str = "geo_info") -> DataFrame:
    return df.groupBy(F.col(f"{info}.source").alias("source")).agg(F.count("*").alias("n"))


def segments(text: Column, n: int = 2) -> Column:
    """Character n-grams in order, in place of a provider's segmentation; none for null and short texts."""
    return F.when(F.char_length(text) >= n, F.transform(F.sequence(F.lit(1), F.char_length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def address_similarity(a: Column, b: Column) -> Column:
    """A provider-free similarity of two addresses: Jaccard of their character pairs; 0 for null."""
    return similarity.ngram_jaccard(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")), 2)
