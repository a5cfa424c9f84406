"""Whole runs: from addresses to groups, in full, from a file, or incrementally."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postalloom.config import EngineConfig
from postalloom.functions import geo, text
from postalloom.functions.parse import AdminParser, SuffixParser
from postalloom.operators import blocking, clustering, geocoding, incremental, metrics, scoring
from postalloom.operators.ordering import numbered
from postalloom.plans.lineage import cut
from postalloom.sources import sinks, tables


@dataclass
class Outcome:
    addresses: DataFrame
    scores: DataFrame
    labels: DataFrame

    def report(self, config: EngineConfig | None = None) -> dict[str, DataFrame]:
        return metrics.report(self.labels, self.addresses, self.scores, config)


def prepared(rows: DataFrame, column: str, parser: AdminParser | None = None, geocoders: tuple = (), offline: str | None = None, config: EngineConfig | None = None) -> DataFrame:
    """Rows (id and an address column) normalised, parsed and placed: the working set of all operators."""
    named = text.normalized(rows, column, parser or SuffixParser(), config)
    placed = geocoding.with_coordinates(geocoding.geocoded(named, "standardized", *geocoders), offline, faithful=(config or EngineConfig()).faithful) if not {"lat", "lon"} <= set(rows.columns) else named
    parts = [F.coalesce(F.col(f"parsed.{c}"), F.lit("")).alias(c) for c in ("province", "city", "district", "street") if c not in placed.columns]
    return placed.select("*", *parts)


def cluster(addresses: DataFrame, config: EngineConfig | None = None) -> Outcome:
    """Candidates, scores and groups of a working set."""
    settings = config or EngineConfig()
    addresses = cut(addresses)
    scores = cut(scoring.scored(blocking.candidates(addresses, settings, settings.similarity_threshold), addresses, settings, settings.similarity_threshold))
    return Outcome(addresses, scores, clustering.resolved(addresses, scoring.edges(scores), settings))


def full_run(table: DataFrame, column: str, config: EngineConfig | None = None, limit: int | None = None, **how) -> tuple[Outcome, DataFrame]:
    """(outcome, result rows) of a whole source table."""
    rows = tables.filled_addresses(table, column, limit)
    offline = "offline_geocode" if "offline_geocode" in rows.columns else None
    outcome = cluster(prepared(rows, "original_address", offline=offline, config=config, **how), config)
    return outcome, sinks.clustering_rows(outcome.labels, outcome.addresses)


def file_run(spark: SparkSession, path: str, column: str, folder: str, lon: str | None = None, lat: str | None = None, sample: int | None = None, config: EngineConfig | None = None, **how) -> Outcome:
    """Clusters the addresses of a file and writes clusters, summary, similarities and report tables to ``folder``."""
    began = time.time()
    rows = tables.load_file(spark, path, sample)
    if lon and lat:
        rows = geocoding.user_coordinates(rows, lon, lat)
    if "id" not in rows.columns:
        rows = with_ids(rows)
    outcome = cluster(prepared(rows, column, config=config, **how), config)
    named = outcome.addresses.select("id", "original", "standardized", "lat", "lon")
    sinks.results({"clusters": named.join(outcome.labels, "id"), "similarities": outcome.scores, **outcome.report(config)}, folder)
    located = outcome.addresses.where("lat is not null and lon is not null").count()
    counters = {"total": outcome.addresses.count(), "located": located, "pairs": outcome.scores.count(), "clusters": outcome.labels.select("label").distinct().count()}
    sinks.results({"stats": metrics.run_stats(began, time.time(), counters, spark)}, folder)
    return outcome


def with_ids(rows: DataFrame) -> DataFrame:
    """Rows with ids from 0 in the order of their contents' hash, by range partitions and a prefix sum."""
    return numbered(rows.withColumn("_h", F.xxhash64(*rows.columns)), ["_h"], "id").select("id", *rows.columns)


def incremental_run(table: DataFrame, column: str, results: DataFrame, since, run: str, config: EngineConfig | None = None, limit: int | None = None, **how) -> DataFrame:
    """Result rows of the records made after ``since``: matched to the groups in ``results``, or clustered if there are none."""
    settings = config or EngineConfig()
    rows = tables.new_addresses(table, column, since, limit=limit)
    offline = "offline_geocode" if "offline_geocode" in rows.columns else None
    new = cut(prepared(rows, "original_address", offline=offline, config=settings, **how))
    groups = tables.existing_clusters(results, settings.faithful)
    if groups.isEmpty():
        return sinks.clustering_rows(incremental.cluster_new(new, settings), new)
    # Stored rows hold no parsed parts, and standardized text has lost its units, so the originals are parsed again.
    first = groups.groupBy("group_id").agg(F.min("id").alias("rep_pos"), F.min_by(F.struct("original_address", "coordinates"), "id").alias("row"))
    stored = first.select("group_id", "rep_pos", "row.*").withColumn("at", geo.read_coordinates(F.col("coordinates"))).withColumns({"lat": F.col("at.lat"), "lon": F.col("at.lon")}).drop("at", "coordinates")
    reps = prepared(stored, "original_address", parser=how.get("parser"), config=settings)
    return sinks.incremental_rows(incremental.match(new, reps, settings.similarity_threshold, settings), run, settings)
