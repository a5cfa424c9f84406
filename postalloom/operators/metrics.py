"""Quality of clusters, summaries, and the aggregates behind reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postalloom.config import EngineConfig


def quality(labels: DataFrame, edges: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    """One row: n_clusters, avg_similarity_within, avg_similarity_between, silhouette_score, within_between_ratio.

    Sums over the sparse edges in place of a matrix; absent pairs count as 0, noise is left out, and each cluster stands in for
    others by its first ``sampling_size`` members by id. A point with neither similarity counts as 0 (NaN in faithful mode).
    """
    settings = config or EngineConfig()
    own = labels.where("label <> -1")
    firsts = first_by_id(own, "label", settings.sampling_size).select("id", F.lit(True).alias("sampled"))
    ranked = own.join(firsts, "id", "left").withColumn("sampled", F.coalesce("sampled", F.lit(False)))
    sizes = ranked.groupBy("label").agg(F.count("*").alias("k"), F.sum(F.col("sampled").cast("long")).alias("m"))
    side = lambda t: ranked.select(F.col("id").alias(f"id{t}"), F.col("label").alias(f"l{t}"), F.col("sampled").alias(f"s{t}"))
    placed = edges.where("id1 <> id2").join(side(1), "id1").join(side(2), "id2")
    totals = sizes.agg(F.count("*").alias("n_clusters"), F.coalesce(F.sum(F.col("k") * (F.col("k") - 1) / 2), F.lit(0.0)).alias("inner_pairs"), F.coalesce((F.pow(F.sum("m"), 2) - F.sum(F.col("m") * F.col("m"))) / 2, F.lit(0.0)).alias("outer_pairs"))
    sums = placed.agg(F.coalesce(F.sum(F.when(F.col("l1") == F.col("l2"), F.col("sim"))), F.lit(0.0)).alias("inner"), F.coalesce(F.sum(F.when((F.col("l1") != F.col("l2")) & F.col("s1") & F.col("s2"), F.col("sim"))), F.lit(0.0)).alias("outer"))
    flip = placed.select(F.col("id2").alias("id1"), F.col("id1").alias("id2"), "sim", F.col("l2").alias("l1"), F.col("s2").alias("s1"), F.col("l1").alias("l2"), F.col("s1").alias("s2"))
    both = placed.select("id1", "id2", "sim", "l1", "s1", "l2", "s2").unionByName(flip)
    inside = both.where("l1 = l2").groupBy("id1").agg(F.sum("sim").alias("near")).withColumnRenamed("id1", "id")
    outside = both.where("l1 <> l2 and s2").groupBy("id1", "l2").agg(F.sum("sim").alias("sim")).join(sizes.select(F.col("label").alias("l2"), "m"), "l2")
    best = outside.groupBy("id1").agg(F.max(F.col("sim") / F.col("m")).alias("far")).withColumnRenamed("id1", "id")
    points = own.join(sizes, "label").where("k > 1").join(inside, "id", "left").join(best, "id", "left")
    a = 1 - F.coalesce("near", F.lit(0.0)) / (F.col("k") - 1)
    b = 1 - F.coalesce("far", F.lit(0.0))
    undefined = F.lit(float("nan")) if settings.faithful else F.lit(0.0)
    score = F.when(F.greatest(a, b) == 0, undefined).otherwise(F.try_divide(b - a, F.greatest(a, b)))
    shape = points.agg(F.avg(score).alias("mean"))
    row = totals.join(F.broadcast(sums), F.lit(True)).join(F.broadcast(shape), F.lit(True))
    within, between = F.coalesce(F.try_divide("inner", "inner_pairs"), F.lit(0.0)), F.coalesce(F.try_divide("outer", "outer_pairs"), F.lit(0.0))
    return row.select(
        "n_clusters", within.alias("avg_similarity_within"), between.alias("avg_similarity_between"),
        F.when(F.col("n_clusters") > 1, F.coalesce("mean", F.lit(-1.0))).otherwise(F.lit(-1.0)).alias("silhouette_score"),
        F.coalesce(F.try_divide(within, between), F.lit(0.0)).alias("within_between_ratio"),
    )


def first_by_id(rows: DataFrame, label: str, n: int) -> DataFrame:
    """The ``n`` rows of least id of each label. Each label is ranked in salted parts first, so a large one is not one task."""
    part = rows.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    some = part.withColumn("rank", F.row_number().over(Window.partitionBy(label, "_part").orderBy("id"))).where(F.col("rank") <= n)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy(label).orderBy("id"))).where(F.col("rank") <= n).drop("_part")


SALTS = 64


def cluster_summary(labels: DataFrame, addresses: DataFrame, members_in_rows: bool = True) -> DataFrame:
    """Per cluster, noise aside: size, most frequent standardized text (the one first seen among ties, 100 characters), mean
    coordinates, the first three originals (50 characters) and the member ids. These make a row as large as its cluster: without
    ``members_in_rows`` they are left out, and the table of labels has them."""
    members = labels.where("label <> -1").join(addresses.select("id", "original", "standardized", "lat", "lon"), "id")
    texts = members.groupBy("label", F.coalesce("standardized", F.lit("")).alias("text")).agg(F.count("*").alias("n"), F.min("id").alias("first"))
    best = texts.groupBy("label").agg(F.min_by("text", F.struct(-F.col("n"), "first")).alias("text"))
    rows = members.groupBy("label").agg(F.count("*").alias("size"), F.avg("lat").alias("avg_latitude"), F.avg("lon").alias("avg_longitude"), *([F.sort_array(F.collect_list("id")).alias("member_ids")] if members_in_rows else []))
    firsts = first_by_id(members, "label", 3)
    examples = firsts.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.substring(F.coalesce("original", F.lit("")), 1, 50).alias("text")))), lambda x: x["text"]).alias("examples"))
    joined = rows.join(best, "label").join(examples, "label")
    return joined.select(F.col("label").alias("cluster_id"), "size", F.substring("text", 1, 100).alias("representative_address"), "avg_latitude", "avg_longitude", "examples", *(["member_ids"] if members_in_rows else []))


def describe_sizes(labels: DataFrame) -> DataFrame:
    """One row: number of clusters, mean, standard deviation, least, quartiles and greatest size; noise aside."""
    sizes = labels.where("label <> -1").groupBy("label").agg(F.count("*").alias("size"))
    quartile = lambda q: F.percentile("size", F.lit(q))
    return sizes.agg(
        F.count("*").alias("n"), F.avg("size").alias("mean"), F.stddev("size").alias("std"), F.min("size").alias("min"),
        quartile(0.25).alias("q25"), quartile(0.5).alias("q50"), quartile(0.75).alias("q75"), F.max("size").alias("max"),
    )


def label_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count("*").alias("n"))


def rate(df: DataFrame, holds: Column, name: str) -> DataFrame:
    """One row: the share of rows for which ``holds``; 0 without rows."""
    return df.agg(F.coalesce(F.avg(F.coalesce(holds, F.lit(False)).cast("int")), F.lit(0.0)).alias(name))


def run_stats(started: float, ended: float, counters: dict[str, int], spark) -> DataFrame:
    """One row of counters with duration and rate."""
    took = max(ended - started, 1e-9)
    row = {**counters, "duration_s": took, "per_second": counters.get("total", 0) / took}
    return spark.createDataFrame([tuple(row.values())], list(row))


def histogram(df: DataFrame, value: Column, bins: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """(bin, n): equal bins from 0 between the bounds, by default the values' own; the last includes the upper one. Nulls are left out."""
    values = df.select(value.cast("double").alias("v")).where("v is not null and not isnan(v)")
    if low is None or high is None:
        found = values.agg(F.min("v").alias("low"), F.max("v").alias("high"))
    else:
        found = df.sparkSession.createDataFrame([(float(low), float(high))], "low double, high double")
    placed = values.join(F.broadcast(found), F.lit(True)).where("v between low and high")
    share = F.coalesce(F.try_divide(F.col("v") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0))
    return placed.groupBy(F.least(F.floor(share * bins), F.lit(bins - 1).cast("long")).alias("bin")).agg(F.count("*").alias("n"))


def length_histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    return histogram(df, F.char_length(F.coalesce(F.col(column), F.lit(""))), bins)


def clusters_per_day(df: DataFrame, at: str = "ts", label: str = "label") -> DataFrame:
    return df.groupBy(F.to_date(at).alias("day")).agg(F.count_distinct(label).alias("clusters"))


def density_grid(points: DataFrame, bins: int = 50) -> DataFrame:
    """(gx, gy, n): counts on a square grid over the points' extent; points without both coordinates are left out."""
    known = points.where("lat is not null and lon is not null")
    extent = known.agg(*[f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("low", F.min), ("high", F.max))])
    placed = known.join(F.broadcast(extent), F.lit(True))
    at = lambda c: F.least(F.floor(F.coalesce(F.try_divide(F.col(c) - F.col(f"low_{c}"), F.col(f"high_{c}") - F.col(f"low_{c}")), F.lit(0.0)) * bins), F.lit(bins - 1).cast("long"))
    return placed.groupBy(at("lon").alias("gx"), at("lat").alias("gy")).agg(F.count("*").alias("n"))


def similarity_histograms(scores: DataFrame, bins: int = 50) -> DataFrame:
    """(measure, bin, n) of the four similarities."""
    long = scores.select(F.explode(F.create_map(*[x for m in ("comprehensive", "text", "spatial", "administrative") for x in (F.lit(m), F.col(f"{m}_similarity"))])).alias("measure", "v"))
    place = F.least(F.floor(F.col("v") * bins), F.lit(bins - 1).cast("long"))
    return long.where("v between 0 and 1").groupBy("measure", place.alias("bin")).agg(F.count("*").alias("n"))


def map_centre(points: DataFrame) -> DataFrame:
    return points.agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def map_points(points: DataFrame, colours: int = 20) -> DataFrame:
    """Points with the colour number of their cluster."""
    return points.where("lat is not null and lon is not null").withColumn("colour", F.pmod("label", F.lit(colours)))


def report(labels: DataFrame, addresses: DataFrame, scores: DataFrame, config: EngineConfig | None = None) -> dict[str, DataFrame]:
    """All aggregates of a report by name; drawing is left to the reader's tool."""
    located = addresses.join(labels, "id")
    return {
        "sizes": label_counts(labels), "size_description": describe_sizes(labels), "lengths": length_histogram(addresses, "original"),
        "similarities": similarity_histograms(scores), "distances": histogram(scores, F.col("distance_km"), 50), "density": density_grid(addresses),
        "centre": map_centre(addresses), "points": map_points(located), "geocoded": rate(addresses, F.col("lat").isNotNull() & F.col("lon").isNotNull(), "rate"),
        "summary": cluster_summary(labels, addresses), "quality": quality(labels, edges_of(scores), config),
    }


def edges_of(scores: DataFrame) -> DataFrame:
    return scores.select("id1", "id2", F.col("comprehensive_similarity").alias("sim"))
