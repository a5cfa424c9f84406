"""Matching of new records to existing groups."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postalloom.config import EngineConfig
from postalloom.functions import geo, similarity
from postalloom.operators import blocking, clustering, scoring
from postalloom.plans.lineage import cut

PARTS = ("province", "city", "district", "street")


def one_per_group(representatives: DataFrame, faithful: bool = False) -> DataFrame:
    """One representative per group with its position: that of the group's first row. The values are the first row's too, or
    in faithful mode the last one's. ``pos`` orders the rows."""
    picked = F.max_by if faithful else F.min_by
    values = F.struct(*[c for c in representatives.columns if c not in ("group_id", "pos")])
    return representatives.groupBy("group_id").agg(F.min("pos").alias("rep_pos"), picked(values, "pos").alias("_v")).select("group_id", "rep_pos", "_v.*")


#: A text similarity is at most 0.7 without a single common character, and each 0.3 more need as much of the characters' Jaccard.
NO_CHARACTERS, CHARACTERS = 0.7, 0.3
#: The least Jaccard of characters that makes few enough candidates, and the widest distance for which cells are made.
SELECTIVE = 0.5


def _least_characters(text: float) -> float:
    """The Jaccard of characters that a text similarity of ``text`` needs."""
    return (text - NO_CHARACTERS) / CHARACTERS - 1e-9


def compared(new: DataFrame, reps: DataFrame, threshold: float, settings: EngineConfig) -> DataFrame:
    """(id, group_id): all pairs that can reach ``threshold``, and some others. ``new``: id, standardized, lat, lon; ``reps``: group_id, standardized, lat, lon.

    With the weights t, s and a of text, place and parts, a pair of place similarity below x needs a text similarity of (threshold - a - s * x) / t. So pairs are
    either near each other, and meet in cells, or alike in their characters, and meet by rare ones. x is chosen for the characters to be selective. Where no
    distance does that, all pairs have to be compared; then blocks of ``new`` meet blocks of ``reps``.
    """
    t, s, a = settings.text_weight, settings.spatial_weight, settings.admin_weight
    theirs = reps.withColumnRenamed("group_id", "id")
    texts = lambda df: df.select("id", F.coalesce("standardized", F.lit("")).alias("text"))
    widest = scoring.widest_km(settings, threshold)
    furthest = 0.5 * geo.KM_PER_DEGREE
    if widest is not None and widest <= furthest:
        return blocking.near_pairs(new, theirs, widest).select("id", F.col("r_id").alias("group_id")).distinct()
    floor = math.exp(-furthest / settings.spatial_decay_km)
    wanted = (threshold - a - t * (NO_CHARACTERS + CHARACTERS * SELECTIVE)) / s if s > 0 else 0.0
    x = min(1.0, max(floor, wanted)) if s > 0 else 0.0
    least = _least_characters((threshold - a - s * x) / t) if t > 0 else 0.0
    if least <= 0:
        return _in_blocks(new, theirs)
    alike = blocking.alike_pairs(texts(new), texts(theirs), min(least, 1.0))
    near = blocking.near_pairs(new, theirs, min(furthest, -settings.spatial_decay_km * math.log(x))) if x > 0 else alike.limit(0)
    return alike.unionByName(near).select("id", F.col("r_id").alias("group_id")).distinct()


#: Rows of a block where all pairs have to be compared.
BLOCK_ROWS = 4096


def _in_blocks(new: DataFrame, theirs: DataFrame) -> DataFrame:
    """All pairs, as blocks of about BLOCK_ROWS rows against blocks of as many: the last resort for thresholds that exclude nothing."""
    n, m = (max(1, math.ceil(df.count() / BLOCK_ROWS)) for df in (new, theirs))
    left = new.select("id", F.pmod(F.xxhash64("id"), F.lit(n)).alias("_x"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))).alias("_y"))
    right = theirs.select(F.col("id").alias("r_id"), F.pmod(F.xxhash64("id"), F.lit(m)).alias("_ry"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("_rx"))
    return left.join(right, (F.col("_x") == F.col("_rx")) & (F.col("_y") == F.col("_ry"))).select("id", F.col("r_id").alias("group_id"))


def match(new: DataFrame, representatives: DataFrame, threshold: float, config: EngineConfig | None = None) -> DataFrame:
    """Every new record with the group of its best representative of at least ``threshold``, null group without one.

    Ties go to the representative with the lowest position. Only pairs that can reach the threshold are compared (see ``compared``), which gives
    the result of comparing all. ``new``: id, original, standardized, lat, lon and parts; ``representatives``: group_id, rep_pos, standardized,
    lat, lon and parts, one row per group.
    """
    settings = config or EngineConfig()
    new, representatives = cut(new), cut(representatives)
    reps = representatives.select("group_id", "rep_pos", *[F.col(c).alias(f"r_{c}") for c in ("standardized", "lat", "lon", *PARTS) if c in representatives.columns])
    found = cut(compared(new.select("id", "standardized", "lat", "lon"), representatives.select("group_id", "standardized", "lat", "lon"), threshold, settings))
    pairs = found.join(new, "id").join(reps, "group_id")
    distance = geo.haversine_km(*[geo.known(F.col(c)) for c in ("lat", "lon", "r_lat", "r_lon")])
    place = geo.spatial_similarity(distance, settings.spatial_decay_km)
    mine = {c: F.col(c) for c in PARTS if c in new.columns}
    theirs = mine if settings.faithful else {c: F.col(f"r_{c}") for c in mine if f"r_{c}" in reps.columns}
    parts = similarity.administrative_similarity(mine, theirs) if "province" in theirs else F.lit(0.0)
    text = similarity.text_similarity(F.coalesce("standardized", F.lit("")), F.coalesce("r_standardized", F.lit("")), "combined", settings)
    total = settings.text_weight * text + settings.spatial_weight * place + settings.admin_weight * parts
    scored = pairs.select("id", "group_id", "rep_pos", F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)).alias("similarity")).where(F.col("similarity") >= threshold)
    best = scored.groupBy("id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "rep_pos", "group_id")).alias("_b"))
    found = best.select("id", F.col("_b.group_id").alias("group_id"), (-F.col("_b.s")).alias("similarity"))
    kept = [c for c in ("original", "standardized", "lat", "lon") if c in new.columns]
    joined = new.select("id", *kept).join(found, "id", "left")
    return joined.select(F.col("id").alias("address_id"), "group_id", "similarity", F.col("group_id").isNull().alias("is_new_cluster"), *kept)


def cluster_new(new: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    """Full clustering of the new records alone, for the time before there are groups."""
    settings = config or EngineConfig()
    pairs = blocking.candidates(new, settings, settings.similarity_threshold)
    scores = scoring.scored(pairs, new, settings, settings.similarity_threshold)
    return clustering.resolved(new, scoring.edges(scores), settings)


def after(df: DataFrame, at: str, now, back: str = "1 day") -> DataFrame:
    """Rows later than ``back`` before ``now``: the high-water mark of a poll."""
    return df.where(F.col(at) > F.lit(now).cast("timestamp") - F.expr(f"interval {back}"))
