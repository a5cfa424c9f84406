"""Clusters of a similarity graph: components, density, linkage, and their repair. Edges are (id1, id2, sim)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postalloom.config import EngineConfig
from postalloom.functions import geo
from postalloom.operators.components import components
from postalloom.operators.ordering import numbered
from postalloom.plans.lineage import cut


def dense(labels: DataFrame) -> DataFrame:
    """(id, label) with labels numbered from 0 in the order of their least id, -1 left alone."""
    firsts = labels.where("label <> -1").groupBy("label").agg(F.min("id").alias("first"))
    new = numbered(firsts, ["first"], "new").select("label", "new")
    return labels.join(new, "label", "left").select("id", F.coalesce("new", F.lit(-1).cast("long")).alias("label"))


def _with_labels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, label): the least id of each node's component, itself where it has no links."""
    found = components(links.select(F.col("id1").alias("u"), F.col("id2").alias("v"))).withColumnRenamed("node", "id")
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("label", "id").alias("label"))


def connected(nodes: DataFrame, edges: DataFrame, threshold: float) -> DataFrame:
    """Components of the edges of at least ``threshold``; isolated nodes are clusters of their own."""
    return dense(_with_labels(nodes, edges.where(F.col("sim") >= threshold)))


def connected_within(nodes: DataFrame, edges: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    """Components of the edges that are also within ``max_radius_km``. Nodes are (id, lat, lon).

    A pair without coordinates is no edge, unless ``missing_coords`` is "text_only".
    """
    settings = config or EngineConfig()
    point = lambda t: nodes.select(F.col("id").alias(f"id{t}"), geo.known(F.col("lat")).alias(f"lat{t}"), geo.known(F.col("lon")).alias(f"lon{t}"))
    placed = edges.where(F.col("sim") >= settings.similarity_threshold).join(point(1), "id1").join(point(2), "id2")
    distance = geo.haversine_km(*[F.col(c) for c in ("lat1", "lon1", "lat2", "lon2")])
    near = F.coalesce(distance <= settings.max_radius_km, F.lit(settings.missing_coords == "text_only"))
    return dense(_with_labels(nodes, placed.where(near)))


def dbscan(nodes: DataFrame, edges: DataFrame, eps: float = 0.5, min_samples: int = 2) -> DataFrame:
    """Density clusters under the distance 1 - sim, -1 for noise. A border node takes the least label of its core neighbours.

    The edge table holds no distance of 1, so ``eps`` must be below 1.
    """
    if not eps < 1:
        raise ValueError("eps must be below 1: absent edges have distance 1")
    close = cut(edges.where(1 - F.col("sim") <= eps).select("id1", "id2"))
    both = close.unionByName(close.select(F.col("id2").alias("id1"), F.col("id1").alias("id2")))
    degree = both.groupBy("id1").agg(F.count("*").alias("n"))
    core = cut(nodes.select("id").join(degree.withColumnRenamed("id1", "id"), "id", "left").where(F.coalesce("n", F.lit(0)) + 1 >= min_samples).select("id"))
    inner = close.join(core.withColumnRenamed("id", "id1"), "id1").join(core.withColumnRenamed("id", "id2"), "id2")
    labelled = cut(_with_labels(core, inner))
    border = both.join(labelled.withColumnRenamed("id", "id2"), "id2").groupBy("id1").agg(F.min("label").alias("near")).withColumnRenamed("id1", "id")
    found = nodes.select("id").join(labelled, "id", "left").join(border, "id", "left")
    return dense(found.select("id", F.coalesce("label", "near", F.lit(-1).cast("long")).alias("label")))


def dbscan_points(nodes: DataFrame, edges: DataFrame, eps: float = 0.5, min_samples: int = 2) -> DataFrame:
    """Density clusters under the Euclidean distance of rows of 1 - sim, followed by latitude and longitude scaled to 0 and 1, -1 for noise.

    Every pair of rows has a distance, so this is one task of at most MOST_NODES nodes (id, lat, lon) and an error beyond. Missing coordinates count as 0, 0.
    """
    most = MOST_NODES
    known = lambda c: geo.known(F.col(c))
    placed = nodes.select(F.col("id").alias("id1"), F.lit(None).cast("long").alias("id2"), F.lit(None).cast("double").alias("sim"), *[F.when(known("lat").isNull() | known("lon").isNull(), F.lit(None)).otherwise(known(c)).alias(c) for c in ("lat", "lon")])
    linked = edges.select("id1", "id2", F.col("sim").cast("double").alias("sim"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame[frame["id2"].isna()].sort_values("id1")
        ids = own["id1"].to_numpy(np.int64)
        if len(ids) > most:
            raise ValueError(f"{len(ids)} nodes are beyond the {most} of one matrix")
        rows = np.ones((len(ids), len(ids) + 2))
        rows[np.arange(len(ids)), np.arange(len(ids))] = 0
        e = frame[~frame["id2"].isna()]
        i, j = np.searchsorted(ids, e["id1"].to_numpy(np.int64)), np.searchsorted(ids, e["id2"].to_numpy(np.int64))
        rows[i, j] = rows[j, i] = 1 - e["sim"].to_numpy(float)
        lat, lon = own["lat"].fillna(np.nan).to_numpy(float), own["lon"].fillna(np.nan).to_numpy(float)
        rows[:, -2] = np.where(np.isnan(lat), 0, (lat + 90) / 180)
        rows[:, -1] = np.where(np.isnan(lon), 0, (lon + 180) / 360)
        squares = (rows**2).sum(axis=1)
        near = np.maximum(squares[:, None] + squares - 2 * rows @ rows.T, 0) <= eps**2 + 1e-12
        core = near.sum(axis=1) >= min_samples
        label, labels = -1, np.full(len(ids), -1)
        for start in range(len(ids)):  # in the order of ids, so a border node goes to the first cluster that reaches it
            if labels[start] != -1 or not core[start]:
                continue
            label += 1
            stack = [start]
            labels[start] = label
            while stack:
                at = stack.pop()
                for other in np.flatnonzero(near[at] & (labels == -1)) if core[at] else ():
                    labels[other] = label
                    stack.append(int(other))
        return pd.DataFrame({"id": ids, "label": labels})

    return dense(placed.unionByName(linked).withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(lambda frame: run(frame), "id long, label long"))


def _agglomerate(distance: np.ndarray, linkage: str, threshold: float | None, n_clusters: int | None) -> np.ndarray:
    """Labels of one dense distance matrix, by merging the two closest clusters until a limit."""
    members = {i: [i] for i in range(len(distance))}
    d = distance.copy()
    np.fill_diagonal(d, np.inf)
    while len(members) > (n_clusters or 1):
        at = int(np.argmin(d))
        i, j = sorted(divmod(at, len(d)))
        if not np.isfinite(d[i, j]) or (threshold is not None and d[i, j] >= threshold):
            break
        a, b = len(members[i]), len(members[j])
        if linkage == "average":
            joined = (a * d[i] + b * d[j]) / (a + b)
        else:
            joined = np.maximum(d[i], d[j]) if linkage == "complete" else np.minimum(d[i], d[j])
        joined[~np.isfinite(d[i]) | ~np.isfinite(d[j])] = np.inf
        d[i], d[:, i] = joined, joined
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        members[i] += members.pop(j)
    labels = np.empty(len(distance), int)
    for own in members.values():
        labels[own] = min(own)
    return labels


#: Nodes of one dense matrix, 200 MB of distances; a larger component is an error.
MOST_NODES = 5_000


def hierarchical(nodes: DataFrame, edges: DataFrame, distance_threshold: float | None = None, n_clusters: int | None = None, linkage: str = "average") -> DataFrame:
    """Agglomerative clusters under 1 - sim; give exactly one limit.

    Under a threshold of at most 1, average and complete linkage never merge across components of the graph, so each component
    is a task of its own. A number of clusters needs the whole matrix in one task. Either is bounded by MOST_NODES and fails beyond it.
    """
    if (distance_threshold is None) == (n_clusters is None):
        raise ValueError("give either distance_threshold or n_clusters")
    if distance_threshold is not None and distance_threshold > 1:
        raise ValueError("distance_threshold is at most 1")
    if linkage == "single" and distance_threshold is not None:
        return dense(_with_labels(nodes, edges.where(1 - F.col("sim") < distance_threshold)))
    grouped = cut(_with_labels(nodes, edges.where("sim > 0")))
    if n_clusters is not None:
        grouped = grouped.withColumn("label", F.lit(0).cast("long"))
    parts = grouped.withColumnRenamed("label", "part")
    own = parts.select("part", F.col("id").alias("id1"), F.lit(None).cast("long").alias("id2"), F.lit(None).cast("double").alias("sim"))
    links = edges.where("sim > 0").join(parts.withColumnRenamed("id", "id1"), "id1").select("part", "id1", "id2", "sim")

    most = MOST_NODES

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        alone = frame["id2"].isna()
        ids = np.sort(frame.loc[alone, "id1"].to_numpy(np.int64))
        if len(ids) > most:
            raise ValueError(f"a component of {len(ids)} nodes is beyond the {most} of one matrix: raise the similarity of edges, or use single linkage")
        distance = np.ones((len(ids), len(ids)))
        e = frame[~alone]
        i, j = np.searchsorted(ids, e["id1"].to_numpy(np.int64)), np.searchsorted(ids, e["id2"].to_numpy(np.int64))
        distance[i, j] = distance[j, i] = 1 - e["sim"].to_numpy(float)
        return pd.DataFrame({"id": ids, "label": ids[_agglomerate(distance, linkage, distance_threshold, n_clusters)]})

    return dense(own.unionByName(links).groupBy("part").applyInPandas(run, "id long, label long"))


def merge_small(labels: DataFrame, min_size: int = 2) -> DataFrame:
    """Clusters below ``min_size``, noise aside, go to the largest one; ties go to the one with the least id."""
    sizes = labels.where("label <> -1").groupBy("label").agg(F.count("*").alias("size"), F.min("id").alias("first"))
    largest = sizes.orderBy(F.desc("size"), "first").limit(1).select(F.col("label").alias("largest"))
    joined = labels.join(sizes.select("label", "size"), "label", "left").join(F.broadcast(largest), F.lit(True), "left")
    return joined.select("id", F.when(F.col("size") < min_size, F.col("largest")).otherwise(F.col("label")).alias("label"))


def optimize(labels: DataFrame, edges: DataFrame, at_least: float = 0.5) -> DataFrame:
    """Clusters joined by an edge of at least ``at_least`` become one under the least label, noise (-1) included."""
    side = lambda t: labels.select(F.col("id").alias(f"id{t}"), F.col("label").alias(f"l{t}"))
    bridges = edges.where(F.col("sim") >= at_least).join(side(1), "id1").join(side(2), "id2").where("l1 <> l2")
    merged = components(bridges.select(F.col("l1").alias("u"), F.col("l2").alias("v"))).select(F.col("node").alias("label"), F.col("label").alias("new"))
    return labels.join(merged, "label", "left").select("id", F.coalesce("new", "label").alias("label"))


def validate(labels: DataFrame, edges: DataFrame, at_least: float = 0.6) -> DataFrame:
    """Clusters of three or more with a pair below ``at_least`` are split into their components under it.

    The component of the cluster's least id keeps the label; the others get fresh labels after the highest, in the order of
    cluster and least id, one number being skipped per split cluster. Noise stays.
    """
    labels = cut(labels)
    side = lambda t: labels.select(F.col("id").alias(f"id{t}"), F.col("label").alias(f"l{t}"))
    strong = cut(edges.where((F.col("sim") >= at_least) & (F.col("id1") != F.col("id2"))).join(side(1), "id1").join(side(2), "id2").where("l1 = l2 and l1 <> -1").select("id1", "id2", F.col("l1").alias("label")))
    sizes = labels.where("label <> -1").groupBy("label").agg(F.count("*").alias("k"), F.min("id").alias("first"))
    full = strong.groupBy("label").agg(F.count("*").alias("m"))
    loose = sizes.join(full, "label", "left").where((F.col("k") > 2) & (F.coalesce("m", F.lit(0)) < F.col("k") * (F.col("k") - 1) / 2))
    inside = labels.join(loose.select("label", "first"), "label")
    parts = _with_labels(inside, strong.join(loose.select("label"), "label", "left_semi")).withColumnRenamed("label", "part")
    placed = inside.join(parts, "id")
    top = labels.agg(F.coalesce(F.max("label"), F.lit(-1)).alias("top")).first()["top"]
    ranked = numbered(placed.select("label", "part").distinct(), ["label", "part"], "n")  # the parts of earlier clusters come before, so a part's number is what is skipped and its place
    kept = ranked.groupBy("label").agg(F.min("n").alias("least"))
    fresh = ranked.join(kept, "label").select("label", "part", F.when(F.col("n") == F.col("least"), F.col("label")).otherwise(F.lit(top + 1) + F.col("n")).alias("new"))
    done = placed.join(fresh, ["label", "part"]).select("id", F.col("new"))
    return labels.join(done, "id", "left").select("id", F.coalesce("new", "label").cast("long").alias("label"))


def resolved(nodes: DataFrame, edges: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    """Components, small clusters and validation in a row.

    Clean mode leaves small clusters alone: merging them into the largest joins unrelated records.
    """
    settings = config or EngineConfig()
    labels = connected_within(nodes, edges, settings) if settings.use_spatial_constraints else connected(nodes, edges, settings.similarity_threshold)
    if settings.faithful:
        labels = merge_small(labels, settings.min_cluster_size)
    return validate(labels, edges, settings.validate_from)
