"""Writers, and the row builders that stand before them."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postalloom.config import EngineConfig
from postalloom.functions import geo
from postalloom.operators.ordering import numbered
from postalloom.plans.lineage import cut

RESULT_SCHEMA = (
    "id BIGINT, group_id STRING, group_size INT, original_address STRING, cleaned_address STRING, corrected_address STRING, standardized_address STRING, "
    "similarity_text STRING, coordinates STRING, similarity_score DECIMAL(5,4), representative_address STRING, weights_config STRING, processing_time TIMESTAMP"
)


def create_result_table(spark: SparkSession, name: str, path: str | None = None) -> None:
    """The result table, unless it exists; with ``path`` its files are there. The name must be one identifier, or several joined by dots."""
    if not all(part.replace("_", "").isalnum() for part in name.split(".")):
        raise ValueError("not a table name")
    place = f" LOCATION '{path}'" if path else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({RESULT_SCHEMA}) USING parquet{place}")


def as_results(df: DataFrame) -> DataFrame:
    """``df`` with exactly the result table's columns and types; missing ones are null, the time is now."""
    out = []
    for part in RESULT_SCHEMA.replace("DECIMAL(5,4)", "DECIMAL(5;4)").split(", "):
        name, kind = part.split(" ")
        kind = kind.replace(";", ",")
        if name in df.columns:
            out.append(F.col(name).cast(kind).alias(name))
        else:
            out.append((F.current_timestamp() if name == "processing_time" else F.lit(None).cast(kind)).alias(name))
    return df.select(*out)


def append(df: DataFrame, table: str, partitions: int | None = None) -> None:
    """Appends the result columns of ``df`` to a table in one commit."""
    rows = as_results(df)
    (rows.coalesce(partitions) if partitions else rows).write.mode("append").insertInto(table)


def normalisation_rows(normalized: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    """Result rows of records that have no group yet: size 0, and a null group (faithful: an empty one)."""
    group = F.lit("") if (config or EngineConfig()).faithful else F.lit(None).cast("string")
    return normalized.select("id", group.alias("group_id"), F.lit(0).alias("group_size"), F.col("original").alias("original_address"), F.col("cleaned").alias("cleaned_address"), F.col("corrected").alias("corrected_address"), F.col("standardized").alias("standardized_address"))


def incremental_rows(matches: DataFrame, run: str, config: EngineConfig | None = None) -> DataFrame:
    """Result rows of newly matched records; each unmatched one gets a group ``new_cluster_<run>_<n>``, n from 1 by id.

    ``run`` names the run in place of the clock, so a repeated run gives the same ids. Columns of ``matches``: address_id, group_id (null if
    unmatched), similarity, original, standardized, lat, lon. group_size is 1. Only unmatched rows are numbered.
    """
    matches = cut(matches)
    new = numbered(matches.where("group_id is null"), ["address_id"], "_n")
    named = matches.where("group_id is not null").withColumn("_n", F.lit(None).cast("long")).unionByName(new)
    fresh = F.format_string("new_cluster_%s_%d", F.lit(run), F.col("_n") + 1)
    weights = F.to_json(F.create_map(*[F.lit(x) for kv in (config or EngineConfig()).weights.items() for x in kv]))
    return named.select(
        F.col("address_id").alias("id"), F.coalesce("group_id", fresh).alias("group_id"), F.lit(1).alias("group_size"), F.col("original").alias("original_address"), F.col("standardized").alias("standardized_address"),
        geo.coordinates_json(F.col("lat"), F.col("lon")).alias("coordinates"), F.when(F.col("group_id").isNull(), F.lit(0.0)).otherwise(F.col("similarity")).cast("decimal(5,4)").alias("similarity_score"), weights.alias("weights_config"),
    )


def clustering_rows(labels: DataFrame, addresses: DataFrame, prefix: str = "group_") -> DataFrame:
    """Result rows of a clustering: ``<prefix><label>``, the cluster's size and similarity 1; noise is left out.

    Sizes are joined from an aggregate, so a large cluster is not gathered in one window.
    """
    own = labels.where("label <> -1")
    sizes = own.groupBy("label").agg(F.count("*").cast("int").alias("group_size"))
    rows = own.join(sizes, "label").join(addresses, "id")
    return rows.select(
        "id", F.concat(F.lit(prefix), F.col("label")).alias("group_id"), "group_size", F.col("original").alias("original_address"), F.col("standardized").alias("standardized_address"),
        geo.coordinates_json(F.col("lat"), F.col("lon")).alias("coordinates"), F.lit(1.0).cast("decimal(5,4)").alias("similarity_score"),
    )


#: Columns of the older result table; its types follow from their names.
CLUSTER_SCHEMA = (
    "id BIGINT, group_id STRING, original_address STRING, processed_address STRING, customer_code STRING, order_code STRING, coordinates STRING, "
    "group_size INT, text_weight DOUBLE, spatial_weight DOUBLE, spatial_threshold_km DOUBLE, dbscan_eps DOUBLE, dbscan_min_samples INT"
)


def cluster_result_rows(labels: DataFrame, addresses: DataFrame, config: EngineConfig | None = None, prefix: str = "group_") -> DataFrame:
    """Rows of the older result table: groups with the settings that made them. Codes that ``addresses`` has no column for are null; noise is left out."""
    settings = config or EngineConfig()
    codes = {c: F.col(c).cast("string") if c in addresses.columns else F.lit(None).cast("string") for c in ("customer_code", "order_code")}
    have = addresses.select("id", "lat", "lon", *[x.alias(c) for c, x in codes.items()])
    rows = clustering_rows(labels, addresses, prefix).drop("coordinates").join(have, "id")
    made = {
        "processed_address": F.col("standardized_address"), "coordinates": geo.coordinates_json(F.col("lat"), F.col("lon")), "text_weight": F.lit(settings.text_weight), "spatial_weight": F.lit(settings.spatial_weight),
        "spatial_threshold_km": F.lit(settings.max_radius_km), "dbscan_eps": F.lit(settings.dbscan_eps), "dbscan_min_samples": F.lit(settings.dbscan_min_samples),
    }
    fields = [part.split(" ") for part in CLUSTER_SCHEMA.split(", ")]
    return rows.select(*[made.get(name, F.col(name)).cast(kind).alias(name) for name, kind in fields])


def updated_groups(table: DataFrame, labels: DataFrame, prefix: str = "group_") -> DataFrame:
    """The table with group_id and group_size of the labelled ids; noise and other rows stay as they were."""
    own = labels.where("label <> -1")
    sizes = own.groupBy("label").agg(F.count("*").alias("_size"))
    new = own.join(sizes, "label").select("id", F.concat(F.lit(prefix), F.col("label")).alias("_group"), "_size")
    joined = table.join(new, "id", "left")
    return joined.select(*[F.coalesce("_group", "group_id").alias(c) if c == "group_id" else F.coalesce(F.col("_size").cast("int"), F.col("group_size")).alias(c) if c == "group_size" else F.col(c) for c in table.columns])


def updated_by_text(table: DataFrame, groups: DataFrame, column: str) -> DataFrame:
    """The table with group_id and group_size set where its text is among ``groups`` (address, group_id, group_size); the last group by name wins."""
    one = groups.groupBy("address").agg(F.max(F.struct("group_id", "group_size")).alias("_g"))
    joined = table.join(one, F.col(column) == F.col("address"), "left")
    keep = [c for c in table.columns if c not in ("group_id", "group_size")]
    old = lambda c: F.col(c) if c in table.columns else F.lit(None)
    return joined.select(*keep, F.coalesce("_g.group_id", old("group_id")).alias("group_id"), F.coalesce("_g.group_size", old("group_size")).alias("group_size"))


def overwrite(df: DataFrame, path: str) -> None:
    """Replaces a Parquet table by ``df``, which may have been read from it."""
    cut(df).write.mode("overwrite").parquet(path)


def save(df: DataFrame, path: str) -> None:
    """CSV with a header, Parquet or JSON by the ending of ``path``, as a folder of part files."""
    ending = path.rsplit(".", 1)[-1].lower()
    writer = df.write.mode("overwrite")
    if ending == "csv":
        writer.option("header", True).csv(path)
    elif ending == "parquet":
        writer.parquet(path)
    elif ending == "json":
        writer.option("ignoreNullFields", False).json(path)
    else:
        raise ValueError(f"no writer for .{ending}")


def save_parts(df: DataFrame, path: str, rows: int = 100_000) -> None:
    """Files of at most ``rows`` rows each, with a header."""
    df.write.mode("overwrite").option("header", True).option("maxRecordsPerFile", rows).csv(path)


def merge_parts(spark: SparkSession, pattern: str, path: str) -> None:
    """All files that match as one file with one header. One task writes it, as one file must be."""
    spark.read.option("header", True).csv(pattern).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


#: More bytes than any file has, and so few that thousands of files can be counted as so long.
WHOLE_FILE = 1 << 42


@contextmanager
def whole_files(spark: SparkSession) -> Iterator[None]:
    """What is read and written inside keeps its files: each is one task's, neither split nor put together with others."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(name) for name in names]
    try:
        for name in names:
            spark.conf.set(name, str(WHOLE_FILE))
        yield
    finally:
        for name, value in zip(names, before, strict=True):
            spark.conf.set(name, value)


def compress(spark: SparkSession, source: str, path: str) -> None:
    """Text lines gzipped, file by file, so that a header stays the first line of its file; readers decompress by the ending."""
    with whole_files(spark):
        spark.read.text(source).write.mode("overwrite").option("compression", "gzip").text(path)


def decompress(spark: SparkSession, source: str, path: str) -> None:
    """Gzipped text lines as plain ones, file by file."""
    with whole_files(spark):
        spark.read.text(source).write.mode("overwrite").text(path)


def save_edges(edges: DataFrame, path: str) -> None:
    """A similarity matrix as its edge table."""
    edges.select("id1", "id2", "sim").write.mode("overwrite").parquet(path)


def save_cache(geocoded: DataFrame, key: str, path: str) -> None:
    """What geocoders found, one JSON line per distinct text with its ``geo_info``; texts without one are left out."""
    found = geocoded.where(F.col("geo_info").isNotNull() & F.col(key).isNotNull())
    found.groupBy(F.col(key).alias("key")).agg(F.first("geo_info").alias("geo_info")).select("key", "geo_info.*").write.mode("overwrite").json(path)


def backup(df: DataFrame, folder: str, at: str) -> str:
    """A JSON snapshot of rows under the time ``at``; returns its path."""
    path = f"{folder}/backup_{at}.json"
    save(df, path)
    return path


def results(frames: dict[str, DataFrame], folder: str) -> None:
    """Each frame of a run under its name: Parquet where it holds arrays or maps, CSV elsewhere."""
    for name, df in frames.items():
        nested = any(k.startswith(("array", "map", "struct")) for _, k in df.dtypes)
        save(df, f"{folder}/{name}.{'parquet' if nested else 'csv'}")
