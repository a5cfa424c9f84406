"""All registered queries of the entity-resolution engine over the driver's tables, and their SQL oracles.

The tables hold no addresses. Customers stand in for them: the name is the text; region, nation and segment are the
administrative parts; coordinates are arithmetic on the key.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postalloom.config import EngineConfig
from postalloom.functions import geo, parse, similarity, text
from postalloom.operators import blocking, clustering, execution, geocoding, incremental, metrics, scoring, tiles
from postalloom.plans import pipeline
from postalloom.plans.lineage import cut, shared_folder
from postalloom.sources import sinks, tables
from postalloom.streaming import incremental as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    def keep(query):
        QUERIES[query.__name__] = query
        if sql:
            ORACLES[query.__name__] = sql
        return query

    return keep


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def customers(spark: SparkSession, d: str) -> DataFrame:
    nations = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    both = read(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("c_custkey")
    return both.select(
        key.alias("id"), F.col("c_name").alias("original"), F.col("c_name").alias("standardized"), F.col("r_name").alias("province"), F.col("n_name").alias("city"), F.col("c_mktsegment").alias("district"),
        F.lit("").alias("street"), (20 + (key * 37 % 3000) / F.lit(100.0)).alias("lat"), (75 + (key * 91 % 6000) / F.lit(100.0)).alias("lon"), F.col("c_acctbal").alias("balance"),
    )


CUSTOMERS = """
a AS (SELECT c_custkey AS id, c_name AS name, r_name AS province, n_name AS city, c_mktsegment AS district,
      20 + (c_custkey * 37 % 3000) / 100.0::DOUBLE AS lat, 75 + (c_custkey * 91 % 6000) / 100.0::DOUBLE AS lon, c_acctbal AS balance
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
HAVERSINE = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(y.lat - x.lat) / 2), 2) + cos(radians(x.lat)) * cos(radians(y.lat)) * pow(sin(radians(y.lon - x.lon) / 2), 2))))"
APPROX = "sqrt(pow((y.lat - x.lat) * 111.0, 2) + pow((y.lon - x.lon) * 111.0 * greatest(0.5, cos(radians((x.lat + y.lat) / 2))), 2))"
ADMIN = "least(1.0, CASE WHEN x.province <> y.province THEN 0.0::DOUBLE ELSE 0.0::DOUBLE + (CASE WHEN x.province = y.province THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END) + (CASE WHEN x.city = y.city THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END) + (CASE WHEN x.district = y.district THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END) END)"
EDIT = "(greatest(length(x.name), length(y.name)) - levenshtein(x.name, y.name)) / greatest(length(x.name), length(y.name))::DOUBLE"
CHARS = "len(list_intersect(list_distinct(string_split(x.name, '')), list_distinct(string_split(y.name, '')))) / len(list_distinct(list_concat(string_split(x.name, ''), string_split(y.name, ''))))::DOUBLE"
COMBINED = f"least(1.0, greatest(0.0, 0.4 * jaro_winkler_similarity(x.name, y.name) + 0.3 * {EDIT} + 0.3 * {CHARS}))"
GRID_PAIRS = f"""
cells AS (SELECT *, trunc(lon / 0.1)::BIGINT AS gx, trunc(lat / 0.1)::BIGINT AS gy FROM a),
grid AS (SELECT DISTINCT x.id AS id1, y.id AS id2 FROM cells x JOIN cells y ON y.gx BETWEEN x.gx - 1 AND x.gx + 1 AND y.gy BETWEEN x.gy - 1 AND x.gy + 1 AND x.id < y.id
         WHERE {APPROX} <= 75)"""
ADMIN_PAIRS = "blocked AS (SELECT x.id AS id1, y.id AS id2 FROM a x JOIN a y ON x.province = y.province AND x.city = y.city AND x.district = y.district AND x.id < y.id)"
THRESHOLD = 0.55
PAIR_SCORES = f"""
pairs AS (SELECT * FROM blocked UNION SELECT * FROM grid),
parts AS (SELECT id1, id2, {COMBINED} AS t, coalesce(exp(-({HAVERSINE}) / 10.0), 0.0) AS s, {ADMIN} AS m, {HAVERSINE} AS km
          FROM pairs JOIN a x ON x.id = id1 JOIN a y ON y.id = id2),
scores AS (SELECT id1, id2, least(1.0, greatest(0.0, 0.4 * t + 0.4 * s + 0.2 * m)) AS c, t, s, m, km FROM parts)"""
SCORED = f"WITH {CUSTOMERS}, {GRID_PAIRS}, {ADMIN_PAIRS}, {PAIR_SCORES}"


def pairs_of(spark: SparkSession, d: str) -> DataFrame:
    a = customers(spark, d)
    return blocking.admin_or_spatial_pairs(a)


# --- sources ---


@register("SELECT o_orderkey AS id, o_orderpriority AS original_address FROM orders WHERE o_orderpriority IS NOT NULL AND o_orderpriority <> ''")
def scan_filter_project(spark, d):
    return tables.filled_addresses(read(spark, d, "orders").withColumn("id", F.col("o_orderkey")), "o_orderpriority")


@register("SELECT o_orderkey AS id, o_orderdate AS create_time, o_orderpriority AS original_address FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01' AND o_orderpriority <> ''")
def fetch_since(spark, d):
    orders = read(spark, d, "orders").withColumns({"id": F.col("o_orderkey"), "create_time": F.col("o_orderdate")})
    return tables.new_addresses(orders, "o_orderpriority", "1998-01-01 00:00:00")


GROUPED = "g AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE 'group_' || (o_custkey % 50) END AS group_id, o_orderpriority AS standardized_address, (o_orderkey % 100) / 100.0::DOUBLE AS similarity_score FROM orders)"


def grouped(spark, d):
    orders = read(spark, d, "orders")
    group = F.when(F.col("o_custkey") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("group_"), F.col("o_custkey") % 50))
    return orders.select(F.col("o_orderkey").alias("id"), group.alias("group_id"), F.col("o_orderpriority").alias("standardized_address"), F.lit(None).cast("string").alias("coordinates"), ((F.col("o_orderkey") % 100) / F.lit(100.0)).alias("similarity_score"))


@register(f"WITH {GROUPED} SELECT id, group_id, standardized_address FROM g WHERE group_id IS NOT NULL")
def existing_clusters(spark, d):
    return tables.existing_clusters(grouped(spark, d)).select("id", "group_id", "standardized_address")


@register(f"WITH {GROUPED} SELECT group_id, standardized_address, count(*) AS n, round(avg(similarity_score), 6) AS avg_similarity FROM g WHERE group_id IS NOT NULL GROUP BY 1, 2")
def representatives(spark, d):
    reps = tables.representatives(grouped(spark, d))
    return reps.groupBy("group_id", "standardized_address").agg(F.max("cluster_size").alias("n"), F.round(F.max("avg_similarity"), 6).alias("avg_similarity"))


@register("""WITH p AS (SELECT DISTINCT p_name FROM part WHERE p_type <> 'SMALL' AND p_name IS NOT NULL AND strlen(p_name) >= 5),
n AS (SELECT row_number() OVER (ORDER BY p_name) AS id, p_name AS address FROM p)
SELECT id, address FROM n ORDER BY id LIMIT 20 OFFSET 10""")
def dedup_page(spark, d):
    return tables.distinct_page(read(spark, d, "part"), "p_name", 20, 10, "p_type", "SMALL", order="p_partkey").select("id", "address")


@register()
def sample_n(spark, d):
    return tables.sampled(read(spark, d, "part"), 100)


# --- normalisation ---


@register("SELECT p_partkey AS id, replace(replace(replace(p_name, 'small', '大街'), 'red', '路'), 'ring', 'road') AS text FROM part")
def replace_chain(spark, d):
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), text.replace_all(F.col("p_name"), [("small", "大街"), ("red", "路"), ("ring", "road")]).alias("text"))


def replaced(column: str, pairs) -> str:
    """SQL of literal replacements one after the other."""
    for old, new in pairs:
        column = f"replace({column}, '{old}', '{new}')"
    return column


#: Every part's name between two of the wrong spellings, so that each of them and many neighbours occur.
WRONG = f"""w(k, wrong) AS (VALUES {", ".join(f"({i}, '{old}')" for i, (old, _) in enumerate(text.CORRECTIONS))}),
t AS (SELECT p_partkey AS id, x.wrong || '科技园' || p_name || y.wrong AS t FROM part JOIN w x ON x.k = p_partkey % {len(text.CORRECTIONS)} JOIN w y ON y.k = (p_partkey * 7 + p_size) % {len(text.CORRECTIONS)})"""


def misspelt(spark: SparkSession, d: str) -> DataFrame:
    words = F.array(*[F.lit(old) for old, _ in text.CORRECTIONS])
    n = len(text.CORRECTIONS)
    key = F.col("p_partkey")
    pick = lambda k: F.element_at(words, (k % n + 1).cast("int"))
    return read(spark, d, "part").select(key.alias("id"), F.concat(pick(key), F.lit("科技园"), "p_name", pick(key * 7 + F.col("p_size"))).alias("t"))


@register(f"WITH {WRONG} SELECT id, {replaced('t', text.CORRECTIONS)} AS text FROM t")
def corrections(spark, d):
    """All corrections in their order, without the numerals that follow."""
    return misspelt(spark, d).select("id", text.replace_all(F.col("t"), text.CORRECTIONS).alias("text"))


NUMBERED = """n(k, run, digits) AS (VALUES (0, '三', '3'), (1, '十', '10'), (2, '十一', '11'), (3, '二十', '20'), (4, '二十三', '23'), (5, '五一', '五一'), (6, '九十九', '99')),
t AS (SELECT p_partkey AS id, p_name || run || '号' || p_size AS t, p_name || digits || '号' || p_size AS text FROM part JOIN n ON k = p_partkey % 7)"""


@register(f"WITH {NUMBERED} SELECT id, text FROM t")
def numerals(spark, d):
    runs = F.array(*[F.lit(x) for x in ("三", "十", "十一", "二十", "二十三", "五一", "九十九")])
    named = F.concat("p_name", F.element_at(runs, (F.col("p_partkey") % 7 + 1).cast("int")), F.lit("号"), "p_size")
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), text.arabic_numerals(named).alias("text"))


FORMED = f"""f AS (SELECT p_partkey AS id, '浙江省杭州市西湖区街道' || p_name || '大街大道大楼中心' || p_brand || '商务楼公寓楼road' AS t FROM part)
SELECT id, trim({replaced(replaced(replaced('t', text.ROAD_FORMS)[0:], text.BUILDING_FORMS), [(u, '') for u in text.DROPPED_UNITS])}) AS text FROM f"""


@register(f"WITH {FORMED}")
def faithful_format(spark, d):
    """The standard format in faithful mode: forms and units in their listed order."""
    parts = {"province": F.lit("浙江省"), "city": F.lit("杭州市"), "district": F.lit("西湖区"), "street": F.lit("街道"), "detail": F.concat("p_name", F.lit("大街大道大楼中心"), "p_brand", F.lit("商务楼公寓楼road"))}
    parsed = F.struct(*[x.alias(c) for c, x in parts.items()])
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), text.standard_format(parsed, True).alias("text"))


MADE = "m AS (SELECT p_partkey AS id, '浙江省杭州市西湖区' || p_brand || '路' || p_size || '号' || (p_size % 9 + 1) || '栋' || p_partkey || '室' || (CASE WHEN p_size % 3 = 0 THEN '花园' ELSE '公寓' END) || p_name AS t FROM part)"


def made_addresses(spark, d):
    made = F.concat(F.lit("浙江省杭州市西湖区"), "p_brand", F.lit("路"), "p_size", F.lit("号"), F.col("p_size") % 9 + 1, F.lit("栋"), "p_partkey", F.lit("室"), F.when(F.col("p_size") % 3 == 0, F.lit("花园")).otherwise(F.lit("公寓")), "p_name")
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), made.alias("t"))


@register(f"""WITH {MADE} SELECT id, regexp_extract(t, '(.+?[路街大道巷弄胡同])', 1) AS road, regexp_extract(t, '([0-9]+[号\\-][0-9]+|[0-9]+)', 1) AS number,
regexp_extract(t, '([0-9]+[号栋幢座]|[0-9]+号楼|[0-9]+栋楼)', 1) AS building, regexp_extract(t, '([0-9]+[室房号]|[0-9]+单元|[0-9]+-?[0-9]+)', 1) AS room, regexp_extract(t, '([地下]?[0-9]+层|[BGF][0-9]+)', 1) AS floor FROM m""")
def regex_components(spark, d):
    return made_addresses(spark, d).select("id", text.components(F.col("t")).alias("c")).select("id", "c.road", "c.number", "c.building", "c.room", "c.floor")


@register(f"""WITH {MADE}, k AS (SELECT id, t, CASE WHEN instr(t, '花园') > 0 THEN instr(t, '花园') ELSE instr(t, '公寓') END AS p FROM m)
SELECT id, trim(substring(t, greatest(p - 10, 1), p + 7 - greatest(p - 10, 1))) AS estate FROM k""")
def estate_slice(spark, d):
    return made_addresses(spark, d).select("id", text.estate(F.col("t")).alias("estate"))


@register(f"WITH {MADE} SELECT id, substring(md5(t), 1, 12) AS hash FROM m")
def md5_hash(spark, d):
    return made_addresses(spark, d).select("id", text.short_hash(F.col("t")).alias("hash"))


@register(f"""WITH {MADE}, s AS (SELECT id, t, substring(t, 10) AS rest FROM m)
SELECT id, '浙江省' AS province, '杭州市' AS city, '西湖区' AS district, rest AS detail FROM s""")
def parse_suffixes(spark, d):
    return made_addresses(spark, d).select("id", parse.by_suffix(F.col("t")).alias("p")).select("id", "p.*")


PLACES = [("湖北省", "武汉市", "洪山区"), ("", "成都市", "武侯区"), ("江苏省", "", ""), ("广西壮族自治区", "桂林市", ""), ("", "", "浦东新区"), ("", "", "")]
VARIED = f"""w(k, province, city, district) AS (VALUES {", ".join(f"({i}, '{a}', '{b}', '{c}')" for i, (a, b, c) in enumerate(PLACES))}),
v AS (SELECT p_partkey AS id, w.* EXCLUDE (k), p_name || p_size AS detail FROM part JOIN w ON k = p_partkey % {len(PLACES)})"""


@register(f"WITH {VARIED} SELECT id, province, city, district, detail FROM v")
def parse_varied(spark, d):
    """Addresses with and without each administrative part."""
    pick = lambda i: F.element_at(F.array(*[F.lit("".join(p)) for p in PLACES]), i)
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(pick((F.col("p_partkey") % len(PLACES) + 1).cast("int")), "p_name", "p_size").alias("t"))
    return rows.select("id", parse.by_suffix(F.col("t")).alias("p")).select("id", "p.*")


@register(f"""WITH {MADE}, n AS (SELECT n_name, '浙江省杭州市' AS prefix FROM nation WHERE n_nationkey = 0)
SELECT id, '浙江省' AS province, '杭州市' AS city, substring(t, 7) AS detail FROM m, n""")
def parse_gazetteer(spark, d):
    places = spark.createDataFrame([("浙江省", "浙江省", "", ""), ("浙江省杭州市", "浙江省", "杭州市", "")], "name string, province string, city string, district string")
    return parse.GazetteerParser(places).parse(made_addresses(spark, d), "t", "a", "b").select("id", "a.province", "a.city", "a.detail")


@register(f"""WITH {MADE}, q AS (SELECT id, lower(substring(t, 10)) AS rest FROM m), r AS (SELECT id, rest, regexp_extract(rest, '(.+?[路街大道巷弄])', 1) AS street FROM q),
j AS (SELECT id, '浙江省杭州市西湖区' || street || trim(replace(rest, street, '')) AS s FROM r)
SELECT id, trim(replace(replace(replace(regexp_replace(s, '#', '#', 'g'), '省', ''), '市', ''), '区', '')) AS standardized FROM j""")
def normalized_text(spark, d):
    rows = text.normalized(made_addresses(spark, d), "t", parse.SuffixParser())
    return rows.select("id", "standardized")


@register(f"""WITH {MADE}, q AS (SELECT id, t, lower(t) AS cleaned, lower(substring(t, 10)) AS rest FROM m), r AS (SELECT *, regexp_extract(rest, '(.+?[路街大道巷弄])', 1) AS street FROM q),
j AS (SELECT *, '浙江杭州西湖' || street || trim(replace(rest, street, '')) AS s FROM r)
SELECT id, t AS original, cleaned, '浙江省' AS province, '杭州市' AS city, '西湖区' AS district, street, s AS standardized, substring(md5(s), 1, 12) AS hash, true AS success FROM j
UNION ALL SELECT -id, '', '', NULL, NULL, NULL, NULL, '', '', false FROM m""")
def normalized_columns(spark, d):
    """The columns of normalised records, and those of records without an address."""
    made = made_addresses(spark, d)
    rows = text.normalized(made.unionByName(made.select((-F.col("id")).alias("id"), F.lit(None).cast("string").alias("t"))), "t", parse.SuffixParser())
    return rows.select("id", "original", "cleaned", "parsed.province", "parsed.city", "parsed.district", "parsed.street", "standardized", "hash", "success")


@register()
def normalized_records(spark, d):
    return text.normalized(made_addresses(spark, d), "t", parse.SuffixParser())


@register(f"WITH {MADE} SELECT count(*) AS n, 1.0::DOUBLE AS success_rate FROM m")
def normalization_success(spark, d):
    rows = text.normalized(made_addresses(spark, d), "t", parse.SuffixParser())
    return rows.agg(F.count("*").alias("n"), F.avg(F.col("success").cast("int")).alias("success_rate"))


# --- geocoding ---

OFFLINE = """o AS (SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN '{"offline_geocode":{"gcj02":"' || (100 + event_id % 20) || '.5,30.25","wgs84":"1,2"}}'
 WHEN 1 THEN '{"offline_geocode":{"gcj02":"x","wgs84":"120.5,' || (20 + event_id % 10) || '.5"}}' WHEN 2 THEN props ELSE NULL END AS doc, value FROM events)"""


def offline_events(spark, d):
    n = F.col("event_id")
    first = F.concat(F.lit('{"offline_geocode":{"gcj02":"'), (100 + n % 20).cast("string"), F.lit('.5,30.25","wgs84":"1,2"}}'))
    second = F.concat(F.lit('{"offline_geocode":{"gcj02":"x","wgs84":"120.5,'), (20 + n % 10).cast("string"), F.lit('.5"}}'))
    document = F.when(n % 4 == 0, first).when(n % 4 == 1, second).when(n % 4 == 2, F.col("props"))
    return read(spark, d, "events").select(n.alias("id"), document.alias("doc"), "value")


@register(f"""WITH {OFFLINE} SELECT id, CASE id % 4 WHEN 0 THEN 30.25::DOUBLE WHEN 1 THEN (20 + id % 10) + 0.5::DOUBLE END AS lat,
CASE id % 4 WHEN 0 THEN (100 + id % 20) + 0.5::DOUBLE WHEN 1 THEN 120.5::DOUBLE END AS lon FROM o""")
def json_coords(spark, d):
    return offline_events(spark, d).select("id", geo.offline_point(F.col("doc")).alias("p")).select("id", "p.lat", "p.lon")


@register(f"""WITH {OFFLINE} SELECT id, CASE id % 4 WHEN 0 THEN 30.25::DOUBLE WHEN 1 THEN (20 + id % 10) + 0.5::DOUBLE WHEN 2 THEN value ELSE NULL END AS lat,
CASE id % 4 WHEN 0 THEN (100 + id % 20) + 0.5::DOUBLE WHEN 1 THEN 120.5::DOUBLE WHEN 2 THEN 1.0::DOUBLE ELSE NULL END AS lon FROM o""")
def coord_fallback(spark, d):
    known = F.when(F.col("id") % 4 < 3, F.col("value"))
    info = F.struct(known.alias("latitude"), F.lit(1.0).alias("longitude"))
    return geocoding.with_coordinates(offline_events(spark, d).withColumn("geo_info", info), "doc").select("id", "lat", "lon")


@register("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 <> 2 THEN (CASE WHEN s_suppkey % 3 = 0 THEN 'first' ELSE 'second' END) END AS source,
CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal WHEN s_suppkey % 3 = 1 THEN 7.0::DOUBLE END AS latitude FROM supplier""")
def geocode_sources(spark, d):
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), "s_acctbal")
    first = geocoding.TableGeocoder(s.where("id % 3 = 0").select(F.col("name").alias("key"), F.col("s_acctbal").alias("latitude")), "first")
    second = geocoding.TableGeocoder(s.where("id % 3 < 2").select(F.upper("name").alias("key"), F.lit(7.0).alias("latitude")), "second")
    return geocoding.geocoded(s, "name", first, second).select("id", "geo_info.source", "geo_info.latitude")


@register("SELECT count(*) AS total, count(*) FILTER (WHERE s_suppkey % 2 = 0) AS found, avg((s_suppkey % 2 = 0)::INT) AS success_rate FROM supplier")
def geocode_stats(spark, d):
    s = read(spark, d, "supplier")
    table = geocoding.TableGeocoder(s.where("s_suppkey % 2 = 0").select(F.col("s_name").alias("key"), F.lit(1.0).alias("latitude")))
    return geocoding.geocode_stats(geocoding.geocoded(s, "s_name", table))


@register("SELECT CASE s_suppkey % 3 WHEN 0 THEN 'first' WHEN 1 THEN 'second' END AS source, count(*) AS n FROM supplier GROUP BY 1")
def geocode_source_stats(spark, d):
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    first = geocoding.TableGeocoder(s.where("id % 3 = 0").select(F.col("name").alias("key"), F.lit(1.0).alias("latitude")), "first")
    second = geocoding.TableGeocoder(s.where("id % 3 < 2").select(F.col("name").alias("key"), F.lit(2.0).alias("latitude")), "second")
    return geocoding.source_stats(geocoding.geocoded(s, "name", geocoding.NullGeocoder(), first, second))


@register("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 < 2 THEN s_acctbal END AS lon, CASE WHEN s_suppkey % 4 < 2 THEN 30.5::DOUBLE END AS lat FROM supplier""")
def given_coordinates(spark, d):
    """Coordinates of a user's columns: every fourth is no number, every fourth has one only."""
    n = F.col("s_suppkey") % 4
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.when(n == 2, F.lit("east")).otherwise(F.col("s_acctbal").cast("string")).alias("x"), F.when(n != 3, F.lit("30.5")).alias("y"))
    return geocoding.user_coordinates(s, "x", "y").select("id", "lon", "lat")


@register("SELECT p_partkey AS id, array_to_string(list_transform(generate_series(1, length(p_name) - 1), lambda i: substring(p_name, i, 2)), '|') AS segments FROM part")
def all_segments(spark, d):
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(geocoding.segments(F.col("p_name")), "|").alias("segments"))


@register("SELECT id, list_transform(generate_series(1, length(p_name) - 1), lambda i: substring(p_name, i, 2))[1] AS first, length(p_name) - 1 AS n FROM (SELECT p_partkey AS id, p_name FROM part)")
def segment_text(spark, d):
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("id"), geocoding.segments(F.col("p_name")).alias("s"))
    return rows.select("id", F.get("s", 0).alias("first"), F.size("s").cast("long").alias("n"))


# --- blocking ---


@register(f"WITH {CUSTOMERS}, {ADMIN_PAIRS} SELECT * FROM blocked")
def admin_pairs(spark, d):
    return blocking.admin_pairs(customers(spark, d))


#: Customers on a square of ten degrees, dense enough for neighbours at every size; the last two digits stand in for missing coordinates.
POINTS = """a AS (SELECT c_custkey AS id, 30 + (c_custkey * 3037 % 10000) / 1000.0::DOUBLE AS lat, CASE WHEN c_custkey % 100 <> 99 THEN -5 + (c_custkey * 7091 % 10000) / 1000.0::DOUBLE END AS lon FROM customer)"""


def points(spark: SparkSession, d: str) -> DataFrame:
    """Customers near each other, on both sides of longitude 0, where cells are twice as wide."""
    key = F.col("c_custkey")
    lon = F.when(key % 100 != 99, -5 + (key * 7091 % 10000) / F.lit(1000.0))
    return read(spark, d, "customer").select(key.alias("id"), (30 + (key * 3037 % 10000) / F.lit(1000.0)).alias("lat"), lon.alias("lon"))


@register(f"WITH {POINTS}, {GRID_PAIRS} SELECT * FROM grid")
def grid_pairs(spark, d):
    return blocking.spatial_pairs(points(spark, d))


@register(f"WITH {POINTS}, p AS (SELECT x.id AS id1, y.id AS id2, {HAVERSINE} AS km FROM a x JOIN a y ON x.id < y.id AND abs(x.lat - y.lat) < 0.2) SELECT id1, id2 FROM p WHERE km <= 12")
def near_pairs(spark, d):
    found = blocking.near_pairs(points(spark, d), points(spark, d), 12.0)
    return found.where("id < r_id").select(F.col("id").alias("id1"), F.col("r_id").alias("id2"))


SUPPLIERS = "s AS (SELECT s_suppkey AS id, s_name AS text FROM supplier)"


@register(f"""WITH {SUPPLIERS}, g AS (SELECT DISTINCT id, unnest(list_transform(generate_series(1, length(text) - 2), lambda i: substring(text, i, 3))) AS gram FROM s),
n AS (SELECT id, count(*) AS n FROM g GROUP BY id), h AS (SELECT x.id AS id1, y.id AS id2, count(*) AS shared FROM g x JOIN g y ON x.gram = y.gram AND x.id < y.id GROUP BY 1, 2)
SELECT id1, id2, round(shared / (a.n + b.n - shared)::DOUBLE, 6) AS jaccard FROM h JOIN n a ON a.id = id1 JOIN n b ON b.id = id2 WHERE shared / (a.n + b.n - shared)::DOUBLE >= 0.8""")
def ngram_pairs(spark, d):
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("text"))
    return blocking.ngram_pairs(s, 0.8).withColumn("jaccard", F.round("jaccard", 6))


@register()
def lsh_pairs(spark, d):
    parts = read(spark, d, "part").select(F.col("p_name").alias("text")).distinct().withColumn("id", F.xxhash64("text"))
    return blocking.lsh_pairs(parts, EngineConfig(minhash_permutations=64, lsh_threshold=0.5))


@register(f"WITH {CUSTOMERS}, {GRID_PAIRS}, {ADMIN_PAIRS} SELECT * FROM blocked UNION SELECT * FROM grid")
def candidate_union(spark, d):
    return pairs_of(spark, d)


# --- similarity ---


@register(f"WITH {POINTS}, {GRID_PAIRS} SELECT id1, id2, round({HAVERSINE}, 6) AS km, round({APPROX}, 6) AS approx, round(exp(-({HAVERSINE}) / 10.0), 6) AS sim FROM grid JOIN a x ON x.id = id1 JOIN a y ON y.id = id2")
def spatial_measures(spark, d):
    a = points(spark, d)
    both = blocking.spatial_pairs(a, carry=("lat", "lon"))
    four = [F.col(c) for c in ("lat1", "lon1", "lat2", "lon2")]
    km = geo.haversine_km(*four)
    return both.select("id1", "id2", F.round(km, 6).alias("km"), F.round(geo.approx_km(*four), 6).alias("approx"), F.round(geo.spatial_similarity(km, 10.0), 6).alias("sim"))


NAMES = "u AS (SELECT DISTINCT p_name AS name FROM part)"


def name_pairs(spark, d):
    names = read(spark, d, "part").select(F.col("p_name").alias("a")).distinct()
    return names.join(names.select(F.col("a").alias("b")), F.col("a") < F.col("b"))


@register(f"""WITH {NAMES} SELECT x.name AS a, y.name AS b, round({EDIT}, 6) AS edit, round(jaro_winkler_similarity(x.name, y.name), 6) AS jaro, round({CHARS}, 6) AS chars, round({COMBINED}, 6) AS combined
FROM u x JOIN u y ON x.name < y.name""")
def text_measures(spark, d):
    a, b = F.col("a"), F.col("b")
    return name_pairs(spark, d).select("a", "b", F.round(similarity.edit_similarity(a, b), 6).alias("edit"), F.round(similarity.jaro_winkler(a, b), 6).alias("jaro"), F.round(similarity.char_jaccard(a, b), 6).alias("chars"), F.round(similarity.text_similarity(a, b), 6).alias("combined"))


@register()
def minhash_measure(spark, d):
    return name_pairs(spark, d).select("a", "b", similarity.text_similarity(F.col("a"), F.col("b"), "minhash").alias("minhash"))


@register(f"WITH {CUSTOMERS}, {ADMIN_PAIRS} SELECT id1, id2, round({ADMIN}, 6) AS sim FROM blocked JOIN a x ON x.id = id1 JOIN a y ON y.id = id2")
def admin_measure(spark, d):
    a = customers(spark, d)
    both = blocking.admin_pairs(a, carry=("province", "city", "district"))
    part = lambda t: {c: F.col(f"{c}{t}") for c in ("province", "city", "district")}
    return both.select("id1", "id2", F.round(similarity.administrative_similarity(part(1), part(2)), 6).alias("sim"))


@register(f"{SCORED} SELECT id1, id2, round(c, 6) AS comprehensive, round(t, 6) AS txt, round(s, 6) AS spatial, round(m, 6) AS administrative, round(km, 6) AS km, 0.4 * t + 0.4 * s + 0.2 * m >= 0.85 AS is_similar FROM scores")
def comprehensive(spark, d):
    s = tiles.scored(customers(spark, d), digits=6)
    return s.select("id1", "id2", F.col("comprehensive_similarity").alias("comprehensive"), F.col("text_similarity").alias("txt"), F.col("spatial_similarity").alias("spatial"), F.col("administrative_similarity").alias("administrative"), F.col("distance_km").alias("km"), "is_similar")


@register(f"{SCORED} SELECT id1, id2, round(c, 6) AS sim FROM scores WHERE c >= {THRESHOLD}")
def similar_edges(spark, d):
    return tiles.edges(customers(spark, d), THRESHOLD).withColumn("sim", F.round("sim", 6))


@register("""WITH e AS (SELECT l_suppkey % 40 AS r, l_partkey % 40 AS c, l_quantity AS v FROM lineitem),
b AS (SELECT r, c, v FROM e WHERE v >= 10 UNION ALL SELECT c, r, v FROM e WHERE v >= 10) SELECT r AS "row", c AS col, sum(v) AS value FROM b GROUP BY 1, 2""")
def sparse_symmetric(spark, d):
    e = read(spark, d, "lineitem").select((F.col("l_suppkey") % 40).alias("row"), (F.col("l_partkey") % 40).alias("col"), F.col("l_quantity").alias("value"))
    return scoring.symmetric(e, 10)


@register("""WITH e AS (SELECT l_linenumber AS block, l_suppkey AS r, l_partkey AS c, l_quantity AS v FROM lineitem), n AS (SELECT block, max(greatest(r, c)) + 1 AS n FROM e GROUP BY block),
o AS (SELECT block, coalesce(sum(n) OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM n) SELECT r + o AS "row", c + o AS col, v AS value FROM e JOIN o USING (block)""")
def block_diag(spark, d):
    e = read(spark, d, "lineitem").select(F.col("l_linenumber").alias("block"), F.col("l_suppkey").alias("row"), F.col("l_partkey").alias("col"), F.col("l_quantity").alias("value"))
    return scoring.block_diagonal(e, e.groupBy("block").agg((F.max(F.greatest("row", "col")) + 1).alias("n")))


# --- clustering: a sparse graph over customers whose edges follow from their keys ---

GRAPH = """
v AS (SELECT c_custkey AS id, 20 + (c_custkey * 37 % 3000) / 100.0::DOUBLE AS lat, 75 + (c_custkey * 91 % 6000) / 100.0::DOUBLE AS lon FROM customer),
e AS (SELECT id AS id1, id + 1 + id % 3 AS id2, 0.5 + (id * 7 % 50) / 100.0::DOUBLE AS sim FROM v WHERE id % 5 <> 0 AND id + 1 + id % 3 < (SELECT count(*) FROM v))"""


def graph(spark, d) -> tuple[DataFrame, DataFrame]:
    c = read(spark, d, "customer")
    key = F.col("c_custkey")
    nodes = c.select(key.alias("id"), (20 + (key * 37 % 3000) / F.lit(100.0)).alias("lat"), (75 + (key * 91 % 6000) / F.lit(100.0)).alias("lon"))
    id2 = F.col("id") + 1 + F.col("id") % 3
    edges = nodes.where(F.col("id") % 5 != 0).select(F.col("id").alias("id1"), id2.alias("id2"), (0.5 + (F.col("id") * 7 % 50) / F.lit(100.0)).alias("sim"))
    return nodes, edges.join(F.broadcast(nodes.agg(F.count("*").alias("n"))), F.lit(True)).where("id2 < n").drop("n")


def components_sql(name: str, nodes: str, links: str) -> str:
    return f"""{name}_both AS (SELECT id1 AS p, id2 AS q FROM {links} UNION ALL SELECT id2, id1 FROM {links}),
{name}_walk(id, r) AS (SELECT id, id FROM {nodes} UNION SELECT q, r FROM {name}_walk JOIN {name}_both ON p = {name}_walk.id),
{name} AS (SELECT id, dense_rank() OVER (ORDER BY r) - 1 AS label FROM (SELECT id, min(r) AS r FROM {name}_walk GROUP BY id))"""


STRONG = "strong AS (SELECT id1, id2 FROM e WHERE sim >= 0.6)"
LABELS = f"WITH RECURSIVE {GRAPH}, {STRONG}, {components_sql('l', 'v', 'strong')}"


def graph_labels(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes, edges = graph(spark, d)
    return nodes, edges, clustering.connected(nodes, edges, 0.6)


@register(f"{LABELS} SELECT id, label FROM l")
def connected_components(spark, d):
    return graph_labels(spark, d)[2]


@register(f"WITH RECURSIVE {GRAPH}, close AS (SELECT id1, id2 FROM e WHERE 1 - sim < 0.35), {components_sql('l', 'v', 'close')} SELECT id, label FROM l")
def single_linkage(spark, d):
    nodes, edges = graph(spark, d)
    return clustering.hierarchical(nodes, edges, distance_threshold=0.35, linkage="single")


@register(f"""WITH RECURSIVE {GRAPH}, near AS (SELECT id1, id2 FROM e JOIN v x ON x.id = id1 JOIN v y ON y.id = id2 WHERE sim >= 0.6 AND {HAVERSINE} <= 150), {components_sql('l', 'v', 'near')} SELECT id, label FROM l""")
def spatial_components(spark, d):
    nodes, edges = graph(spark, d)
    return clustering.connected_within(nodes, edges, EngineConfig(similarity_threshold=0.6, max_radius_km=150.0))


@register(f"""{LABELS}, z AS (SELECT label, count(*) AS k, min(id) AS f FROM l GROUP BY label), b AS (SELECT label AS top FROM z ORDER BY k DESC, f LIMIT 1)
SELECT id, CASE WHEN k < 2 THEN top ELSE l.label END AS label FROM l JOIN z USING (label), b""")
def merge_small(spark, d):
    return clustering.merge_small(graph_labels(spark, d)[2])


@register(f"""{LABELS}, q AS (SELECT DISTINCT least(x.label, y.label) AS id1, greatest(x.label, y.label) AS id2 FROM e JOIN l x ON x.id = id1 JOIN l y ON y.id = id2 WHERE sim >= 0.55 AND x.label <> y.label),
w AS (SELECT DISTINCT label AS id FROM l), q_both AS (SELECT id1 AS p, id2 AS q FROM q UNION ALL SELECT id2, id1 FROM q), q_walk(id, r) AS (SELECT id, id FROM w UNION SELECT q, r FROM q_walk JOIN q_both ON p = q_walk.id),
m AS (SELECT id AS label, min(r) AS new FROM q_walk GROUP BY id) SELECT l.id, new AS label FROM l JOIN m USING (label)""")
def optimize_clusters(spark, d):
    _, edges, labels = graph_labels(spark, d)
    return clustering.optimize(labels, edges, 0.55)


@register(f"""WITH RECURSIVE {GRAPH}, g AS (SELECT id, id // 10 AS label FROM v), inner_e AS (SELECT id1, id2 FROM e JOIN g x ON x.id = id1 JOIN g y ON y.id = id2 WHERE sim >= 0.7 AND x.label = y.label),
z AS (SELECT label, count(*) AS k FROM g GROUP BY label), {components_sql('c', 'v', 'inner_e')},
mm AS (SELECT label, count(*) AS m FROM inner_e JOIN g ON g.id = id1 GROUP BY label),
loose AS (SELECT z.label FROM z LEFT JOIN mm USING (label) WHERE k > 2 AND coalesce(m, 0) < k * (k - 1) / 2),
parts AS (SELECT g.label, c.label AS part, min(g.id) AS f FROM g JOIN loose USING (label) JOIN c USING (id) GROUP BY 1, 2),
ranked AS (SELECT label, part, row_number() OVER (PARTITION BY label ORDER BY f) - 1 AS sub, count(*) OVER (PARTITION BY label) AS n FROM parts),
skips AS (SELECT label, coalesce(sum(n) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS skip FROM (SELECT DISTINCT label, n FROM ranked))
SELECT g.id, CAST(CASE WHEN sub IS NULL OR sub = 0 THEN g.label ELSE (SELECT max(label) FROM g) + 1 + skip + sub END AS BIGINT) AS label
FROM g JOIN c USING (id) LEFT JOIN ranked ON ranked.label = g.label AND ranked.part = c.label LEFT JOIN skips ON skips.label = g.label""")
def validate_clusters(spark, d):
    nodes, edges = graph(spark, d)
    return clustering.validate(nodes.select("id", F.floor(F.col("id") / 10).alias("label")), edges, 0.7)


@register(f"""WITH RECURSIVE {GRAPH}, close AS (SELECT id1, id2 FROM e WHERE 1 - sim <= 0.3), b AS (SELECT id1 AS p, id2 AS q FROM close UNION ALL SELECT id2, id1 FROM close),
core AS (SELECT v.id FROM v LEFT JOIN (SELECT p, count(*) AS n FROM b GROUP BY p) ON p = id WHERE coalesce(n, 0) + 1 >= 3),
inner_e AS (SELECT id1, id2 FROM close WHERE id1 IN (SELECT id FROM core) AND id2 IN (SELECT id FROM core)),
c_both AS (SELECT id1 AS p, id2 AS q FROM inner_e UNION ALL SELECT id2, id1 FROM inner_e), c_walk(id, r) AS (SELECT id, id FROM core UNION SELECT q, r FROM c_walk JOIN c_both ON p = c_walk.id),
c AS (SELECT id, min(r) AS r FROM c_walk GROUP BY id), border AS (SELECT p AS id, min(r) AS r FROM b JOIN c ON q = c.id GROUP BY p),
f AS (SELECT v.id, coalesce(c.r, border.r) AS r FROM v LEFT JOIN c USING (id) LEFT JOIN border USING (id)), firsts AS (SELECT r, min(id) AS m FROM f WHERE r IS NOT NULL GROUP BY r), ranks AS (SELECT r, row_number() OVER (ORDER BY m) - 1 AS label FROM firsts)
SELECT id, coalesce(label, -1) AS label FROM f LEFT JOIN ranks USING (r)""")
def dbscan(spark, d):
    nodes, edges = graph(spark, d)
    return clustering.dbscan(nodes, edges, 0.3, 3)


@register()
def agglomerative(spark, d):
    nodes, edges = graph(spark, d)
    return clustering.hierarchical(nodes, edges, distance_threshold=0.4)


# --- metrics ---


@register(f"""{LABELS}, r AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY id) AS n FROM l), z AS (SELECT label, count(*) AS k, least(count(*), 5) AS m FROM l GROUP BY label),
p AS (SELECT sim, x.label = y.label AS same, x.n <= 5 AND y.n <= 5 AS sampled FROM e JOIN r x ON x.id = id1 JOIN r y ON y.id = id2),
w AS (SELECT (SELECT count(*) FROM z) AS n_clusters, (SELECT sum(k * (k - 1) / 2) FROM z) AS ip, (SELECT (pow(sum(m), 2) - sum(m * m)) / 2 FROM z) AS op, coalesce(sum(sim) FILTER (WHERE same), 0) AS i, coalesce(sum(sim) FILTER (WHERE NOT same AND sampled), 0) AS o FROM p),
b AS (SELECT id1 AS i, id2 AS j, sim FROM e UNION ALL SELECT id2, id1, sim FROM e),
near AS (SELECT b.i, sum(sim) AS s FROM b JOIN l x ON x.id = b.i JOIN l y ON y.id = b.j WHERE x.label = y.label GROUP BY b.i),
far AS (SELECT i, max(s / m) AS f FROM (SELECT b.i, y.label, sum(sim) AS s FROM b JOIN l x ON x.id = b.i JOIN r y ON y.id = b.j WHERE x.label <> y.label AND y.n <= 5 GROUP BY 1, 2) JOIN z USING (label) GROUP BY i),
pts AS (SELECT 1 - coalesce(s, 0) / (k - 1) AS a, 1 - coalesce(f, 0) AS bb FROM l JOIN z USING (label) LEFT JOIN near ON near.i = id LEFT JOIN far ON far.i = id WHERE k > 1)
SELECT n_clusters, round(i / ip, 6) AS avg_similarity_within, round(o / op, 6) AS avg_similarity_between, round((SELECT avg((bb - a) / greatest(a, bb)) FROM pts), 6) AS silhouette_score, round((i / ip) / (o / op), 4) AS within_between_ratio FROM w""")
def quality(spark, d):
    _, edges, labels = graph_labels(spark, d)
    q = metrics.quality(labels, edges)
    return q.select("n_clusters", *[F.round(c, 6).alias(c) for c in ("avg_similarity_within", "avg_similarity_between", "silhouette_score")], F.round("within_between_ratio", 4).alias("within_between_ratio"))


@register("""WITH m AS (SELECT c_nationkey AS label, c_custkey AS id, c_mktsegment AS t FROM customer), f AS (SELECT label, t, count(*) AS n, min(id) AS f FROM m GROUP BY 1, 2),
best AS (SELECT label, t, row_number() OVER (PARTITION BY label ORDER BY n DESC, f) AS r FROM f), x AS (SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY id) AS r FROM m)
SELECT label::BIGINT AS cluster_id, (SELECT count(*) FROM m b WHERE b.label = a.label) AS size, (SELECT t FROM best WHERE best.label = a.label AND r = 1) AS representative_address, min(id) AS first_id,
round(avg(20 + (id * 37 % 3000) / 100.0::DOUBLE), 6) AS avg_latitude FROM m a GROUP BY label""")
def summary(spark, d):
    a = customers(spark, d)
    labels = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("label"))
    s = metrics.cluster_summary(labels, a.withColumn("standardized", F.col("district")))
    return s.select("cluster_id", "size", "representative_address", F.get("member_ids", 0).alias("first_id"), F.round("avg_latitude", 6).alias("avg_latitude"))


@register(f"{LABELS}, z AS (SELECT count(*) AS k FROM l GROUP BY label) SELECT count(*) AS n, round(avg(k), 6) AS mean, round(stddev(k), 6) AS std, min(k) AS min, quantile_cont(k, 0.25)::DOUBLE AS q25, quantile_cont(k, 0.5)::DOUBLE AS q50, quantile_cont(k, 0.75)::DOUBLE AS q75, max(k) AS max FROM z")
def size_describe(spark, d):
    s = metrics.describe_sizes(graph_labels(spark, d)[2])
    return s.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@register(f"{LABELS} SELECT id, label, lat, lon, label % 20 AS colour FROM l JOIN v USING (id)")
def map_points(spark, d):
    nodes, _, labels = graph_labels(spark, d)
    return metrics.map_points(nodes.join(labels, "id")).select("id", "label", "lat", "lon", "colour")


@register("SELECT count(*) AS total, 5.0::DOUBLE AS duration_s, count(*) / 5.0::DOUBLE AS per_second FROM customer")
def run_statistics(spark, d):
    return metrics.run_stats(10.0, 15.0, {"total": read(spark, d, "customer").count()}, spark)


@register(f"{LABELS} SELECT label, count(*) AS n FROM l GROUP BY label")
def label_counts(spark, d):
    return metrics.label_counts(graph_labels(spark, d)[2])


@register("""WITH x AS (SELECT length(text) AS v FROM documents), b AS (SELECT min(v) AS lo, max(v) AS hi FROM x) SELECT least(floor((v - lo) / (hi - lo)::DOUBLE * 50), 49)::BIGINT AS bin, count(*) AS n FROM x, b GROUP BY 1""")
def hist_len(spark, d):
    return metrics.length_histogram(read(spark, d, "documents"), "text")


@register("SELECT ts::DATE AS day, count(DISTINCT user_id) AS clusters FROM events GROUP BY 1")
def clusters_per_day(spark, d):
    return metrics.clusters_per_day(read(spark, d, "events"), "ts", "user_id")


@register(f"WITH {CUSTOMERS} SELECT round(avg((balance > 0)::INT), 6) AS rate FROM a")
def success_rate(spark, d):
    return metrics.rate(customers(spark, d), F.col("balance") > 0, "rate").select(F.round("rate", 6).alias("rate"))


@register(f"""WITH {CUSTOMERS}, b AS (SELECT min(lat) AS la, max(lat) AS lb, min(lon) AS oa, max(lon) AS ob FROM a)
SELECT least(floor((lon - oa) / (ob - oa) * 50), 49)::BIGINT AS gx, least(floor((lat - la) / (lb - la) * 50), 49)::BIGINT AS gy, count(*) AS n FROM a, b GROUP BY 1, 2""")
def density_grid(spark, d):
    return metrics.density_grid(customers(spark, d))


@register(f"WITH {CUSTOMERS} SELECT round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM a")
def map_center(spark, d):
    return metrics.map_centre(customers(spark, d)).select(F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@register(f"{SCORED}, k AS (SELECT unnest([{{'m': 'comprehensive', 'v': round(c, 9)}}, {{'m': 'text', 'v': round(t, 9)}}, {{'m': 'spatial', 'v': round(s, 9)}}, {{'m': 'administrative', 'v': round(m, 9)}}]) AS z FROM scores) SELECT z.m AS measure, least(floor(z.v * 50), 49)::BIGINT AS bin, count(*) AS n FROM k GROUP BY 1, 2")
def hist_similarity(spark, d):
    return tiles.histograms(customers(spark, d))


# --- sinks ---


@register(f"{LABELS}, z AS (SELECT label, count(*) AS k FROM l GROUP BY label) SELECT id, 'group_' || l.label AS group_id, k::INT AS group_size FROM l JOIN z USING (label)")
def update_groups(spark, d):
    nodes, _, labels = graph_labels(spark, d)
    table = nodes.select("id", F.lit(None).cast("string").alias("group_id"), F.lit(0).alias("group_size"))
    return sinks.updated_groups(table, labels)


@register("""SELECT p_partkey AS id, CASE WHEN p_name LIKE 'red%' THEN 'g_' || p_name END AS group_id, CASE WHEN p_name LIKE 'red%' THEN length(p_name) END AS group_size FROM part""")
def backfill_by_text(spark, d):
    parts = read(spark, d, "part")
    names = parts.where("p_name like 'red%'").select(F.col("p_name").alias("address")).distinct()
    groups = names.select("address", F.concat(F.lit("g_"), "address").alias("group_id"), F.char_length("address").cast("long").alias("group_size"))
    return sinks.updated_by_text(parts.select(F.col("p_partkey").alias("id"), "p_name"), groups, "p_name").select("id", "group_id", "group_size")


@register("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'new_cluster_r1_' || (c_custkey // 3 + 1) ELSE 'g' || (c_custkey % 3) END AS group_id, 1 AS group_size, CASE WHEN c_custkey % 3 = 0 THEN 0.0 ELSE 0.9 END::DOUBLE AS similarity FROM customer")
def new_cluster_ids(spark, d):
    c = read(spark, d, "customer")
    group = F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("g"), F.col("c_custkey") % 3))
    matches = c.select(F.col("c_custkey").alias("address_id"), group.alias("group_id"), F.lit(0.9).alias("similarity"), F.col("c_name").alias("original"), F.col("c_name").alias("standardized"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"))
    return sinks.incremental_rows(matches, "r1").select("id", "group_id", "group_size", F.col("similarity_score").cast("double").alias("similarity"))


@register("SELECT DISTINCT c_custkey AS id, 'group_' || c_nationkey AS group_id, (count(*) OVER (PARTITION BY c_nationkey))::INT AS group_size FROM customer")
def clustering_rows(spark, d):
    labels = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("label"))
    return sinks.clustering_rows(labels, customers(spark, d)).select("id", "group_id", "group_size")


@register("""SELECT DISTINCT c_custkey AS id, 'group_' || c_nationkey AS group_id, c_name AS processed_address, (count(*) OVER (PARTITION BY c_nationkey))::INT AS group_size, 0.4::DOUBLE AS text_weight, 0.4::DOUBLE AS spatial_weight,
3.0::DOUBLE AS spatial_threshold_km, 0.5::DOUBLE AS dbscan_eps, 2 AS dbscan_min_samples FROM customer""")
def cluster_result_rows(spark, d):
    labels = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("label"))
    rows = sinks.cluster_result_rows(labels, customers(spark, d))
    return rows.select("id", "group_id", "processed_address", "group_size", "text_weight", "spatial_weight", "spatial_threshold_km", "dbscan_eps", "dbscan_min_samples")


@register("SELECT p_partkey AS id, p_name FROM part ORDER BY p_partkey LIMIT 1 OFFSET 17")
def by_index(spark, d):
    return tables.by_index(read(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name"), 17)


# --- files and tables: what is written is read back ---


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return f"{shared_folder(spark)}/{uuid.uuid4()}"


def part_rows(spark: SparkSession, d: str) -> DataFrame:
    """Parts, with names that hold quotes, commas and letters beyond ASCII."""
    name = F.concat(F.when(F.col("p_partkey") % 3 == 0, F.lit('文三路"20,5"号')).otherwise(F.lit("")), "p_name")
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), name.alias("name"), F.col("p_size").cast("long").alias("size"))


PART_ROWS = """r AS (SELECT p_partkey AS id, (CASE WHEN p_partkey % 3 = 0 THEN '文三路"20,5"号' ELSE '' END) || p_name AS name, p_size::BIGINT AS size FROM part)"""


def typed(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("id").cast("long").alias("id"), "name", F.col("size").cast("long").alias("size"))


@register(f"WITH {PART_ROWS} SELECT id, name, size FROM r")
def csv_detected(spark, d):
    """CSV files whose encoding is found from their beginning."""
    path = f"{scratch(spark)}/parts.csv"
    part_rows(spark, d).write.option("header", True).option("escape", '"').csv(path)
    return typed(tables.read_csv_any(spark, path))


@register(f"WITH {PART_ROWS} SELECT id, name, size FROM r")
def json_file(spark, d):
    path = f"{scratch(spark)}/parts.json"
    sinks.save(part_rows(spark, d), path)
    return tables.load_file(spark, path, schema="id long, name string, size long")


@register(f"WITH {PART_ROWS} SELECT id, name, size FROM r WHERE size > 25")
def parquet_overwritten(spark, d):
    """A table replaced by a part of itself."""
    path = f"{scratch(spark)}/parts.parquet"
    sinks.save(part_rows(spark, d), path)
    sinks.overwrite(tables.load_file(spark, path).where("size > 25"), path)
    return tables.load_file(spark, path)


@register("SELECT c_custkey AS id, c_mktsegment AS segment, c_nationkey AS nation FROM customer")
def parts_merged(spark, d):
    """Files of at most 100 rows, merged into one and gzipped and plain again."""
    at = scratch(spark)
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    sinks.save_parts(c, f"{at}/parts", 100)
    sinks.merge_parts(spark, f"{at}/parts", f"{at}/one")
    sinks.compress(spark, f"{at}/one", f"{at}/zipped")
    sinks.decompress(spark, f"{at}/zipped", f"{at}/plain.csv")
    return tables.load_file(spark, f"{at}/plain.csv").selectExpr("cast(id as long) id", "segment", "cast(nation as int) nation")


@register("SELECT (count(*) + 99) // 100 AS files FROM customer")
def split_files(spark, d):
    """How many files of 100 rows a table makes, by their listing."""
    path = scratch(spark)
    sinks.save_parts(read(spark, d, "customer").coalesce(1), path, 100)
    return tables.file_info(spark, f"{path}/*.csv").where("bytes > 0").agg(F.count("*").alias("files"))


@register("SELECT n_nationkey::VARCHAR AS id, 'second' AS run FROM nation")
def newest_output(spark, d):
    at = scratch(spark)
    for run in ("first", "second"):
        sinks.save(read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.lit(run).alias("run")).coalesce(1), f"{at}/{run}.csv")
    return tables.newest(spark, f"{at}/*.csv/part-*")


@register("SELECT s_suppkey AS id, upper(s_name) AS name FROM supplier")
def csv_in_chunks(spark, d):
    path = f"{scratch(spark)}/suppliers.csv"
    sinks.save(read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), path)
    return tables.process_csv(spark, path, lambda f: f.assign(id=f["id"].astype("int64"), name=f["name"].str.upper()), "id long, name string", 64)


@register(f"WITH {CUSTOMERS}, {ADMIN_PAIRS} SELECT id1, id2, (id1 % 100) / 100.0::DOUBLE AS sim FROM blocked")
def matrix_on_disk(spark, d):
    """A similarity matrix written as its edges and loaded."""
    path = f"{scratch(spark)}/edges"
    sinks.save_edges(blocking.admin_pairs(customers(spark, d)).withColumn("sim", (F.col("id1") % 100) / F.lit(100.0)), path)
    return tables.load_edges(spark, path)


@register("SELECT DISTINCT s_name AS name, s_acctbal AS latitude, 'disk' AS source FROM supplier WHERE s_suppkey % 3 = 0")
def cache_on_disk(spark, d):
    """What one geocoder found, saved, and used as the next run's geocoder."""
    path = f"{scratch(spark)}/cache"
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), "s_acctbal")
    first = geocoding.TableGeocoder(s.where("id % 3 = 0").select(F.col("name").alias("key"), F.col("s_acctbal").alias("latitude")), "first")
    sinks.save_cache(geocoding.geocoded(s, "name", first), "name", path)
    saved = geocoding.TableGeocoder(spark.read.schema("key string, latitude double").json(path), "disk")
    return geocoding.geocoded(s, "name", geocoding.NullGeocoder(), saved).where("geo_info is not null").select("name", "geo_info.latitude", "geo_info.source").distinct()


@register(f"WITH {PART_ROWS} SELECT id, name, size FROM r")
def backed_up(spark, d):
    return tables.load_file(spark, sinks.backup(part_rows(spark, d), scratch(spark), "20240101_000000"), schema="id long, name string, size long")


def result_table(spark: SparkSession) -> str:
    """The name of a new result table, whose files are in a scratch folder and outlast it."""
    name = f"postalloom_{uuid.uuid4().hex}"
    sinks.create_result_table(spark, name, scratch(spark))
    return name


@register("""WITH t AS (SELECT s_suppkey AS id, s_name AS a FROM supplier)
SELECT id, NULL::VARCHAR AS group_id, 0 AS group_size, a AS original_address, a AS standardized_address, NULL::DOUBLE AS similarity_score FROM t
UNION ALL SELECT id + 1000000, CASE WHEN id % 2 = 0 THEN 'g1' ELSE 'new_cluster_r_' || ((id + 1) // 2) END, 1, a, a, CASE WHEN id % 2 = 0 THEN 0.75 ELSE 0 END::DOUBLE FROM t
UNION ALL SELECT id + 2000000, 'group_' || (id % 4), (count(*) OVER (PARTITION BY id % 4))::INT, a, a, 1.0::DOUBLE FROM t""")
def appended_results(spark, d):
    """A result table made by its definition, with three appends: normalised rows, matched new rows and clustered rows."""
    name = result_table(spark)
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("original"), F.col("s_name").alias("standardized"), F.lit(30.0).alias("lat"), F.lit(120.0).alias("lon"))
    sinks.append(sinks.normalisation_rows(s.withColumns({"cleaned": F.col("original"), "corrected": F.col("original")})), name)
    matches = s.withColumns({"address_id": F.col("id") + 1_000_000, "group_id": F.when(F.col("id") % 2 == 0, F.lit("g1")), "similarity": F.lit(0.75)})
    sinks.append(sinks.incremental_rows(matches, "r"), name, 2)
    later = s.withColumn("id", F.col("id") + 2_000_000)
    sinks.append(sinks.clustering_rows(later.select("id", (F.col("id") % 4).alias("label")), later), name)
    done = tables.open_table(spark, name)
    path = spark.sql(f"DESCRIBE FORMATTED {name}").where("col_name = 'Location'").first()["data_type"]
    rows = spark.read.schema(done.schema).parquet(path)
    spark.sql(f"DROP TABLE {name}")
    return rows.select("id", "group_id", "group_size", "original_address", "standardized_address", F.col("similarity_score").cast("double").alias("similarity_score"))


@register(f"{LABELS} SELECT 'sizes' AS report, label::VARCHAR AS key, count(*) AS n FROM l GROUP BY label UNION ALL SELECT 'labels', label::VARCHAR, id FROM l")
def saved_report(spark, d):
    """Frames of a run saved under their names and read back."""
    path = scratch(spark)
    labels = graph_labels(spark, d)[2]
    sinks.results({"sizes": metrics.label_counts(labels), "labels": labels}, path)
    sizes, members = tables.load_file(spark, f"{path}/sizes.csv"), tables.load_file(spark, f"{path}/labels.csv")
    one = sizes.select(F.lit("sizes").alias("report"), F.col("label").alias("key"), F.col("n").cast("long").alias("n"))
    return one.unionByName(members.select(F.lit("labels").alias("report"), F.col("label").alias("key"), F.col("id").cast("long").alias("n")))


# --- incremental, execution, whole runs ---


@register(f"""WITH {CUSTOMERS}, n AS (SELECT * FROM a WHERE id % 10 = 0), g AS (SELECT * FROM a WHERE id % 10 <> 0),
s AS (SELECT x.id AS address_id, y.id AS rep, round(least(1.0, 0.4 * ({COMBINED}) + 0.4 * coalesce(exp(-({HAVERSINE}) / 10.0), 0.0) + 0.2 * ({ADMIN})), 12) AS sim FROM n x JOIN g y ON abs(x.lat - y.lat) < 0.3),
b AS (SELECT *, row_number() OVER (PARTITION BY address_id ORDER BY sim DESC, rep) AS r FROM s WHERE sim >= 0.7)
SELECT n.id AS address_id, 'g' || rep AS group_id, round(sim, 6) AS similarity, rep IS NULL AS is_new_cluster FROM n LEFT JOIN b ON b.address_id = n.id AND r = 1""")
def incremental_match(spark, d):
    a = customers(spark, d)
    reps = a.where("id % 10 <> 0").select(F.concat(F.lit("g"), "id").alias("group_id"), F.col("id").alias("rep_pos"), "standardized", "lat", "lon", "province", "city", "district", "street")
    found = incremental.match(a.where("id % 10 = 0"), reps, 0.7)
    return found.select("address_id", "group_id", F.round("similarity", 6).alias("similarity"), "is_new_cluster")


@register("SELECT count(*) AS n FROM orders WHERE o_orderdate > TIMESTAMP '1998-06-01' - INTERVAL 1 DAY")
def high_water_mark(spark, d):
    return incremental.after(read(spark, d, "orders"), "o_orderdate", "1998-06-01 00:00:00").agg(F.count("*").alias("n"))


@register("SELECT count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem")
def map_reduce_sum(spark, d):
    lines = read(spark, d, "lineitem").select(F.lit(1).cast("long").alias("n"), F.col("l_quantity").alias("quantity"))
    total = lambda f: f.sum().to_frame().T.astype({"n": "int64"})
    return execution.map_reduce(lines, total, total, "n long, quantity double").select("n", F.round("quantity", 2).alias("quantity"))


@register("SELECT c_custkey AS id, c_acctbal * 2 AS doubled FROM customer")
def map_column_double(spark, d):
    return execution.map_column(read(spark, d, "customer"), "c_acctbal", lambda x: x * 2, "double", "doubled").select(F.col("c_custkey").alias("id"), "doubled")


@register("SELECT s_suppkey AS id, length(s_name) AS n FROM supplier")
def map_batches(spark, d):
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return execution.map_batches(s, lambda f: f.assign(n=f["name"].str.len().astype("int64"))[["id", "n"]], "id long, n long")


@register("SELECT s_suppkey AS id, upper(s_name) AS name FROM supplier WHERE s_suppkey % 2 = 0")
def processed_stream(spark, d):
    """All files of a folder as a stream, batch by batch."""
    at = scratch(spark)
    source = f"{at}/in"
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    s.repartition(3).write.parquet(source)
    records = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(source)
    streams.process_stream(records, lambda b: b.where("id % 2 = 0").select("id", F.upper("name").alias("name")), f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return spark.read.schema(s.schema).parquet(f"{at}/out").select("id", "name")


@register(f"WITH RECURSIVE {SCORED[5:]}, k AS (SELECT id1, id2 FROM scores WHERE c >= {THRESHOLD}), {components_sql('l', 'a', 'k')} SELECT label AS cluster_id, count(*) AS size, min(id) AS first_id FROM l GROUP BY label")
def resolve_customers(spark, d):
    labels = tiles.connected(customers(spark, d), THRESHOLD)
    return labels.groupBy(F.col("label").alias("cluster_id")).agg(F.count("*").alias("size"), F.min("id").alias("first_id"))


@register()
def full_run_customers(spark, d):
    table = customers(spark, d).select("id", F.col("original").alias("name"), F.to_json(F.struct(F.struct(F.concat_ws(",", "lon", "lat").alias("gcj02")).alias("offline_geocode"))).alias("offline_geocode"))
    _, rows = pipeline.full_run(table, "name")
    return rows


#: Addresses whose groups are known: three near each other for every house, 11 km from the next house; of every fifth house the third is 5 km off.
HOUSES = "h AS (SELECT c_custkey AS id, c_custkey // 3 AS house, c_custkey % 3 = 2 AS later, c_custkey % 15 = 2 AS far FROM customer)"


def houses(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    house, variant = F.expr("c_custkey div 3"), key % 3
    name = F.concat(F.lit("浙江省杭州市西湖区文三路"), house, F.lit("号"), F.when(variant == 1, F.lit("楼")).otherwise(F.lit("")))
    lat = 20 + house % 400 * 0.1 + variant * 0.001 + F.when(key % 15 == 2, 0.05).otherwise(0.0)
    offline = F.to_json(F.struct(F.struct(F.concat_ws(",", 75 + F.expr("c_custkey div 1200") * 0.1, lat).alias("gcj02")).alias("offline_geocode")))
    made = F.when(variant == 2, F.lit("2024-01-02 00:00:00")).otherwise(F.lit("2024-01-01 00:00:00")).cast("timestamp")
    return read(spark, d, "customer").select(key.alias("id"), name.alias("address"), offline.alias("offline_geocode"), made.alias("create_time"))


@register(f"""WITH {HOUSES}, k AS (SELECT *, min(id) OVER w AS first, count(*) OVER w AS n FROM h WINDOW w AS (PARTITION BY house, far))
SELECT id, 'group_' || (dense_rank() OVER (ORDER BY first) - 1) AS group_id, n::INT AS group_size FROM k""")
def full_run_houses(spark, d):
    """A whole run with default settings: normalised, placed, blocked, scored, grouped and validated."""
    _, rows = pipeline.full_run(houses(spark, d), "address")
    return rows.select("id", "group_id", "group_size")


def old_houses(spark: SparkSession, d: str) -> DataFrame:
    _, rows = pipeline.full_run(houses(spark, d).where("id % 3 < 2"), "address")
    return sinks.as_results(rows)


@register(f"""WITH {HOUSES} SELECT id, CASE WHEN far THEN 'new_cluster_r_' || row_number() OVER (PARTITION BY far ORDER BY id) ELSE 'group_' || house END AS group_id, 1 AS group_size FROM h WHERE later""")
def incremental_run_houses(spark, d):
    """The records of a second day, matched to the groups of a whole run over the first."""
    rows = pipeline.incremental_run(houses(spark, d), "address", old_houses(spark, d), "2024-01-01 12:00:00", "r")
    return rows.select("id", "group_id", "group_size")


@register(f"""WITH {HOUSES} SELECT id, CASE WHEN far THEN 'new_cluster_0_' || row_number() OVER (PARTITION BY far ORDER BY id) ELSE 'house_' || house END AS group_id, 1 AS group_size FROM h WHERE later""")
def matched_stream(spark, d):
    """The same as a stream, in which every record comes twice."""
    at = scratch(spark)
    placed = pipeline.prepared(houses(spark, d), "address", offline="offline_geocode").select("id", "original", "standardized", "province", "city", "district", "street", "lat", "lon", "create_time")
    new = placed.where("id % 3 = 2")
    new.unionByName(new).write.parquet(f"{at}/in")
    reps = cut(placed.where("id % 3 = 0").withColumnsRenamed({"id": "rep_pos"}).withColumn("group_id", F.concat(F.lit("house_"), F.expr("rep_pos div 3"))).drop("original", "create_time"))
    records = spark.readStream.schema(new.schema).parquet(f"{at}/in")
    streams.match_stream(records, lambda: reps, EngineConfig().similarity_threshold, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return spark.read.schema("id long, group_id string, group_size int").parquet(f"{at}/out").select("id", "group_id", "group_size")
