"""Candidate pairs by equi-joins on derived keys; always (id1, id2) with id1 < id2."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postalloom.config import EngineConfig
from postalloom.functions import geo, similarity
from postalloom.operators import scoring
from postalloom.operators.skew import join_hot
from postalloom.plans.lineage import cut


@lru_cache
def bands_and_rows(threshold: float, permutations: int, steps: int = 200) -> tuple[int, int]:
    """The split of the permutations that minimises half the area of false positives plus half that of false negatives."""

    def area(low: float, high: float, f: Callable[[float], float]) -> float:
        width = (high - low) / steps
        return sum(f(low + (i + 0.5) * width) for i in range(steps)) * width

    def cost(b: int, r: int) -> float:
        return 0.5 * area(0.0, threshold, lambda s: 1 - (1 - s**r) ** b) + 0.5 * area(threshold, 1.0, lambda s: (1 - s**r) ** b)

    options = [(b, r) for b in range(1, permutations + 1) for r in range(1, permutations // b + 1)]
    return min(options, key=lambda x: (cost(*x), x))


#: Rows of a block that one task compares with the whole block; larger blocks are split into so many.
BLOCK_ROWS = 4096


def _pairs(left: DataFrame, keys: list[str], salts: int = 1, more: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Self-join on ``keys``. Rows alone in their block leave first; a block of more than BLOCK_ROWS, or every block with ``salts``,
    is split over several tasks, the other side repeated in each. Columns ``carry`` of both rows come along, as c1 and c2."""
    sizes = left.groupBy(*keys).agg(F.count("*").alias("_n"))
    sized = join_hot(left, sizes, keys, "_n", ["id"]).where("_n > 1").withColumn("_parts", F.greatest(F.lit(salts).cast("long"), F.ceil(F.col("_n") / BLOCK_ROWS)))
    right = sized.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[F.col(c).alias(f"r_{c}") for c in left.columns if c not in keys], F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_r_salt"))
    placed = sized.withColumn("_salt", F.pmod(F.xxhash64("id"), F.col("_parts")))
    on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_r_{k}") for k in keys]) & (F.col("_salt") == F.col("_r_salt")) & (F.col("id") < F.col("r_id"))
    joined = placed.join(right, on if more is None else on & more)
    return joined.select(F.col("id").alias("id1"), F.col("r_id").alias("id2"), *[x for c in carry for x in (F.col(c).alias(f"{c}1"), F.col(f"r_{c}").alias(f"{c}2"))])


def _unpacked(pairs: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """Pairs with the structs own1 and own2 as columns c1 and c2."""
    return pairs.select("id1", "id2", *[F.col(f"own{t}.{c}").alias(f"{c}{t}") for t in (1, 2) for c in carry])


def _own(carry: tuple[str, ...]) -> list[Column]:
    return [F.struct(*carry).alias("own")] if carry else []


def admin_pairs(addresses: DataFrame, config: EngineConfig | None = None, salts: int = 1, carry: tuple[str, ...] = ()) -> DataFrame:
    """All pairs that agree on province, city and district. Missing parts are empty strings, so unparsed rows form one
    block, unless ``skip_unparsed_block`` is set. Columns ``carry`` of both rows come along, as c1 and c2, so that pairs need not be joined with their rows."""
    keys = ["province", "city", "district"]
    blocks = addresses.select("id", *[F.coalesce(F.col(k), F.lit("")).alias(k) for k in keys], *_own(carry))
    if (config or EngineConfig()).skip_unparsed_block:
        blocks = blocks.where(~((F.col("province") == "") & (F.col("city") == "") & (F.col("district") == "")))
    return _unpacked(_pairs(blocks, keys, salts, carry=("own",)), carry) if carry else _pairs(blocks, keys, salts)


def spatial_pairs(addresses: DataFrame, config: EngineConfig | None = None, salts: int = 1, carry: tuple[str, ...] = ()) -> DataFrame:
    """Pairs in the same or a neighbouring grid cell and within the search radius; rows without both coordinates have none. ``carry`` as in ``admin_pairs``."""
    settings = config or EngineConfig()
    placed = addresses.select("id", geo.known(F.col("lat")).alias("lat"), geo.known(F.col("lon")).alias("lon"), *_own(carry)).where("lat is not null and lon is not null")
    cells = placed.withColumns({"gx": geo.cell(F.col("lon"), settings.grid_degrees), "gy": geo.cell(F.col("lat"), settings.grid_degrees)})
    steps = F.array(*[F.struct(F.lit(dx).cast("long").alias("dx"), F.lit(dy).cast("long").alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    around = cells.withColumn("step", F.explode(steps))
    own = ["own"] if carry else []
    left = around.select("id", "lat", "lon", *own, (F.col("gx") + F.col("step.dx")).alias("gx"), (F.col("gy") + F.col("step.dy")).alias("gy"))
    right = cells.select(F.col("id").alias("r_id"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"), F.col("gx").alias("r_gx"), F.col("gy").alias("r_gy"), *[F.col(c).alias(f"r_{c}") for c in own])
    near = geo.approx_km(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon")) <= settings.grid_slack * settings.max_search_radius_km
    on = (F.col("gx") == F.col("r_gx")) & (F.col("gy") == F.col("r_gy")) & (F.col("id") < F.col("r_id")) & near
    if salts > 1:
        left = left.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        right = right.withColumn("_r_salt", F.pmod(F.xxhash64("r_id"), F.lit(salts)))
        on = on & (F.col("_salt") == F.col("_r_salt"))
    joined = left.join(right, on).select(F.col("id").alias("id1"), F.col("r_id").alias("id2"), *[x for c in own for x in (F.col(c).alias(f"{c}1"), F.col(f"r_{c}").alias(f"{c}2"))])
    return _unpacked(joined, carry) if carry else joined


def ngram_pairs(texts: DataFrame, threshold: float, n: int = 3) -> DataFrame:
    """(id1, id2, jaccard): all pairs whose sets of character n-grams have at least that Jaccard, by an inverted index of rare grams.

    Sets of sizes n <= m with Jaccard t share at least t * m grams, so each has one of them among its n - ceil(t * n) + 1 rarest: only
    those are posted, and only sizes within a factor t meet. The rounding of t * n is allowed for; candidates are compared whole.
    """
    grams = texts.select("id", similarity.ngrams(F.coalesce(F.col("text"), F.lit("")), n).alias("grams")).where("size(grams) > 0")
    posted = grams.select("id", F.explode("grams").alias("gram"))
    ranked = join_hot(posted, posted.groupBy("gram").agg(F.count("*").alias("df")), ["gram"], "df", ["id"])
    ordered = ranked.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("df", "gram"))).alias("ranked"))
    size = F.size("ranked")
    least = F.greatest(F.lit(1), F.ceil(size * F.lit(float(threshold)) - 1e-9).cast("int"))
    rare = ordered.select("id", size.alias("n"), F.explode(F.slice("ranked", F.lit(1), F.greatest(F.lit(0), size - least + 1))).alias("g")).select("id", "n", "g.gram")
    other = rare.select(F.col("id").alias("id2"), F.col("n").alias("n2"), "gram")
    fits = F.least("n", "n2") + 1e-9 >= F.greatest("n", "n2") * F.lit(float(threshold))
    pairs = rare.join(other, "gram").where((F.col("id") < F.col("id2")) & fits).select("id", "id2").distinct()
    side = lambda i, g: grams.select(F.col("id").alias(i), F.col("grams").alias(g))
    both = pairs.join(side("id", "a"), "id").join(side("id2", "b"), "id2")
    shared = F.size(F.array_intersect("a", "b"))
    scored = both.select(F.col("id").alias("id1"), "id2", (shared / (F.size("a") + F.size("b") - shared)).alias("jaccard"))
    return scored.where(F.col("jaccard") >= threshold)


def lsh_pairs(texts: DataFrame, config: EngineConfig | None = None, salts: int = 1) -> DataFrame:
    """Pairs that share a band of their MinHash signatures; no check of their Jaccard follows. Blank texts have no pairs.

    Equal texts are hashed once, and pairs are made of one id of each text, its least; the text's other ids are paired with that one. Faithful
    mode pairs all ids, and all texts shorter than an n-gram.
    """
    settings = config or EngineConfig()
    bands, rows = bands_and_rows(settings.lsh_threshold, settings.minhash_permutations)
    filled = texts.where(~similarity.blank(F.col("text"))).select("id", "text")
    firsts = filled.groupBy("text").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    signed = firsts.select(F.col("first").alias("id"), similarity.minhash(F.col("text"), settings.ngram, bands * rows).alias("signature"))
    if settings.faithful:
        signed = signed.withColumn("signature", F.coalesce("signature", F.array_repeat(F.lit((1 << 63) - 1).cast("long"), bands * rows)))
    keys = F.array(*[F.xxhash64(F.lit(b), F.slice("signature", b * rows + 1, rows)) for b in range(bands)])
    placed = signed.where("signature is not null").select("id", F.posexplode(keys).alias("band", "key"))
    between = _pairs(placed, ["band", "key"], salts).distinct()
    members = join_hot(filled, firsts, ["text"], "n", ["id"])
    if settings.faithful:
        short = F.lit(True)
    else:
        short = F.char_length("text") >= settings.ngram
    star = members.where(short & (F.col("id") != F.col("first"))).select(F.col("first").alias("id1"), F.col("id").alias("id2"))
    if not settings.faithful:
        return between.unionByName(star)
    own = members.select("first", "id")
    end = lambda c: own.select(F.col("first").alias(f"id{c}"), F.col("id").alias(f"m{c}"))
    spread = between.join(end(1), "id1").join(end(2), "id2").select(F.least("m1", "m2").alias("id1"), F.greatest("m1", "m2").alias("id2"))
    return spread.unionByName(_pairs(own.select("id", "first"), ["first"], salts)).distinct()


def union_pairs(*candidates: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [c.select("id1", "id2") for c in candidates]).distinct()


def admin_or_spatial_pairs(addresses: DataFrame, config: EngineConfig | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """The union of administrative and spatial pairs, each pair once, with ``carry`` as in ``admin_pairs``.

    Where no id repeats, which is counted first, a spatial pair is an administrative one if its rows agree on the parts; so those leave
    without a shuffle of pairs. Elsewhere the pairs are made distinct, and a repeated id's rows are all joined to them.
    """
    settings = config or EngineConfig()
    parts = ("province", "city", "district")
    once = addresses.where("id is not null").groupBy("id").count().where("count > 1").isEmpty()
    if not once:
        pairs = union_pairs(admin_pairs(addresses, settings), spatial_pairs(addresses, settings))
        side = lambda t: addresses.select(F.col("id").alias(f"id{t}"), *[F.col(c).alias(f"{c}{t}") for c in carry])
        return pairs.join(side(1), "id1").join(side(2), "id2") if carry else pairs
    kept = ("id1", "id2", *[f"{c}{t}" for t in (1, 2) for c in carry])
    part = lambda c, t: F.coalesce(F.col(f"{c}{t}"), F.lit(""))
    blocked = reduce(lambda a, b: a & b, [part(c, 1) == part(c, 2) for c in parts])
    if settings.skip_unparsed_block:
        blocked = blocked & reduce(lambda a, b: a | b, [part(c, 1) != "" for c in parts])
    near = spatial_pairs(addresses, settings, carry=tuple(dict.fromkeys((*carry, *parts)))).where(~blocked)
    return admin_pairs(addresses, settings, carry=carry).select(*kept).unionByName(near.select(*kept))


def near_pairs(left: DataFrame, right: DataFrame, km: float) -> DataFrame:
    """(id, r_id): pairs of rows (id, lat, lon) of two tables at most ``km`` apart, which is half a degree at most; rows without both coordinates have none.

    Rows of the same place meet others as one point. Rings of cells wide enough for the distance up to 60 degrees north and south; beyond them, and at the date line, bands of latitude.
    """
    if km > 0.5 * geo.KM_PER_DEGREE:
        raise ValueError("cells are made for distances up to half a degree")
    size = max(km / geo.KM_PER_DEGREE * 2.01, 1e-3)
    place = lambda df, tag: df.select(F.col("id").alias(f"{tag}id"), geo.known(F.col("lat")).alias(f"{tag}lat"), geo.known(F.col("lon")).alias(f"{tag}lon")).where(f"{tag}lat is not null and {tag}lon is not null")
    rows, r_rows = place(left, ""), place(right, "r_")
    mine, theirs = rows.select("lat", "lon").distinct(), r_rows.select("r_lat", "r_lon").distinct()
    polar = (F.abs(F.col("lat")) > 59) | (F.abs(F.col("lon")) > 179)
    cell = lambda c: F.floor(F.col(c) / size)
    around = lambda c: F.explode(F.array(*[cell(c) + d for d in (-1, 0, 1)]))
    rings = mine.where(~polar).withColumn("_x", around("lon")).withColumn("_y", around("lat"))
    near = rings.join(theirs.withColumns({"_rx": cell("r_lon"), "_ry": cell("r_lat")}), (F.col("_x") == F.col("_rx")) & (F.col("_y") == F.col("_ry")))
    bands = mine.where(polar).withColumn("_y", around("lat"))
    far = bands.join(theirs.withColumn("_ry", cell("r_lat")), F.col("_y") == F.col("_ry"))
    within = geo.haversine_km(*[F.col(c) for c in ("lat", "lon", "r_lat", "r_lon")]) <= km * (1 + 1e-9)
    points = [F.col(c) for c in ("lat", "lon", "r_lat", "r_lon")]
    met = near.where(within).select(*points).unionByName(far.where(within).select(*points))
    return met.join(rows, ["lat", "lon"]).join(r_rows, ["r_lat", "r_lon"]).select("id", "r_id")


def alike_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(id, r_id): pairs of rows (id, text) of two tables whose sets of characters have a Jaccard of at least ``least``, and some others.

    As in ``ngram_pairs``, each shares one of the rarest characters of either text; equal texts meet as one.
    """
    distinct = left.select("text").unionByName(right.select("text")).where("text <> ''").distinct()
    sets = cut(distinct.select("text", similarity.characters(F.col("text")).alias("own")).where("size(own) > 0"))
    posted = sets.select("text", F.explode("own").alias("token"))
    ranked = join_hot(posted, posted.groupBy("token").agg(F.count("*").alias("df")), ["token"], "df", ["text"])
    ordered = ranked.groupBy("text").agg(F.array_sort(F.collect_set(F.struct("df", "token"))).alias("ranked"))
    size = F.size("ranked")
    needed = F.greatest(F.lit(1), F.ceil(size * F.lit(float(least)) - 1e-9).cast("int"))
    rare = cut(ordered.select("text", size.alias("n"), F.explode(F.slice("ranked", F.lit(1), size - needed + 1)).alias("g")).select("text", "n", "g.token"))
    mine = rare.join(left.select("text").distinct(), "text", "left_semi")
    theirs = rare.join(right.select("text").distinct(), "text", "left_semi").select(F.col("text").alias("r_text"), F.col("n").alias("r_n"), F.col("token").alias("r_token"))
    fits = F.least("n", "r_n") + 1e-9 >= F.greatest("n", "r_n") * F.lit(float(least))
    texts = mine.join(theirs, (F.col("token") == F.col("r_token")) & fits).select("text", "r_text").distinct()
    named = texts.join(left.select("id", "text"), "text")
    return named.join(right.select(F.col("id").alias("r_id"), F.col("text").alias("r_text")), "r_text").select("id", "r_id")


def candidates(addresses: DataFrame, config: EngineConfig | None = None, at_least: float | None = None) -> DataFrame:
    """Union of LSH, administrative and spatial pairs of (id, standardized, province, city, district, lat, lon).

    With ``at_least`` only pairs that can reach that similarity are wanted. Where they have to be near each other, by the weights, all of them are
    pairs of neighbouring cells, and the other two need not be made; faithful mode makes them.
    """
    settings = config or EngineConfig()
    widest = scoring.widest_km(settings, at_least) if at_least is not None and not settings.faithful else None
    if widest is not None and widest <= 0.5 * geo.KM_PER_DEGREE:
        return near_pairs(addresses, addresses, widest).where("id < r_id").select(F.col("id").alias("id1"), F.col("r_id").alias("id2")).distinct()
    texts = addresses.select("id", F.col("standardized").alias("text"))
    return union_pairs(lsh_pairs(texts, settings), admin_pairs(addresses, settings), spatial_pairs(addresses, settings))
