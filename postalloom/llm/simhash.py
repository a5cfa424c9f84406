"""Near-duplicates by SimHash and covering locality-sensitive hashing (Pagh, 2016).

Each bit position of a fingerprint gets a non-zero vector of radius + 1 bits, and each non-zero vector v of as many bits
gives a mask: the positions whose vector has an odd inner product with v. The vectors of up to ``radius``
differing positions span less than the whole space, so some v is orthogonal to all of them: under its
mask the two fingerprints agree, for certain. There are 2**(radius+1) - 1 such tables, and fingerprints that share a bucket
of one are compared there.

``group`` links fingerprints of whole texts, exactly: buckets of up to WHOLE fingerprints are compared all with all. In a larger one each
fingerprint names the values of that bucket within half the radius of it, and those that name the same value are linked; a
value is named by a bounded number of fingerprints, so no group grows with the input.

``keep_one`` links texts by the Jaccard similarity of their five-word shingles, which one SimHash can't reach: at 0.8 ten of 64
bits differ. So not only the whole text has a fingerprint, with a radius of WHOLE_RADIUS, but each of its sections. Sections
end where a shingle's hash says so, so an edit changes the section it is in and leaves the others as they were; with one
word in 45 changed, which is a similarity of 0.8, half of the sections are the same. Texts that share a bucket of any
table are candidates; in large buckets first with two representatives, then all that are not in one group by then. Wide fingerprints of WIDE * 64 bits, of which a pair at 0.8 differs in 39 +- 6, drop most others;
what is left is compared exactly, shingle by shingle.

Nulls and texts without words have fingerprint 0 and are linked like any other; a null doc_id keeps its row and comes last. Very long texts
are read whole. Ties go to the least doc_id, then to the least hash of the text; of repeated rows ``group`` keeps all and
``keep_one`` one. Other columns are carried as one struct, so their names cannot clash. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postalloom.llm.common import cut, give_back, join_hot, row, table, to_python
from postalloom.operators.components import components

NAME = "op3_simhash_components"
ORACLE = None

BITS = 64
RADIUS = 2
SHINGLE = 3
SEED = 42
#: Hashes whose bits are counted at once.
CHUNK = 1 << 16
#: Members of a bucket that are compared all with all.
WHOLE = 64

#: ``keep_one``: texts are near-duplicates if SHARE[1] * |common shingles| >= SHARE[0] * |all shingles|.
TEXT_SHINGLE = 5
SHARE = (4, 5)
WHOLE_RADIUS, SECTION_RADIUS = 3, 1
#: A section has about 2**level shingles; texts of up to the given number of shingles are cut at that level.
LEVELS = {3: 128, 4: 512, 5: None}
LEAST_SECTION = 4
#: 64-bit members of a wide fingerprint, and how many of its bits may differ: 4.5 standard deviations above the mean of a pair at 0.8.
WIDE = 4
MOST_DIFFERENT = 64
#: Texts of a bucket that are candidates all with all at once; in a larger one, those that are not linked after a first round.
CROWD = 16
#: Rows of a larger bucket that one task compares with the whole of it.
CROWD_ROWS = 4096
#: Partners of one text that meet it in one place.
PARTNERS = 64


def shingle_hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """The XXH64 of a text's shingles in order, repeats included, in chunks; nothing for a text without words.

    Words are runs of other characters than ASCII white space, A-Z lower-cased; fewer words than a shingle form one.
    """
    words = (text or "").encode().lower().split()  # bytes: both calls know ASCII only
    if not words:
        return
    whole = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n, digest = max(1, len(words) - shingle + 1), xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        spans = zip(starts[at : min(n, at + CHUNK)].tolist(), ends[min(shingle, len(words)) - 1 :][at : at + CHUNK].tolist(), strict=False)
        yield np.array([digest(whole[i:j], SEED) for i, j in spans], "<u8")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text: per bit the majority among its shingles' hashes; 0 without words."""
    set_bits, n = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes(text, shingle):
        n += len(hashes)
        set_bits += _bits(hashes).sum(axis=0, dtype=np.uint32)
    return int(_packed(set_bits, n)[0])


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _packed(set_bits: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    return np.packbits(2 * set_bits > n, axis=-1, bitorder="little").view("<u8").ravel()


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's five-word shingles, in order."""
    found = list(shingle_hashes(text, TEXT_SHINGLE))
    return np.unique(np.concatenate(found)) if found else np.empty(0, "<u8")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of shingles have the Jaccard; two empty ones do."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return SHARE[1] * common >= SHARE[0] * (len(a) + len(b) - common)


def wide(distinct: np.ndarray) -> np.ndarray:
    """WIDE SimHashes over a set of shingles, the first from the hashes themselves, each other one from the hashes mixed anew."""
    set_bits = np.zeros((WIDE, BITS), np.int64)
    for at in range(0, len(distinct), CHUNK):
        for k in range(WIDE):
            set_bits[k] += _bits(_mixed(distinct[at : at + CHUNK], k)).sum(axis=0, dtype=np.uint32)
    return _packed(set_bits, len(distinct))


def sections(hashes: np.ndarray) -> np.ndarray:
    """The SimHashes of a text's sections, each level's that its length asks for. Texts within the Jaccard of each other share a level."""
    out, least = [], 0
    cutting = _mixed(hashes, WIDE)
    for level, most in LEVELS.items():
        if len(hashes) >= least and (most is None or SHARE[0] * len(hashes) < SHARE[1] * most):
            starts = np.flatnonzero(cutting & np.uint64((1 << level) - 1) == 0)
            out.append(_section_prints(hashes, np.unique(np.append(0, starts))))
        least = most
    return np.unique(np.concatenate(out)) if out else np.empty(0, "<u8")


def _section_prints(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    sizes = np.diff(np.append(starts, len(hashes)))
    set_bits = np.zeros((len(starts), BITS), np.int64)
    for at in range(0, len(hashes), CHUNK):
        bits = _bits(hashes[at : at + CHUNK])
        first = int(np.searchsorted(starts, at, "right")) - 1
        last = int(np.searchsorted(starts, at + len(bits), "left"))
        set_bits[first:last] += np.add.reduceat(bits, np.maximum(starts[first:last] - at, 0), axis=0, dtype=np.int64)
    return _packed(set_bits, sizes[:, None])[(sizes >= LEAST_SECTION) | (len(starts) == 1)]


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The finaliser of SplitMix64 over hashes moved by k steps; for k = 0 the hashes as they are."""
    if k == 0:
        return hashes
    z = hashes + np.uint64((k * 0x9E3779B97F4A7C15) % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text, as a signed long. Null texts have fingerprint 0."""
    wanted = docs.select("doc_id", F.col("text").alias("_text"))
    schema = T.StructType([wanted.schema["doc_id"], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), shingle) for x in batch.column("_text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], schema.names)

    return to_python(wanted).mapInArrow(run, schema)


def text_hash() -> Column:
    """128 bits, so that no two texts of any corpus are taken for one."""
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))).alias("copy")


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The covering masks: position i carries the vector 1 + i mod (2**(radius+1) - 1)."""
    vectors = [1 + i % ((1 << (radius + 1)) - 1) for i in range(bits)]
    return [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() & 1) for v in range(1, 1 << (radius + 1))]


def _bucketed(placed: DataFrame, key: list[str], spread: str) -> DataFrame:
    """The rows of ``placed`` that have company in their bucket, with its size n."""
    buckets = placed.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    return cut(join_hot(placed, buckets, key, "n", [spread]).where("n is not null"))


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) between distinct fingerprints, each within ``radius`` (2 or less), whose components are those of all such pairs.

    The pairs come from the buckets of the covering tables. In a large bucket, fingerprints that name the same value of it, at
    most one bit from each, are within 2 bits of each other and linked to the least of them; for radius 1 the value has
    to be one of them.
    """
    if not 1 <= radius <= 2:
        raise ValueError("a radius of 1 or 2 is supported")
    every = [signed(m) for m in masks(radius)]
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in every])
    key = ["mask", "key"]
    mates = _bucketed(distinct.select("fp", F.posexplode(keys).alias(*key)), key, "fp")
    small = mates.where(F.col("n") <= WHOLE).groupBy(*key).agg(F.array_sort(F.collect_list("fp")).alias("all"))
    each = small.select("all", F.posexplode("all").alias("i", "v"))
    pairs = each.select("v", F.explode(F.slice("all", F.col("i") + 2, F.lit(WHOLE))).alias("u")).where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)
    flips = F.array("fp", *[F.col("fp").bitwiseXOR(F.lit(signed(1 << i)).cast("long")) for i in range(BITS)])
    mask = F.element_at(F.array(*[F.lit(m).cast("long") for m in every]), F.col("mask") + 1)
    named = mates.where(F.col("n") > WHOLE).select(*key, "fp", F.explode(flips).alias("value")).where(F.col("value").bitwiseAND(mask) == F.col("key"))
    stars = named.groupBy("mask", "value").agg(F.collect_set("fp").alias("fps")).where("size(fps) > 1")
    centre = F.array_min("fps") if radius == 2 else F.when(F.array_contains("fps", F.col("value")), F.col("value"))
    led = stars.select(centre.alias("v"), F.explode("fps").alias("u")).where("u <> v")
    return pairs.select("u", "v").unionByName(led.select("u", "v")).distinct()


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, copy, size, fps, parts): a hash of each whole text, its number of distinct shingles, its wide fingerprint and its sections'."""
    wanted = docs.select("doc_id", text_hash(), F.col("text").alias("_text"))
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([wanted.schema["doc_id"], wanted.schema["copy"], T.StructField("size", T.LongType()), T.StructField("fps", longs), T.StructField("parts", longs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, fps, parts = [], [], []
            for text in batch.column("_text"):
                chunks = list(shingle_hashes(text.as_py(), TEXT_SHINGLE))
                hashes = np.concatenate(chunks) if chunks else np.empty(0, "<u8")
                distinct = np.unique(hashes)
                sizes.append(len(distinct))
                fps.append(wide(distinct).view(np.int64))
                parts.append(sections(hashes).view(np.int64))
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (fps, parts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("copy"), pa.array(sizes, pa.int64()), *lists], schema.names)
            give_back()

    return to_python(wanted).mapInArrow(run, schema)


def _table_keys(first: int, radius: int):
    """The function from a fingerprint to its keys in the covering tables of a radius, numbered from ``first``."""
    every = [signed(m) for m in masks(radius)]
    return lambda fp: F.array(*[F.xxhash64(F.lit(first + i), fp.bitwiseAND(F.lit(m).cast("long"))) for i, m in enumerate(every)])


def bucketed(texts: DataFrame) -> DataFrame:
    """(copy, key, n): the texts (copy, size, fps, parts) in the buckets of all tables that hold n > 1 of them."""
    of_text, of_part = _table_keys(0, WHOLE_RADIUS), _table_keys(1 << (WHOLE_RADIUS + 1), SECTION_RADIUS)
    keys = F.array_distinct(F.concat(of_text(F.get("fps", 0)), F.flatten(F.transform("parts", of_part))))
    return _bucketed(texts.select("copy", F.explode(keys).alias("key")), ["key"], "copy")


def _near() -> Column:
    """Whether the sizes of u_ and v_ allow the Jaccard and their wide fingerprints are near."""
    fits = SHARE[1] * F.least("u_.size", "v_.size") >= SHARE[0] * F.greatest("u_.size", "v_.size")
    apart = sum((F.bit_count(F.get("u_.fps", i).bitwiseXOR(F.get("v_.fps", i))) for i in range(WIDE)), F.lit(0))
    return fits & (apart <= MOST_DIFFERENT)


def candidates(texts: DataFrame, mates: DataFrame) -> DataFrame:
    """(u, v): pairs of texts that share a bucket of ``mates``, whose sizes allow the Jaccard and whose wide fingerprints are near.

    In a bucket of up to CROWD texts all pairs are candidates. In a larger one each text is compared with two
    representatives: the one that has most company over all buckets, which is the middle of a group, and the one with the least hash;
    ``crowded`` names the pairs there that this leaves. Only ``v`` can have many partners.
    """
    small = mates.where(F.col("n") <= CROWD).groupBy("key").agg(F.array_sort(F.collect_list("copy")).alias("all"))
    each = small.select("all", F.posexplode("all").alias("i", "v"))
    pairs = each.select(F.explode(F.slice("all", F.col("i") + 2, F.lit(CROWD))).alias("u"), "v")
    company = mates.groupBy("copy").agg(F.sum("n").alias("company"))
    large = mates.where(F.col("n") > CROWD).join(company, "copy")
    heads = large.groupBy("key").agg(F.array_distinct(F.array(F.max_by("copy", F.struct("company", "copy")), F.min("copy"))).alias("heads"), F.count("*").alias("weight"))
    led = join_hot(large, heads, ["key"], "weight", ["copy"]).select(F.col("copy").alias("u"), F.explode("heads").alias("v"))
    pairs = cut(pairs.unionByName(led).where("u <> v").distinct())

    print_ = lambda c: texts.select(F.col("copy").alias(c), F.struct("size", "fps").alias(f"{c}_")).alias(c)
    partners = pairs.groupBy("v").agg(F.count("*").alias("n")).join(print_("v"), "v")
    both = join_hot(pairs.join(print_("u"), "u"), partners, ["v"], "n", ["u"])
    return both.where(_near()).select("u", "v")


def crowded(texts: DataFrame, mates: DataFrame, labels: DataFrame) -> DataFrame:
    """(u, v): the pairs in buckets of more than CROWD that ``labels`` (node, label) does not link, near as in ``candidates``.

    With the candidates these are all pairs of any bucket but those already in one group, so no link is lost. Buckets whose texts are all in one
    group, most of the large ones, leave first, and of buckets with the same texts one stays. What is left is compared all with all, CROWD_ROWS of a bucket in one task.
    """
    named = mates.where(F.col("n") > CROWD).select("copy", "key").join(labels.withColumnRenamed("node", "copy"), "copy", "left")
    named = cut(named.withColumn("label", F.coalesce("label", "copy")))
    members = [F.bit_xor(F.xxhash64(F.lit(i), "copy")).alias(f"members{i}") for i in (0, 1)]
    mixed = named.groupBy("key").agg(F.count("*").alias("n"), (F.min("label") != F.max("label")).alias("mixed"), *members).where("mixed")
    once = mixed.groupBy("n", "members0", "members1").agg(F.min("key").alias("key")).select("key", "n")
    asked = join_hot(named, once, ["key"], "n", ["copy"]).where("n is not null").withColumn("_parts", F.ceil(F.col("n") / CROWD_ROWS))
    rows = cut(asked.join(texts.select("copy", F.struct("size", "fps").alias("own")), "copy"))
    left = rows.select("key", F.col("copy").alias("u"), F.col("label").alias("u_label"), F.col("own").alias("u_"), F.pmod(F.xxhash64("copy"), "_parts").alias("part"))
    right = rows.select("key", F.col("copy").alias("v"), F.col("label").alias("v_label"), F.col("own").alias("v_"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("part"))
    return left.join(right, ["key", "part"]).where("u < v and u_label <> v_label").where(_near()).select("u", "v").distinct()


def verified(pairs: DataFrame, texts: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (u, v) whose whole texts have the Jaccard. The partners of a text meet it in chunks, so no text is hot."""
    partners = pairs.groupBy("v").agg(F.count("*").alias("n")).withColumn("chunks", F.ceil(F.col("n") / PARTNERS))
    ends = pairs.select(F.col("u").alias("copy")).unionByName(pairs.select(F.col("v").alias("copy"))).distinct()
    wanted = texts.join(ends, "copy").select(F.col("best.id").alias("_id"), F.col("best.hash").alias("_hash"))
    rows = docs.select(F.col("doc_id").alias("_doc"), text_hash(), F.col("text").alias("_text"))
    held = rows.join(wanted, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("copy") == F.col("_hash")), "left_semi")
    bodies = cut(held.groupBy("copy").agg(F.first("_text").alias("body")))
    salted = join_hot(pairs, partners, ["v"], "n", ["u"]).select("u", "v", F.pmod(F.xxhash64("u"), "chunks").alias("chunk"))
    left = salted.join(bodies.select(F.col("copy").alias("u"), F.col("body").alias("a")), "u")
    right = partners.join(bodies.select(F.col("copy").alias("v"), F.col("body").alias("b")), "v")
    right = right.select("v", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    both = left.join(right, ["v", "chunk"]).select("u", "v", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, other = None, None
        for batch in batches:
            keep = []
            for v, a, b in zip(batch.column("v").to_pylist(), batch.column("a"), batch.column("b"), strict=True):
                if v != last:
                    last, other = v, shingles(b.as_py())
                keep.append(similar(shingles(a.as_py()), other))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))
            give_back()

    return to_python(both).mapInArrow(run, "u binary, v binary")


def least_row() -> Column:
    """By its least value the row of a group that stays: null ids come last."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("copy").alias("hash"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of texts linked by a Jaccard of 0.8 or more, that of the least doc_id, and all columns as they were.

    Equal texts are one node; texts without words are alike.
    """
    found = cut(signatures(docs))
    texts = cut(found.groupBy("copy").agg(F.min(least_row()).alias("best"), *[F.first(c).alias(c) for c in ("size", "fps", "parts")]))
    mates = bucketed(texts)
    edges = cut(verified(cut(candidates(texts, mates)), texts, docs))
    labels = cut(components(edges))
    rest = cut(crowded(texts, mates, labels))
    if not rest.isEmpty():
        labels = components(edges.unionByName(verified(rest, texts, docs)))
    ids = found.groupBy("copy", "doc_id").agg(F.count("*").alias("times"))
    return survivors(docs, ids, texts.select("copy", "best"), labels)


#: Cells of the filter that tells which rows may have to go: as in operator 5, a bounded broadcast.
MOST_CELLS = 1 << 27


def survivors(docs: DataFrame, ids: DataFrame, texts: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with one row of each label (node, label) over ``texts`` (copy, best); texts without a label stay.

    Who stays is decided on ids and hashes. A filter on the ids of rows that go, or that are repeated, tells which texts
    have to be shuffled for it; all others pass straight through.
    """
    named = texts.join(labels.withColumnRenamed("node", "copy"), "copy", "left").withColumn("label", F.coalesce("label", "copy"))
    stay = named.groupBy("label").agg(F.min("best").alias("stay")).select(F.col("stay.id").alias("_id"), F.col("stay.hash").alias("_hash"), F.lit(True).alias("stays"))
    judged = ids.join(stay, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("copy") == F.col("_hash")), "left")
    doubtful = cut(judged.where("stays is null or times > 1").select(F.col("doc_id").alias("_of"), F.col("copy").alias("_hash"), F.col("stays").isNotNull().alias("stays")))
    cells = 1 << max(10, min(MOST_CELLS.bit_length() - 1, (16 * doubtful.count()).bit_length()))
    cell = lambda c: F.pmod(F.xxhash64(c), F.lit(cells).cast("long"))
    words = doubtful.select(cell("_of").alias("cell")).groupBy(F.expr("cell div 64").alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(cell % 64 as int))")).alias("_bits"))
    rows = docs.select(row(docs), F.col("doc_id").alias("_doc"), F.col("text")).withColumn("_cell", cell("_doc"))
    rows = rows.join(F.broadcast(cut(words)), F.expr("_cell div 64 = _word"), "left")
    hit = F.expr("coalesce(shiftright(_bits, cast(_cell % 64 as int)) & 1L, 0L) = 1L")
    asked = rows.where(hit).select("row", "_doc", text_hash().alias("_copy"))
    met = asked.join(doubtful, F.col("_doc").eqNullSafe(F.col("_of")) & (F.col("_copy") == F.col("_hash")), "left")
    once = met.where("stays").groupBy("_doc", "_copy").agg(F.first("row").alias("row"))  # repeats meet as one row per task
    passed = rows.where(~hit).select("row").unionByName(met.where("stays is null").select("row"))
    return passed.unionByName(once.select("row")).select("row.*")


def group(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id, n): every document with its component's least doc_id and size.

    Equal fingerprints are linked, those of texts without words too. Repeated rows stay; a null doc_id keeps its
    row and is no component's name unless all its ids are null.
    """
    found = cut(fingerprints(docs, shingle))
    distinct = cut(found.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")))
    labels = cut(components(links(distinct.select("fp"), radius)))
    named = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    whole = named.groupBy("label").agg(F.min("least").alias("component_id"), F.sum("rows").alias("size"), F.count("*").alias("n"))
    by_fp = join_hot(named, whole, ["label"], "n", ["fp"]).select("fp", "component_id", "size", "rows")
    joined = join_hot(found, by_fp, ["fp"], "rows", ["doc_id"])
    return joined.select("doc_id", "fp", "component_id", F.col("size").alias("n"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the least doc_id it is linked to, over any number of links."""
    done = group(table(spark, sf_dir, "documents"))
    return done.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
