"""Totals and links over all pairs, against all pairs one by one."""

import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from postalloom import catalog
from postalloom.config import EngineConfig
from postalloom.functions import alike, similarity
from postalloom.operators import blocking, clustering, metrics, scoring, tiles


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        after = [i]
        for j, y in enumerate(b, 1):
            after.append(min(row[j] + 1, after[-1] + 1, row[j - 1] + (x != y)))
        row = after
    return row[-1]


def one(a, b):
    """The combined similarity of two texts by its definition."""
    if not a.strip(" ") or not b.strip(" "):
        return 0.0
    jaro, prefix = similarity._jaro(a, b), 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    if jaro > 0.7:
        jaro += prefix * 0.1 * (1 - jaro)
    longer = max(len(a), len(b))
    return min(1.0, max(0.0, 0.4 * jaro + 0.3 * ((longer - distance(a, b)) / longer) + 0.3 * (len({*a} & {*b}) / len({*a} | {*b}))))


@pytest.mark.parametrize("longest", [1, 3, 18, 33, 64, 65, 90])
@pytest.mark.parametrize("begin", ["", "a", "ab中c", "Customer#", "x" * 70])
def test_texts_at_once(begin, longest):
    r = random.Random(longest)
    for letters in ("ab", "ab c中\0", "".join(map(chr, range(0x4E00, 0x4E80))) + "😀a "):
        left, right = ([begin + "".join(r.choices(letters, k=r.randint(0, longest))) for _ in range(8)] for _ in range(2))
        right += left[:2] + [""] * (begin == "")
        want = np.array([[one(a, b) for b in right] for a in left])
        table = alike.Table(left, right)
        assert (table.rows(np.arange(8)) == want).all()
        assert (table.rows(np.array([6, 2]), np.array([1, 8])) == want[[6, 2]][:, [1, 8]]).all()
        beside = pd.Series([a for a in left for _ in right]), pd.Series(right * 8)
        assert (alike.pairs(*beside) == want.ravel()).all()


def odd_rows(spark):
    r = random.Random(3)
    rows = []
    for i in range(160):
        name = r.choice([None, "", "  ", "文三路1号", "文三路12号", "文二路12号楼", "x", "Main Street 5", "Main Street 55", "y" * 80])
        place = r.choice([(None, None), (float("nan"), 120.0), (30.0, 120.0), (30.0, 120.0), (30.02, 120.01), (30.04, 120.09), (31.0, 121.0), (-0.01, 0.01), (0.01, -0.01)])
        rows.append((i * 7 - 300, name, r.choice([None, "", "p", "q"]), r.choice(["", "c"]), r.choice([None, "d"]), r.choice([None, "", " ", "s", "t"]), *place))
    return spark.createDataFrame(rows, "id long, standardized string, province string, city string, district string, street string, lat double, lon double")


SETTINGS = [EngineConfig(), EngineConfig(skip_unparsed_block=True), EngineConfig(text_weight=0.2, spatial_weight=0.5, admin_weight=0.3)]


def by_pairs(rows, settings, at_least=None):
    return scoring.scored_rows(blocking.admin_or_spatial_pairs(rows, settings, scoring.PARTS), settings, at_least)


@pytest.mark.parametrize("settings", SETTINGS)
@pytest.mark.parametrize("part", [5, 4096])
def test_histograms(spark, monkeypatch, settings, part):
    monkeypatch.setattr(blocking, "BLOCK_ROWS", part)
    rows = odd_rows(spark).cache()
    rounded = by_pairs(rows, settings).selectExpr(*[f"round({m}_similarity, 9) AS {m}_similarity" for m in tiles.MEASURES])
    want = {tuple(x) for x in metrics.similarity_histograms(rounded).collect()}
    assert {tuple(x) for x in tiles.histograms(rows, settings).collect()} == want


def test_histograms_of_repeated_ids(spark):
    rows = odd_rows(spark).limit(30)
    twice = rows.unionByName(rows.limit(5))
    rounded = by_pairs(twice, EngineConfig()).selectExpr(*[f"round({m}_similarity, 9) AS {m}_similarity" for m in tiles.MEASURES])
    assert {tuple(x) for x in tiles.histograms(twice).collect()} == {tuple(x) for x in metrics.similarity_histograms(rounded).collect()}


def copies(folder, n):
    """Thirty customers of one block at few places, ``n`` times each with its name and place."""
    rows = {
        "customer": f"SELECT i + 6000 * k AS c_custkey, 'Customer#' || lpad((i * i * 37)::VARCHAR, 9, '0') AS c_name, 3 AS c_nationkey, 's' AS c_mktsegment, 0.0::DOUBLE AS c_acctbal FROM range(0, 30) t(i), range(0, {n}) u(k)",
        "nation": "SELECT 3 AS n_nationkey, 'n' AS n_name, 0 AS n_regionkey",
        "region": "SELECT 0 AS r_regionkey, 'r' AS r_name",
    }
    folder.mkdir()
    for name, sql in rows.items():
        duckdb.sql(f"COPY ({sql}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


def test_histograms_of_many_copies(spark, tmp_path):
    """450 million pairs, too many to score one by one."""
    found = catalog.QUERIES["hist_similarity"](spark, copies(tmp_path / "many", 1000)).toPandas()
    assert (found.groupby("measure")["n"].sum() == 30_000 * 29_999 // 2).all() and len(found["measure"].unique()) == 4
    few = catalog.QUERIES["hist_similarity"](spark, copies(tmp_path / "few", 1)).toPandas()
    both = found.merge(few, on=["measure", "bin"], how="left", suffixes=("", "_few")).fillna(0)
    own = np.where(both["bin"] == both["measure"].map({"text": 49, "spatial": 49, "administrative": 44, "comprehensive": 49}), 30 * 1000 * 999 // 2, 0)
    assert both[both["measure"] != "administrative"].eval("n - 1_000_000 * n_few").tolist() == own[both["measure"] != "administrative"].tolist()


# --- links ---


def groups(labels):
    return sorted((x["id"], x["label"]) for x in labels.collect())


@pytest.mark.parametrize("settings", SETTINGS)
@pytest.mark.parametrize("threshold", [0.3, 0.55, 0.8, 0.97])
def test_connected(spark, monkeypatch, settings, threshold):
    monkeypatch.setattr(blocking, "BLOCK_ROWS", 7)
    rows = odd_rows(spark).cache()
    want = clustering.connected(rows, scoring.edges(by_pairs(rows, settings, threshold)), threshold)
    assert groups(tiles.connected(rows, threshold, settings)) == groups(want)


def test_connected_with_repeated_ids(spark):
    rows = odd_rows(spark).limit(30)
    twice = rows.unionByName(rows.limit(5))
    want = clustering.connected(twice, scoring.edges(by_pairs(twice, EngineConfig(), 0.55)), 0.55)
    assert groups(tiles.connected(twice, 0.55)) == groups(want)


def test_resolves_many_copies(spark, tmp_path):
    few = catalog.QUERIES["resolve_customers"](spark, copies(tmp_path / "few", 1)).toPandas()
    many = catalog.QUERIES["resolve_customers"](spark, copies(tmp_path / "many", 1000)).toPandas()
    assert sorted(many["size"]) == sorted(few["size"] * 1000) and sorted(many["first_id"]) == sorted(few["first_id"])


# --- scores ---


COLUMNS = ["id1", "id2", *tiles.SCORES, "distance_km", "is_similar"]


def same_pairs(found, want):
    found, want = (x.select(COLUMNS).toPandas().sort_values(["id1", "id2"]).reset_index(drop=True) for x in (found, want))
    pd.testing.assert_frame_equal(found, want, check_exact=False, rtol=0, atol=1e-9)


@pytest.mark.parametrize("settings", SETTINGS)
@pytest.mark.parametrize("at_least", [None, 0.55])
@pytest.mark.parametrize("part", [7, 4096])
def test_scored(spark, monkeypatch, settings, at_least, part):
    monkeypatch.setattr(blocking, "BLOCK_ROWS", part)
    monkeypatch.setattr(alike, "LANES", 100)
    rows = odd_rows(spark).cache()
    same_pairs(tiles.scored(rows, at_least, settings), by_pairs(rows, settings, at_least))


def test_scored_with_other_ids(spark):
    rows = odd_rows(spark).limit(60)
    twice = rows.unionByName(rows.limit(5))
    same_pairs(tiles.scored(twice).orderBy(COLUMNS), by_pairs(twice, EngineConfig()).orderBy(COLUMNS))
    edges = [sorted((x["id1"], x["id2"], round(x["sim"], 9)) for x in y.collect()) for y in (tiles.edges(twice, 0.55), scoring.edges(by_pairs(twice, EngineConfig(), 0.55), 0.55))]
    assert edges[0] == edges[1] and edges[0]
    texts = rows.withColumn("id", F.when(F.col("id") > -290, F.concat(F.lit("é"), F.col("id").cast("string"))))
    same_pairs(tiles.scored(texts), by_pairs(texts, EngineConfig()))
    assert tiles.scored(rows.limit(0)).collect() == []


def test_rounds_as_spark(spark):
    r = random.Random(5)
    values = [0.0, 1.0, 0.5, 0.1234565, 0.1234575, 0.2850005, 1.0000005, 2.675, 20015.0868515] + [r.random() for _ in range(2000)] + [(2 * r.randrange(10**9) + 1) / 2e6 for _ in range(2000)]
    want = [x["v"] for x in spark.createDataFrame([(x,) for x in values], "v double").select(F.round("v", 6).alias("v")).collect()]
    assert tiles._rounded(np.array(values), 6).tolist() == want


@pytest.mark.parametrize("query", ["comprehensive", "similar_edges"])
def test_blocks_are_scored_where_they_are(spark, tmp_path, capsys, query):
    """Blocks are scored a tile at a time; the plan compares no texts pair by pair."""
    catalog.QUERIES[query](spark, copies(tmp_path / "few", 3)).explain()
    plan = capsys.readouterr().out
    assert "FlatMapGroupsInArrow" in plan and "levenshtein" not in plan and "jaro" not in plan
