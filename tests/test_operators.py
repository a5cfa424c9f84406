import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from postalloom.config import EngineConfig
from postalloom.functions import geo, similarity
from postalloom.operators import blocking, clustering, execution, geocoding, incremental, metrics, ordering, scoring, skew
from postalloom.operators import components as cc


def roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in pairs:
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def dense(labels):
    order = {}
    return [order.setdefault(x, len(order)) if x != -1 else -1 for x in labels]


def graph(spark, n, p, seed):
    r = random.Random(seed)
    edges = [(i, j, round(0.3 + 0.7 * r.random(), 3)) for i, j in itertools.combinations(range(n), 2) if r.random() < p]
    return edges, spark.range(n), spark.createDataFrame(edges, "id1 long, id2 long, sim double")


def labels_of(df):
    return [r["label"] for r in df.orderBy("id").collect()]


def table_of(spark, labels):
    return spark.createDataFrame(list(enumerate(labels)), "id long, label long")


@pytest.mark.parametrize("few", [500_000, 0])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(cc, "FEW_EDGES", few)
    monkeypatch.setattr(skew, "HOT_KEYS", 2)
    r = random.Random(1)
    pairs = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(60, 80)] + [(100, i) for i in range(101, 120)]
    want = roots(120, pairs)
    found = {x["node"]: x["label"] for x in cc.components(spark.createDataFrame([*pairs, (None, 3), (5, 5)], "u long, v long")).collect()}
    assert found == {i: want[i] for p in pairs for i in p if p[0] != p[1]}
    assert cc.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_join_hot_is_a_left_join(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_KEYS", 2)
    left = spark.createDataFrame([(i, k) for i, k in enumerate(["a"] * 20 + ["b", "c", None, "d", None])], "i long, k string")
    right = spark.createDataFrame([("a", 1, 20), ("b", 2, 1), ("c", 3, 1), (None, 4, 2)], "k string, v long, n long")
    rows = skew.join_hot(left, right, ["k"], "n", ["i"]).collect()
    assert len(rows) == 25 and {(r["k"], r["v"]) for r in rows} == {("a", 1), ("b", 2), ("c", 3), (None, 4), ("d", None)}


def test_blocking(spark):
    r = random.Random(2)
    rows = [(i, r.choice(["p", "q", None]), r.choice("xy"), "d", r.choice([None, float("nan"), 30 + r.random()]), 120 + 2 * r.random() - 121) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, province string, city string, district string, lat double, lon double")
    want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if (a[1] or "", *a[2:4]) == (b[1] or "", *b[2:4])}
    for salts in (1, 3):
        assert {tuple(x) for x in blocking.admin_pairs(df, salts=salts).collect()} == want
        near = {tuple(x) for x in blocking.spatial_pairs(df, salts=salts).collect()}
        cell = lambda x: (int(x[5] / 0.1), int(x[4] / 0.1))
        ok = [x for x in rows if x[4] is not None and x[4] == x[4]]
        assert near == {(a[0], b[0]) for a, b in itertools.combinations(ok, 2) if all(abs(p - q) <= 1 for p, q in zip(cell(a), cell(b), strict=True))}


def test_lsh_recall(spark):
    assert blocking.bands_and_rows(0.3, 256)[0] * blocking.bands_and_rows(0.3, 256)[1] <= 256
    r = random.Random(3)
    texts = []
    for _ in range(25):
        base = "".join(r.choice("abcdefghijkl") for _ in range(40))
        texts += [base, base[:36] + "zzzz"]
    df = spark.createDataFrame([*enumerate(texts), (999, ""), (998, None)], "id long, text string")
    exact = {(x["id1"], x["id2"]) for x in blocking.ngram_pairs(df, 0.5).collect()}
    found = {tuple(x) for x in blocking.lsh_pairs(df, EngineConfig(minhash_permutations=128)).collect()}
    assert exact and len(exact & found) >= 0.95 * len(exact) and all(a < b < 998 for a, b in found)


def test_bound_pushdown_changes_nothing(spark):
    r = random.Random(4)
    rows = [(i, r.choice(["abc road", "abd road", "xyz"]), r.choice(["p", "q", ""]), "c", "d", "s", 30 + r.random() / 20, 120 + r.random() / 20) for i in range(40)]
    a = spark.createDataFrame(rows, "id long, standardized string, province string, city string, district string, street string, lat double, lon double")
    pairs = spark.createDataFrame(list(itertools.combinations(range(40), 2)), "id1 long, id2 long")
    for config in (EngineConfig(), EngineConfig(text_weight=0.5, spatial_weight=0.3)):
        everything = {(x["id1"], x["id2"]) for x in scoring.scored(pairs, a, config).where("comprehensive_similarity >= 0.8").collect()}
        assert {(x["id1"], x["id2"]) for x in scoring.scored(pairs, a, config, 0.8).collect()} == everything


def test_connected_and_optimize(spark):
    for seed in range(2):
        edges, nodes, table = graph(spark, 30, 0.06, seed)
        labels = dense(roots(30, [(i, j) for i, j, s in edges if s >= 0.6]))
        assert labels_of(clustering.connected(nodes, table, 0.6)) == labels
        merged = roots(31, [(labels[i] + 1, labels[j] + 1) for i, j, s in edges if s >= 0.4])
        assert labels_of(clustering.optimize(table_of(spark, labels), table, 0.4)) == [merged[x + 1] - 1 for x in labels]
    noise = clustering.optimize(table_of(spark, [-1, 3]), spark.createDataFrame([(0, 1, 0.9)], "id1 long, id2 long, sim double"))
    assert labels_of(noise) == [-1, -1]


def test_merge_small(spark):
    for labels, want in (([0, 0, 1, 2], [0, 0, 0, 0]), ([0, 1], [0, 0]), ([-1, -1], [-1, -1])):
        assert labels_of(clustering.merge_small(table_of(spark, labels))) == want


def test_validate(spark):
    edge = spark.createDataFrame([(0, 1, 0.7)], "id1 long, id2 long, sim double")
    assert labels_of(clustering.validate(table_of(spark, [0, 0, 0]), edge)) == [0, 0, 2]
    assert labels_of(clustering.validate(table_of(spark, [0, 0]), edge.where("false"))) == [0, 0]
    assert labels_of(clustering.validate(table_of(spark, [-1, -1, -1]), edge)) == [-1, -1, -1]


def test_dbscan_equals_brute_force(spark):
    edges, nodes, table = graph(spark, 30, 0.08, 5)
    near = {i: {i} for i in range(30)}
    for i, j, s in edges:
        if 1 - s <= 0.4:
            near[i].add(j)
            near[j].add(i)
    core = {i for i in near if len(near[i]) >= 3}
    r = roots(30, [(i, j) for i in core for j in near[i] & core])
    raw = [r[i] if i in core else min((r[j] for j in near[i] & core), default=-1) for i in range(30)]
    assert labels_of(clustering.dbscan(nodes, table, 0.4, 3)) == dense(raw)
    with pytest.raises(ValueError):
        clustering.dbscan(nodes, table, 1.0)


@pytest.mark.parametrize("linkage", ["average", "complete", "single"])
def test_hierarchical(spark, linkage):
    edges, nodes, table = graph(spark, 16, 0.25, 6)
    d = np.ones((16, 16))
    for i, j, s in edges:
        d[i, j] = d[j, i] = 1 - s
    groups = [[i] for i in range(16)]
    gap = {"average": np.mean, "complete": np.max, "single": np.min}[linkage]
    while len(groups) > 1:
        (a, b), best = min((((x, y), gap(d[np.ix_(groups[x], groups[y])])) for x, y in itertools.combinations(range(len(groups)), 2)), key=lambda z: z[1])
        if best >= 0.45:
            break
        groups[a] += groups.pop(b)
    want = [0] * 16
    for g in groups:
        for i in g:
            want[i] = min(g)
    assert labels_of(clustering.hierarchical(nodes, table, distance_threshold=0.45, linkage=linkage)) == dense(want)
    with pytest.raises(ValueError):
        clustering.hierarchical(nodes, table)


def test_hierarchical_by_number(spark):
    _, nodes, table = graph(spark, 12, 0.4, 7)
    assert len(set(labels_of(clustering.hierarchical(nodes, table, n_clusters=4)))) == 4


def test_quality_equals_brute_force(spark):
    for seed in range(3):
        edges, _, table = graph(spark, 24, 0.2, seed)
        r = random.Random(seed)
        labels = [r.choice([-1, 0, 1, 2, 3]) for _ in range(24)]
        m = np.zeros((24, 24))
        for i, j, s in edges:
            m[i, j] = m[j, i] = s
        members = {k: [i for i in range(24) if labels[i] == k] for k in sorted(set(labels) - {-1})}
        inner = [m[i, j] for g in members.values() for i, j in itertools.combinations(g, 2)]
        outer = [m[i, j] for a, b in itertools.combinations(members, 2) for i in members[a][:5] for j in members[b][:5]]
        shape = []
        for k, g in members.items():
            for i in g:
                if len(g) > 1:
                    near = 1 - sum(m[i, j] for j in g if j != i) / (len(g) - 1)
                    far = min(1 - np.mean([m[i, j] for j in h[:5]]) for q, h in members.items() if q != k)
                    shape.append((far - near) / max(near, far))
        row = metrics.quality(table_of(spark, labels), table).first()
        assert row["n_clusters"] == len(members)
        assert row["avg_similarity_within"] == pytest.approx(np.mean(inner)) and row["avg_similarity_between"] == pytest.approx(np.mean(outer))
        assert row["silhouette_score"] == pytest.approx(np.mean(shape))
    empty = metrics.quality(table_of(spark, [-1, -1]), table.where("false")).first()
    assert tuple(empty) == (0, 0.0, 0.0, -1.0, 0.0)


def test_geocoding(spark):
    df = spark.createDataFrame([(1, "A "), (2, "a"), (3, None), (4, "b"), (5, " ")], "id long, t string")
    table = geocoding.TableGeocoder(spark.createDataFrame([("a", 1.0, 2.0)], "key string, latitude double, longitude double"))
    done = geocoding.geocoded(df, "t", geocoding.NullGeocoder(), table)
    found = {r["id"]: r["geo_info"] for r in done.collect()}
    assert found[1]["source"] == "table" and found[2]["latitude"] == 1.0 and found[3] is None and found[4] is None
    assert geocoding.geocode_stats(done).first()["found"] == 2


def test_match_equals_all_pairs(spark):
    r = random.Random(8)
    make = lambda i: (i, f"road {r.randrange(4)}", "p", "c", "d", "s", 30 + r.random() / 30, 120 + r.random() / 30)
    new = [make(i) for i in range(20)] + [(99, "road 1", "p", "c", "d", "s", None, None)]
    reps = [make(i) for i in range(15)]
    n = spark.createDataFrame(new, "id long, standardized string, province string, city string, district string, street string, lat double, lon double").withColumn("original", F.col("standardized"))
    g = spark.createDataFrame([(f"g{x[0]}", *x) for x in reps], "group_id string, rep_pos long, standardized string, province string, city string, district string, street string, lat double, lon double")
    for threshold in (0.85, 0.5):
        found = {x["address_id"]: (x["group_id"], x["similarity"]) for x in incremental.match(n, g, threshold).collect()}
        pairs = n.select("id").crossJoin(g.select((F.col("rep_pos") + 1000).alias("r"))).select(F.col("id").alias("id1"), F.col("r").alias("id2"))
        both = n.drop("original").unionByName(g.drop("group_id").withColumn("id", F.col("rep_pos") + 1000).drop("rep_pos"))
        best = {}
        for x in scoring.scored(pairs, both).collect():
            if x["comprehensive_similarity"] >= threshold:
                best[x["id1"]] = max(best.get(x["id1"], (-1, 0)), (x["comprehensive_similarity"], -(x["id2"] - 1000)))
        assert len(found) == 21
        for i in found:
            assert found[i][0] == (f"g{-best[i][1]}" if i in best else None)


def test_execution(spark):
    df = spark.range(100).repartition(9)
    total = execution.map_reduce(df, lambda f: f.sum().to_frame().T.astype("int64"), lambda f: f.sum().to_frame().T.astype("int64"), "id long", fan_in=3)
    assert [r["id"] for r in total.collect()] == [4950]
    assert execution.map_batches(df, lambda f: f[f["id"] > 97], "id long").count() == 2


def far_and_near(seed, n, m):
    """Records with provinces that agree, differ or are missing, with and without coordinates, some polar or at the date line."""
    r = random.Random(seed)
    roads = ["".join(r.choice("abcdefghij") for _ in range(10)) for _ in range(4)]

    def make(i):
        text = r.choice([*roads, r.choice(roads)[:9] + "x", r.choice(roads)[::-1], "", None])
        lat, lon = r.choice([(30 + r.random() / 4, 120 + r.random() / 4), (None, None), (70.0 + r.random() / 50, 179.9 - r.random() / 50), (30.0, float("nan"))])
        return (i, text, r.choice(["p", "q", "", None]), r.choice(["c", "d"]), r.choice(["e", "f"]), r.choice(["s", ""]), lat, lon)

    return [make(i) for i in range(n)], [make(i) for i in range(m)]


SCHEMA = "long, standardized string, province string, city string, district string, street string, lat double, lon double"


@pytest.mark.parametrize(("weights", "threshold"), [((0.5, 0.3, 0.2), 0.7), ((0.4, 0.4, 0.2), 0.5), ((0.4, 0.4, 0.2), 0.85), ((0.7, 0.1, 0.2), 0.6), ((1.0, 0.0, 0.0), 0.9), ((0.4, 0.4, 0.2), 0.3)])
def test_match_equals_all_pairs_whatever_excludes_them(spark, weights, threshold):
    new, reps = far_and_near(21, 60, 50)
    settings = EngineConfig(text_weight=weights[0], spatial_weight=weights[1], admin_weight=weights[2])
    n = spark.createDataFrame(new, f"id {SCHEMA}").withColumn("original", F.col("standardized"))
    g = spark.createDataFrame([(f"g{x[0]}", *x) for x in reps], f"group_id string, rep_pos {SCHEMA}")
    found = {x["address_id"]: x["group_id"] for x in incremental.match(n, g, threshold, settings).collect()}
    pairs = spark.createDataFrame([(i, 1000 + j) for i in range(60) for j in range(50)], "id1 long, id2 long")
    both = n.drop("original").unionByName(g.drop("group_id").withColumn("id", F.col("rep_pos") + 1000).drop("rep_pos"))
    best = {}
    for x in scoring.scored(pairs, both, settings).collect():
        if x["comprehensive_similarity"] >= threshold:
            best[x["id1"]] = max(best.get(x["id1"], (-1, 0)), (x["comprehensive_similarity"], 1000 - x["id2"]))
    assert found == {i: f"g{-best[i][1]}" if i in best else None for i in range(60)}
    assert best
    plan = incremental.compared(n, g, threshold, settings)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_candidates_that_can_reach_a_threshold(spark):
    rows, _ = far_and_near(22, 120, 0)
    a = spark.createDataFrame(rows, f"id {SCHEMA}")
    whole = scoring.scored(blocking.candidates(a), a, at_least=0.85)
    near = scoring.scored(blocking.candidates(a, at_least=0.85), a, at_least=0.85)
    pairs = lambda df: {(r["id1"], r["id2"]) for r in df.collect()}
    assert pairs(whole) <= pairs(near) and len(pairs(near)) > 3
    every = spark.createDataFrame(list(itertools.combinations(range(120), 2)), "id1 long, id2 long")
    assert pairs(near) == pairs(scoring.scored(every, a, at_least=0.85))


def test_running_sums_need_no_single_task(spark):
    r = random.Random(5)
    values = [(i, r.randrange(100)) for i in range(500)]
    r.shuffle(values)
    done = ordering.running(spark.createDataFrame(values, "k long, v long").repartition(7), ["k"], F.col("v"), "s")
    at, want = 0, {}
    for k, v in sorted(values):
        want[k], at = at, at + v
    assert {x["k"]: x["s"] for x in done.collect()} == want
    assert "SinglePartition" not in done._jdf.queryExecution().executedPlan().toString()
    assert ordering.numbered(spark.createDataFrame([], "k long"), ["k"], "n").count() == 0


def test_single_partition_windows_are_gone(spark):
    edges, nodes, table = graph(spark, 30, 0.06, 1)
    labels = table_of(spark, [i // 5 for i in range(30)])
    sizes = spark.createDataFrame([(0, 3), (1, 4)], "block long, n long")
    entries = spark.createDataFrame([(0, 1, 1, 2.0), (1, 0, 3, 1.0)], "block long, row long, col long, value double")
    for df in (clustering.validate(labels, table), scoring.block_diagonal(entries, sizes), metrics.cluster_summary(labels, spark.createDataFrame([(i, "o", "s", 1.0, 2.0) for i in range(30)], "id long, original string, standardized string, lat double, lon double"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not ("Window" in plan and "SinglePartition" in plan)
    assert sorted(map(tuple, scoring.block_diagonal(entries, sizes).collect())) == [(1, 1, 2.0), (3, 6, 1.0)]


def test_validate_equals_brute_force(spark):
    for seed in range(3):
        edges, _, table = graph(spark, 40, 0.05, seed)
        labels = [i // 8 if i % 9 else -1 for i in range(40)]
        strong = [(i, j) for i, j, s in edges if s >= 0.6 and labels[i] == labels[j] != -1]
        part, top = roots(40, strong), max(labels) + 1
        want, fresh = list(labels), 0
        for k in sorted(set(labels) - {-1}):
            own = [i for i in range(40) if labels[i] == k]
            if len(own) < 3 or sum(i in own for i, _ in strong) == len(own) * (len(own) - 1) // 2:
                continue
            names = sorted({part[i] for i in own})
            for i in own:
                if part[i] != names[0]:
                    want[i] = top + fresh + names.index(part[i])
            fresh += len(names)
        assert labels_of(clustering.validate(table_of(spark, labels), table)) == want


def test_equal_texts_are_hashed_once(spark):
    rows = [(i, "one text that is long enough") for i in range(40)] + [(100 + i, "one text that is long enougH") for i in range(3)] + [(200, "ab"), (201, "ab")]
    pairs = {tuple(x) for x in blocking.lsh_pairs(spark.createDataFrame(rows, "id long, text string"), EngineConfig(minhash_permutations=64)).collect()}
    assert pairs == {(0, i) for i in range(1, 40)} | {(0, 100)} | {(100, 101), (100, 102)}
    faithful = blocking.lsh_pairs(spark.createDataFrame(rows, "id long, text string"), EngineConfig(minhash_permutations=64, mode="faithful"))
    assert faithful.count() == 43 * 42 // 2 + 1


def test_large_blocks_are_split(spark, monkeypatch):
    monkeypatch.setattr(blocking, "BLOCK_ROWS", 7)
    df = spark.createDataFrame([(i, "p", "c", "d") for i in range(30)] + [(99, "q", "c", "d")], "id long, province string, city string, district string")
    assert {tuple(x) for x in blocking.admin_pairs(df).collect()} == set(itertools.combinations(range(30), 2))


def test_minhash_pairs_equal_brute_force(spark):
    """Every pair that shares a band of its signatures, and no other; signatures from the hashes that Spark gives."""
    r = random.Random(6)
    texts = ["".join(r.choice("abcd") for _ in range(r.randint(1, 12))) for _ in range(40)]
    settings = EngineConfig(minhash_permutations=32, lsh_threshold=0.4)
    bands, rows = blocking.bands_and_rows(0.4, 32)
    df = spark.createDataFrame(list(enumerate(dict.fromkeys(texts))), "id long, text string")
    grams = {t: {t[i : i + 3] for i in range(len(t) - 2)} for t in texts}
    flat = [(g, k) for g in set().union(*grams.values()) for k in range(bands * rows)]
    hashed = spark.createDataFrame(flat, "g string, k int").select("g", "k", F.xxhash64(F.xxhash64("g"), "k").alias("h")).collect()
    h = {(x["g"], x["k"]): x["h"] for x in hashed}
    sign = {t: [min(h[g, k] for g in grams[t]) for k in range(bands * rows)] for t in grams if grams[t]}
    share = lambda a, b: any(a[i * rows : (i + 1) * rows] == b[i * rows : (i + 1) * rows] for i in range(bands))
    named = [(x["id"], x["text"]) for x in df.collect() if x["text"] in sign]
    want = {(i, j) for (i, a), (j, b) in itertools.combinations(sorted(named), 2) if share(sign[a], sign[b])}
    assert {tuple(x) for x in blocking.lsh_pairs(df, settings).collect()} == want and want
    assert df.select("text", similarity.minhash(F.col("text"), 3, bands * rows).alias("s")).where("s is not null").count() == len(named)


def test_dbscan_on_points(spark):
    edges, nodes, table = graph(spark, 14, 0.3, 9)
    r = random.Random(9)
    places = [(i, *r.choice([(30.0, 120.0), (-20.0, 10.0), (None, None)])) for i in range(14)]
    m = np.ones((14, 14)) - np.eye(14)
    for i, j, s in edges:
        m[i, j] = m[j, i] = 1 - s
    extra = np.array([(0, 0) if a is None else ((a + 90) / 180, (b + 180) / 360) for _, a, b in places])
    x = np.hstack([m, extra])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    eps = float(np.sort(d[np.triu_indices(14, 1)])[12]) + 1e-6
    near = {i: {j for j in range(14) if d[i, j] <= eps} for i in range(14)}
    core = {i for i in near if len(near[i]) >= 3}
    root = roots(14, [(i, j) for i in core for j in near[i] & core])
    found = labels_of(clustering.dbscan_points(spark.createDataFrame(places, "id long, lat double, lon double"), table, eps, 3))
    for i in core:
        for j in core:
            assert (found[i] == found[j]) == (root[i] == root[j])
    assert all((found[i] == -1) == (i not in core and not near[i] & core) for i in range(14)) and core


def test_large_components_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(clustering, "MOST_NODES", 3)
    edges = spark.createDataFrame([(0, 1, 0.9), (1, 2, 0.9), (2, 3, 0.9)], "id1 long, id2 long, sim double")
    with pytest.raises(Exception, match="beyond the 3"):
        clustering.hierarchical(spark.range(4), edges, distance_threshold=0.5).collect()


def places(spark):
    rows = [(i, f"name {i % 7}", "p", "c" if i % 3 else None, f"d{i % 2}", "", 30 + i % 10 * 0.03, None if i % 11 == 10 else -0.05 + i % 5 * 0.03) for i in range(60)]
    return spark.createDataFrame(rows, "id long, standardized string, province string, city string, district string, street string, lat double, lon double")


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_pairs_carry_their_rows(spark):
    """What pairs carry is what a join with their rows gives, and no join of pairs is left; with repeated ids too, pairs come once."""
    df = places(spark)
    side = lambda t: df.select(*[F.col(c).alias(f"{c}{t}") for c in ("id", "city", "lat")])
    for make in (blocking.admin_pairs, blocking.spatial_pairs):
        plain, carried = make(df), make(df, carry=("city", "lat"))
        want = plain.join(side(1), "id1").join(side(2), "id2").select(*carried.columns)
        assert joins(carried) == joins(plain)
        assert sorted(map(str, carried.collect())) == sorted(map(str, want.collect())) != []
    for settings in (EngineConfig(), EngineConfig(skip_unparsed_block=True)):
        for table in (df, df.unionByName(df.where("id < 5").withColumn("city", F.lit("other"))), df.withColumns({c: F.lit(None).cast("string") for c in ("province", "city", "district")})):
            want = blocking.union_pairs(blocking.admin_pairs(table, settings), blocking.spatial_pairs(table, settings)).collect()
            assert sorted(blocking.admin_or_spatial_pairs(table, settings).collect()) == sorted(want)
    pairs = blocking.admin_or_spatial_pairs(df)
    one, two = scoring.scored(pairs, df), scoring.scored_rows(blocking.admin_or_spatial_pairs(df, carry=scoring.PARTS))
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_rows_of_one_place_meet_as_one(spark):
    """Near pairs compare places, not rows: the cells' join sees each place once."""
    df = places(spark).select("id", "lat", "lon")
    found = blocking.near_pairs(df, df, 4.0)
    assert "Aggregate [lat" in found._jdf.queryExecution().optimizedPlan().toString()
    side = lambda t: df.where("lon is not null").select(F.col("id").alias(f"{t}id"), F.col("lat").alias(f"{t}lat"), F.col("lon").alias(f"{t}lon"))
    every = side("").crossJoin(side("r_")).where(geo.haversine_km(*[F.col(c) for c in ("lat", "lon", "r_lat", "r_lon")]) <= 4.0)
    assert sorted(found.collect()) == sorted(every.select("id", "r_id").collect())
