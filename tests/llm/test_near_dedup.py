import itertools
import random

from pyspark.sql import functions as F

import corpus_pipeline
from postalloom.llm import simhash
from tests.llm.common_rows import documents, frame


def grams(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def stay(rows):
    """The ids that stay, by brute force over all pairs of texts; ids are 0, 1, ... and none repeats."""
    sets = [grams(t) for t in rows]
    root = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        common = len(sets[i] & sets[j])
        if 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common) and root[i] != root[j]:
            a, b = sorted((root[i], root[j]))
            root = [a if x == b else x for x in root]
    return set(root)


def table_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def changed(r, text, places):
    words = text.split(" ")
    for i in places:
        words[i] = f"other{r.randrange(10**9)}"
    return " ".join(words)


def test_the_stage_finds_what_brute_force_finds(spark):
    r = random.Random(11)
    new = lambda n: " ".join(f"v{r.randrange(5000)}" for _ in range(n))
    texts = [new(n) for n in (100, 200, 300, 600) for _ in range(15)]
    texts += [changed(r, t, r.sample(range(len(t.split(" "))), k)) for t in list(texts) for k in (1, len(t.split(" ")) // 60, len(t.split(" ")) // 15)]
    texts += ["", " \n", "one", "One", "one two"]
    want = stay(texts)
    assert len(want) < len(texts) - 100
    assert {x["doc_id"] for x in corpus_pipeline.near_duplicates(spark, table_of(spark, texts), "").collect()} == want


def test_a_large_group_around_one_text(spark):
    """Copies that are within reach of the middle only, more than a bucket compares all with all."""
    r = random.Random(12)
    middle = " ".join(f"m{r.randrange(5000)}" for _ in range(400))
    texts = [changed(r, middle, [10 * i + 5 + 80 * j for j in range(5)] + [399 - i]) for i in range(8) for _ in range(8)]
    texts.insert(40, middle)
    assert len(stay(texts)) == 1
    assert [x["doc_id"] for x in simhash.keep_one(table_of(spark, texts)).collect()] == [0]


def test_odd_rows(spark):
    kept = simhash.keep_one(frame(spark, documents()))
    assert kept.columns == frame(spark).columns
    found = [(x["doc_id"], x["text"]) for x in kept.collect()]
    assert len(found) == len(set(found)) and (0, None) in found and (1, "") not in found and (3, "one") in found
    assert simhash.keep_one(frame(spark, [])).count() == 0


def test_recall_of_copies_with_changed_words(spark):
    """Of copies with 1 to 10 changed words and a Jaccard of 0.8 or more, brute force links 0.9 at least with their original as the stage does."""
    r = random.Random(13)
    texts, near = [], []
    for n, k in [(60, 1), (100, 1), (100, 2), (200, 2), (200, 4), (300, 5), (600, 5), (600, 10), (1200, 10)]:
        for _ in range(12):
            text = " ".join(f"v{r.randrange(5000)}" for _ in range(n))
            copy = changed(r, text, r.sample(range(n), k))
            a, b = grams(text), grams(copy)
            if 5 * len(a & b) >= 4 * len(a | b):
                texts.append(text)
                near.append(copy)
    assert len(near) > 90
    left = {x["doc_id"] for x in simhash.keep_one(table_of(spark, texts + near)).collect()}
    assert set(range(len(texts))) <= left
    assert len(left) - len(texts) <= 0.02 * len(near)


def test_crowds_and_a_full_filter(spark, monkeypatch):
    """A passage that all texts share makes large buckets; texts stay apart, and copies with a word changed are found."""
    monkeypatch.setattr(simhash, "CROWD", 4)
    monkeypatch.setattr(simhash, "PARTNERS", 3)
    monkeypatch.setattr(simhash, "MOST_CELLS", 1 << 10)
    r = random.Random(14)
    shared = " ".join(f"s{i}" for i in range(60))
    texts = [shared + " " + " ".join(f"v{r.randrange(5000)}" for _ in range(200)) for _ in range(40)]
    near = [changed(r, t, [100]) for t in texts] + texts[:10]
    left = sorted(x["doc_id"] for x in simhash.keep_one(table_of(spark, texts + near)).collect())
    assert left == list(range(40))


def test_pairs_that_meet_only_in_a_crowd(spark, monkeypatch):
    """All texts share one bucket and pairs hardly another, so most pairs have no representative between them; one task's share of the bucket is small."""
    whole = simhash.signatures
    monkeypatch.setattr(simhash, "signatures", lambda docs: whole(docs).withColumn("parts", F.array(F.lit(7).cast("long"))))
    monkeypatch.setattr(simhash, "CROWD_ROWS", 9, raising=False)
    r = random.Random(16)
    texts = [" ".join(f"v{r.randrange(5000)}" for _ in range(200)) for _ in range(40)]
    texts += [changed(r, t, [30, 70, 110, 150]) for t in texts]
    assert stay(texts) == set(range(40))
    assert {x["doc_id"] for x in simhash.keep_one(table_of(spark, texts)).collect()} == set(range(40))


def test_repeated_rows_and_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(150_000))
    rows = [(5, long), (6, long + " end"), (7, "a b c"), (7, "a b c"), (7, "a b c"), (7, "another text"), (None, "a b c"), (None, "q r s")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x["doc_id"] is None, x["doc_id"] or 0, x["text"][:12]) for x in kept) == [(False, 5, long[:12]), (False, 7, "a b c"), (False, 7, "another text"), (True, 0, "q r s")]


def test_sections_stay_where_nothing_changed(monkeypatch):
    r = random.Random(15)
    words = [f"v{r.randrange(5000)}" for _ in range(2000)]
    one = simhash.sections(simhash.np.concatenate(list(simhash.shingle_hashes(" ".join(words), 5))))
    words[1000] = "other"
    two = simhash.sections(simhash.np.concatenate(list(simhash.shingle_hashes(" ".join(words), 5))))
    assert len(set(one) - set(two)) <= 3 and len(one) > 40
    monkeypatch.setattr(simhash, "CHUNK", 37)
    chunks = simhash.sections(simhash.np.concatenate(list(simhash.shingle_hashes(" ".join(words), 5))))
    assert chunks.tolist() == two.tolist()
