import random
import re

import pytest
import xxhash

from postalloom.llm import simhash
from tests.llm.common_rows import documents, frame


def slow(text, shingle=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, radius=2):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprints(monkeypatch):
    for _, t, *_ in documents():
        assert simhash.fingerprint(t) == slow(t)
    monkeypatch.setattr(simhash, "CHUNK", 7)
    for _, t, *_ in documents():
        assert simhash.fingerprint(t) == slow(t)


def test_masks_cover_every_pair_within_the_radius():
    r = random.Random(1)
    for radius in (1, 2, 3):
        masks = simhash.masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(2000):
            x = r.getrandbits(64)
            y = x
            for b in r.sample(range(64), radius):
                y ^= 1 << b
            assert any(x & m == y & m for m in masks)


@pytest.mark.parametrize("whole", [64, 3])
@pytest.mark.parametrize("radius", [2, 1])
def test_links_have_the_components_of_all_pairs(spark, monkeypatch, whole, radius):
    monkeypatch.setattr(simhash, "WHOLE", whole)
    r = random.Random(2)
    fps = {r.getrandbits(64) for _ in range(30)}
    for x in list(fps)[:12]:  # chains of near neighbours, and a dense ball
        for _ in range(12):
            x ^= 1 << r.randrange(64)
            if r.random() < 0.6:
                x ^= 1 << r.randrange(64)
            fps.add(x)
    ball = r.getrandbits(64)
    fps |= {ball ^ (1 << b) for b in range(64)}
    fps = sorted(fps)
    from postalloom.operators.components import components as connected

    frame_ = spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long")
    label = {r["node"] % 2**64: r["label"] % 2**64 for r in connected(simhash.links(frame_, radius)).collect()}
    want = components(fps, radius)
    groups, found = {}, {}
    for x, c in zip(fps, want, strict=True):
        groups.setdefault(c, set()).add(x)
        found.setdefault(label.get(x, x), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_query_equals_brute_force(spark, tmp_path):
    base = " ".join(f"k{i}" for i in range(3000))
    near = [base, base.replace("k1500 ", "other "), base.replace("k20 ", "new ").replace("k900 ", "x ")]
    rows = documents(near)
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(map(str, map(tuple, simhash.query(spark, str(tmp_path)).select("doc_id", "fingerprint", "component_id").collect())))
    fps = [slow(t) for _, t, *_ in rows]
    roots = components(fps)
    ids = {}
    for (i, *_), c in zip(rows, roots, strict=True):
        if i is not None:
            ids[c] = min(ids.get(c, i), i)
    assert found == sorted(str((i, f"{f:016x}", ids.get(c))) for (i, *_), f, c in zip(rows, fps, roots, strict=True))
