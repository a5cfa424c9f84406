import random
import re
import zlib
from collections import Counter

import numpy as np

from postalloom.llm import quality_classifier, quality_rules, text_stats
from tests.llm.common_rows import documents, frame


def slow(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            inside |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def test_counts_equal_brute_force():
    r = random.Random(5)
    texts = [t for _, t, *_ in documents()] + [" ".join(r.choice("ab") for _ in range(n)) for n in range(40)]
    texts += ["\n".join(r.choice(["a b c", "a", "", " ", "a\t#b$"]) for _ in range(20)) for _ in range(50)] + ["a b c d a b c"]
    for t in texts:
        assert tuple(text_stats.count(t)[:5]) == slow(t), t


def test_repeats_with_many_distinct_words():
    words = [str(i).encode() for i in range(3000)] * 2
    assert text_stats.repeated_words(words) == (6000, 3000)


def corpus(n=600, seed=6):
    """Good prose, and bad texts of three kinds: (doc_id, text, quality)."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(2000)]
    sentence = lambda: " ".join(r.choice(vocabulary) for _ in range(r.randint(5, 15))).capitalize() + "."
    out = []
    for i in range(n):
        kind = r.random()
        prose = "\n".join(" ".join(sentence() for _ in range(4)) for _ in range(r.randint(2, 6)))
        if kind < 0.06:
            text = " ".join(w + "***" for w in prose.split())
        elif kind < 0.12:
            text = " ".join(w.upper() + "!!" for w in prose.split())
        elif kind < 0.18:
            text = " ".join(["buy this now please"] * 60)
        else:
            text = prose
        out.append((i, text, 0 if kind < 0.18 else 1))
    return out


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")


def labels_of(spark, rows):
    return spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")


def test_rules_keep_good_and_reject_bad(spark):
    rows = corpus()
    kept = {r["doc_id"] for r in quality_rules.keep_good(docs_of(spark, rows)).collect()}
    good = {i for i, t, q in rows if q == 1}
    assert len(good - kept) <= 0.01 * len(good)
    assert not kept - good


def test_votes_are_a_posterior_whatever_the_share_of_bad():
    model = quality_rules.LabelModel.start(["a", "b", "b"], [0.002, 0.05, 0.05])
    patterns = np.array([[1, 1, 1], [-1, 1, 1], [-1, -1, 0], [0, 1, 1], [1, -1, -1], [1, -1, 1]])
    p = model.fit(patterns, np.array([900.0, 60.0, 30.0, 10.0, 20.0, 9.0])).posterior(patterns)
    assert p[0] > 0.9 and p[1] < 0.5 and p[2] < 0.1 and p[4] < 0.1 and p[5] > 0.5 and ((0 <= p) & (p <= 1)).all()


def test_known_accuracies_are_recovered():
    """Votes drawn from a model whose rates differ from the priors: the estimates come near them, and so do the verdicts."""
    r = np.random.default_rng(3)
    kinds = ["a", "a", "a", "b", "b", "c"]
    own, n = np.array([0, 0, 0, 1, 1, 2]) + 1, 200_000
    good = np.array([[0.001, 0.1, 0.899], [0.03, 0.3, 0.67], [0.08, 0.2, 0.72], [0.004, 0.5, 0.496], [0.02, 0.1, 0.88], [0.002, 0.3, 0.698]])
    bad = np.array([[0.9, 0.05, 0.05], [0.6, 0.1, 0.3], [0.4, 0.4, 0.2], [0.8, 0.1, 0.1], [0.75, 0.2, 0.05], [0.7, 0.2, 0.1]])
    shares = np.array([0.78, 0.1, 0.05, 0.07])
    classes = r.choice(4, n, p=shares)
    votes = np.stack([np.where(classes == own[k], r.choice(3, n, p=bad[k]), r.choice(3, n, p=good[k])) - 1 for k in range(6)], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    found = quality_rules.LabelModel.start(kinds, [0.005, 0.05, 0.05, 0.005, 0.05, 0.005]).fit(patterns, counts.astype(float))
    assert np.abs(found.shares - shares).max() < 0.02
    assert np.abs(found.good - good).max() < 0.02
    assert np.abs(found.bad - bad)[:5].max() < 0.1
    truth = quality_rules.LabelModel(shares, good, bad, own)
    differ = (found.posterior(patterns) >= 0.5) != (truth.posterior(patterns) >= 0.5)
    assert counts[differ].sum() < 0.01 * n


def slow_votes(text):
    """Each rule's vote, from the text itself."""
    n, chars, symbols, dup, repeats = slow(text)
    words, lines = (text or "").split(), [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\f\r")]
    share = lambda x, of=n: x / max(of, 1)
    vote = lambda bad, good: -1 if bad else 1 if good else 0
    many, variety = n >= 10, len(set(words)) / max(n, 1) ** 0.5
    caps, exclaims = sum(w.isupper() for w in words), (text or "").count("!")
    ended = sum(x.rstrip().endswith((".", "!", "?", '"', "'", ")", ":", "…", "。", "”", "»")) for x in lines)
    return (
        vote(many and share(symbols) > 0.2, many and share(symbols) < 0.02), vote(many and not 2 <= share(chars) <= 20, many and 3 <= share(chars) <= 10),
        vote(many and share(caps) > 0.4, many and share(caps) < 0.1), vote(many and share(exclaims) > 0.3, many and share(exclaims) < 0.05),
        vote(share(repeats) > 0.45, many and share(repeats) < 0.15), vote(n >= 50 and variety < 2, n >= 50 and variety > 4),
        vote(len(lines) >= 4 and share(dup, len(lines)) > 0.3, len(lines) >= 4 and share(dup, len(lines)) < 0.1),
        vote(len(lines) >= 8 and share(ended, len(lines)) < 0.1, len(lines) >= 4 and share(ended, len(lines)) > 0.5),
    )


def slow_verdicts(texts):
    """P(good) of each text: expectation-maximisation over single documents, in plain loops."""
    kinds, misfires = [0, 1, 2, 2, 3, 3, 3, 1], [0.005, 0.05, 0.005, 0.005, 0.005, 0.05, 0.05, 0.05]
    votes = [slow_votes(t) for t in texts]
    weight = max(1.0, 0.02 * len(votes))
    start = [0.85] + [0.0375] * 4, [[m, 0.3, 0.7 - m] for m in misfires], [[0.7, 0.2, 0.1] for _ in misfires]
    shares, good, bad = start
    for _ in range(500):
        mass = []
        for v in votes:
            like = [shares[c] * np.prod([(bad if kinds[k] + 1 == c else good)[k][x + 1] for k, x in enumerate(v)]) for c in range(5)]
            mass.append([x / sum(like) for x in like])
        before = shares
        shares = [(sum(m[c] for m in mass) + weight * start[0][c]) / (len(votes) + weight) for c in range(5)]
        good, bad = [], []
        for k, kind in enumerate(kinds):
            size, fine = sum(m[kind + 1] for m in mass), sum(m[0] for m in mass)
            hits = [sum(m[kind + 1] for m, v in zip(mass, votes, strict=True) if v[k] == x - 1) for x in range(3)]
            rest = [sum(m[0] for m, v in zip(mass, votes, strict=True) if v[k] == x - 1) for x in range(3)]
            bad.append([(hits[x] + weight * start[2][k][x]) / (size + weight) for x in range(3)])
            misfire = (rest[0] + 10 * weight * start[1][k][0]) / (fine + 10 * weight)
            others = [rest[x] + weight * start[1][k][x] for x in (1, 2)]
            good.append([misfire, *((1 - misfire) * x / sum(others) for x in others)])
        if max(abs(a - b) for a, b in zip(shares, before, strict=True)) < 1e-9:
            break
    return [m[0] for m in mass]


def test_verdicts_equal_a_slow_version(spark, tmp_path):
    texts = [t for _, t, _ in corpus(150, 12)] + [t for _, t, *_ in documents()]
    texts += ["\n".join(["one line that comes again and again, here as well."] * 3 + [f"word{i} and then{i} some{j} more{j * i} things." for j in range(9)]) for i in range(4)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in quality_rules.query(spark, str(tmp_path)).collect()}
    want = slow_verdicts(texts)
    assert all(abs(found[i]["p_good"] - p) < 1e-4 for i, p in enumerate(want))
    assert all(found[i]["kept"] == (not found[i]["base_failed"] and p >= 0.5) for i, p in enumerate(want))
    assert 20 < sum(r["kept"] for r in found.values()) < len(texts) - 20


def test_patterns_not_seen_are_rated(spark):
    counts = quality_rules.counted(docs_of(spark, corpus(60)), ["doc_id"])
    own = quality_rules.rules().values()
    model = quality_rules.LabelModel.start([r.kind for r in own], [r.misfires for r in own])
    assert quality_rules.judge(counts, model).where("p_good is null").count() == 0


def test_rules_on_odd_rows(spark, tmp_path):
    frame(spark).write.parquet(f"{tmp_path}/documents.parquet")
    rows = quality_rules.query(spark, str(tmp_path)).collect()
    want = Counter((i, *slow(t)) for i, t, *_ in documents())
    assert Counter(tuple(r)[:6] for r in rows) == want
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in rows)
    assert not any(r["kept"] and r["base_failed"] for r in rows)
    kept = quality_rules.keep_good(frame(spark))
    assert kept.columns == frame(spark).columns
    assert quality_rules.keep_good(frame(spark, [])).count() == 0


def test_classifier_on_held_out_rows(spark, tmp_path):
    rows = corpus(900, 8)
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    labels_of(spark, rows).write.parquet(f"{tmp_path}/labels.parquet")
    found = {r["doc_id"]: r for r in quality_classifier.query(spark, str(tmp_path)).collect()}
    assert len(found) == len(rows)
    held = [(i, q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i, _ in held} == {i for i, r in found.items() if r["held_out"]}
    right = sum(found[i]["predicted"] == q for i, q in held)
    assert right >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found.values())


def test_held_out_labels_are_not_used(spark):
    rows = corpus(300, 9)
    counts = quality_classifier.counted(docs_of(spark, rows), ["doc_id"]).cache()
    flipped = [(i, t, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q) for i, t, q in rows]
    a, b = (quality_classifier.fit(counts, labels_of(spark, x)) for x in (rows, flipped))
    assert np.allclose(a.means, b.means) and np.allclose(a.factors, b.factors)


def test_classifier_equals_the_densities():
    r = np.random.default_rng(1)
    x = [r.normal(0, 1, (200, 3)), r.normal(0.5, 2, (300, 3))]
    model = quality_classifier.Discriminant.fit(np.array([200.0, 300.0]), np.stack([a.sum(0) for a in x]), np.stack([a.T @ a for a in x]), 0.0, 0.0)
    points = r.normal(0, 2, (50, 3))
    logs = []
    for a in x:
        mean, cov = a.mean(0), np.cov(a.T, bias=True)
        d = points - mean
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1])
    want = 1 / (1 + np.exp(logs[0] - logs[1] - np.log(301 / 201)))
    assert np.allclose(model.score(points), want)


def test_classifier_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality_classifier.fit(quality_classifier.counted(frame(spark), ["doc_id"]), none)
    kept = quality_classifier.keep_good(frame(spark), model)
    assert kept.columns == frame(spark).columns and kept.count() == len(documents())
    assert quality_classifier.keep_good(frame(spark, []), model).count() == 0


def slow_scores(rows, labels):
    """Scores of (doc_id, text) by the formulas, one document at a time; labels: doc_id to class."""
    names = text_stats.COUNTS

    def statistics(text):
        c = dict(zip(names, text_stats.count(text), strict=True))
        words, lines = max(c["n_words"], 1), max(c["n_lines"], 1)
        share = lambda part, whole: np.log(1 + 100 * part / whole)
        return np.array([
            np.log(1 + c["n_words"]), np.log((c["word_chars"] + 5) / (words + 1)), share(c["n_symbols"], words), share(c["n_caps_words"], words), share(c["n_exclaims"], words),
            share(c["n_upper"], max(c["word_chars"], 1)), share(c["n_repeat_words"], words), np.log((c["n_distinct_words"] + 1) / np.sqrt(words + 1)), c["n_dup_lines"] / lines, np.log((words + 1) / (lines + 1)),
        ])

    train = [(statistics(t), labels[i]) for i, t in rows if i in labels and zlib.crc32(str(i).encode()) % 3 != 1]
    x, y = np.array([a for a, _ in train]), np.array([b for _, b in train])
    centre, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-6] = 1
    z = (x - centre) / scale
    spread = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    pooled = sum((y == k).sum() * spread[k] for k in (0, 1)) / len(y)
    out = []
    for _, t in rows:
        p, logs = (statistics(t) - centre) / scale, []
        for k in (0, 1):
            cov = 0.5 * spread[k] + 0.5 * pooled
            cov = 0.95 * cov + 0.05 * np.trace(cov) / len(cov) * np.eye(len(cov))
            d = p - z[y == k].mean(axis=0)
            logs.append(-0.5 * d @ np.linalg.solve(cov, d) - 0.5 * np.linalg.slogdet(cov)[1])
        odds = np.log(((y == 1).sum() + 1) / ((y == 0).sum() + 1))
        out.append(1 / (1 + np.exp(np.clip(logs[0] - logs[1] - odds, -700, 700))))
    return out


def test_classifier_query_equals_a_slow_version(spark, tmp_path):
    rows = [(i, t) for i, t, _ in corpus(300, 14)] + [(100_000 + k, t) for k, (_, t, *_) in enumerate(documents())] + [(None, "no id")]
    labels = {i: q for i, _, q in corpus(300, 14) if i % 5}
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in labels.items()] + [(None, 1, 0), (3, None, 0), (99, 7, 0)], "doc_id long, quality int, toxic int").where("doc_id is null or quality is not null").write.parquet(f"{tmp_path}/labels.parquet")
    found = {r["doc_id"]: r["score"] for r in quality_classifier.query(spark, str(tmp_path)).collect()}
    want = slow_scores(rows, labels)
    assert all(abs(found[i] - p) < 1e-6 for (i, _), p in zip(rows, want, strict=True))
