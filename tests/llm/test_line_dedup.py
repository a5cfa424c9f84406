import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from postalloom.llm import line_dedup
from postalloom.llm.common import SPACES, UPPER
from tests.llm.common_rows import documents, frame


NULL = -(1 << 64)  # below every id


def brute(rows):
    holders = defaultdict(set)
    low = str.maketrans(UPPER, UPPER.lower())
    key = lambda x: x.strip(SPACES).translate(low)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                holders[key(x)].add(NULL if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= 5 and max(holders[key(x)]) != (NULL if i is None else i))]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


def run(spark, rows, tmp_path, name):
    frame(spark, rows).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    return Counter(tuple(r) for r in line_dedup.query(spark, f"{tmp_path}/{name}").select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect())


def test_equals_brute_force(spark, tmp_path):
    found = run(spark, documents(), tmp_path, "a")
    assert found == brute([(i, t) for i, t, *_ in documents()])
    assert sum(r[2] for r in found) == 13


def test_hot_and_cold_keys_agree(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_KEYS", 1)
    lines = [f"line number {i} that is long enough to be a key of its own" for i in range(6)]
    many = ["\n".join([lines[i % 6], "short", lines[(i * 5) % 6], lines[0], ""]) for i in range(40)] + ["\n".join(str(i) for i in range(200)) + "\n" + lines[0]]
    assert run(spark, documents(many), tmp_path, "b") == brute([(i, t) for i, t, *_ in documents(many)])


def test_other_columns_stay_and_empty_tables_pass(spark):
    done = line_dedup.dedup(frame(spark), counts=False)
    assert done.columns == frame(spark).columns and done.count() == len(documents())
    assert line_dedup.dedup(frame(spark, [])).count() == 0


def test_bitmaps_leave_out_untouched_words(spark):
    drops = spark.createDataFrame([(1, 9, 0), (1, 9, 64), (1, 9, 65), (1, 9, 700)], "doc_id long, copy long, pos int")
    keep = line_dedup.bitmaps(drops).first()["keep"]
    assert [(w["word"], w["bits"]) for w in keep] == [(0, ~1), (1, ~3), (10, ~(1 << 60))]


def test_ranges_are_sorted_once(spark):
    drops = line_dedup.dropped_lines(frame(spark).select("doc_id", "text"))
    plan = drops._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(h1" in plan and "hashpartitioning(h1#" not in plan.split("Union")[1].split("rangepartitioning")[0]
    assert drops.select(F.count("*")).first()[0] == 13


def test_rows_that_share_a_doc_id_keep_their_own_lines(spark, tmp_path):
    shared = "a line that six other documents have as well, and that is long"
    texts = [(1, f"zero\n{shared}"), (1, "one\nthe only copy of this important sentence, of which nobody has another"), (1, f"{shared}\n{shared}\ntwo")]
    texts += [(i, f"{shared}\nend {i}") for i in range(2, 8)] + [(-(1 << 63), f"{shared}\nleast"), (None, f"{shared}\nnull"), (None, "other null"), (1, f"zero\n{shared}")]
    rows = [(i, t, *documents()[0][2:]) for i, t in texts]
    found = run(spark, rows, tmp_path, "c")
    assert found == brute(texts)
    assert sum(r[2] * n for r, n in found.items()) == 11


def test_a_full_filter_and_long_texts_give_the_same(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(line_dedup, "MOST_CELLS", 1 << 10)
    line = "this line stands in very many documents, so that it goes from them"
    texts = [(i, f"{line}\n{i}") for i in range(3000)] + [(5000, "\n".join([line, *map(str, range(40_000))])), (5001, "x" * 2_000_000)]
    assert run(spark, [(i, t, *documents()[0][2:]) for i, t in texts], tmp_path, "d") == brute(texts)


def test_only_documents_with_dropped_lines_are_shuffled(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 50, F.lit("x" * 50)).otherwise(F.repeat(F.col("id").cast("string"), 20)).alias("text"))
    keep = line_dedup.bitmaps(line_dedup.dropped_lines(docs))
    touched, alone = line_dedup.with_drops(docs, keep)
    assert 49 <= touched.count() < 200 and touched.count() + alone.count() == 2000
    assert "hashpartitioning" not in alone._jdf.queryExecution().executedPlan().toString()
