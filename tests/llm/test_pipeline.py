import corpus_pipeline
from postalloom.llm import exact_dedup, line_dedup, packing, quality_classifier, quality_rules, simhash
from tests.llm.common_rows import documents, frame
from tests.llm.test_quality import corpus, docs_of, labels_of


def test_stages_follow_their_operators(spark, tmp_path):
    rows = corpus(400, 10)
    copies = [(1000 + i, t, q) for i, t, q in rows[:40]]
    docs_of(spark, rows + copies).write.parquet(f"{tmp_path}/documents.parquet")
    labels_of(spark, rows).write.parquet(f"{tmp_path}/labels.parquet")
    d = str(tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "quality_classifier", "line_dedup", "simhash_near_dedup", "packing"]
    before = docs
    for place, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, d)
        after.write.parquet(f"{d}/out{place}")
        after = spark.read.parquet(f"{d}/out{place}")
        ids = {r["doc_id"] for r in after.select("doc_id").collect()}
        source = {r["doc_id"]: r["text"] for r in before.collect()}
        if place < 4:
            assert after.columns == columns
        if place == 0:
            counts = quality_rules.cut(quality_rules.counted(before, ["doc_id"]))
            assert ids == {r["doc_id"] for r in quality_rules.judge(counts, quality_rules.fit(counts)).where("kept").collect()}
        elif place == 1:
            assert ids == set(source)
        elif place == 2:
            want = {r["doc_id"]: r["text"] for r in line_dedup.dedup(before).collect()}
            assert {r["doc_id"]: r["text"] for r in after.collect()} == want
            assert all(r["n_chars"] == len(r["text"]) for r in after.collect())
        elif place == 3:
            assert ids == {r["doc_id"] for r in simhash.keep_one(before).collect()}
            assert not any(i >= 1000 for i in ids) and len(ids) == len(set(source.values()))
        else:
            assert ids == set(source)
            assert sum(r["length"] for r in after.collect()) == sum(r["length"] for r in packing.pack(before, *packing.default_tokenizer()).collect())
        before = after
    run = corpus_pipeline.run(spark, d)
    assert sorted(map(str, run.select("doc_id", "length").collect())) != []
    assert {r["doc_id"] for r in run.select("doc_id").collect()} == ids
    assert exact_dedup.NAME and quality_classifier.NAME


def test_odd_rows_and_empty_tables(spark, tmp_path):
    labels_of(spark, corpus(5)).write.parquet(f"{tmp_path}/labels.parquet")
    for name, rows in (("odd", documents()), ("none", [])):
        d = f"{tmp_path}/{name}"
        frame(spark, rows).write.parquet(f"{d}/documents.parquet")
        labels_of(spark, corpus(5)).write.parquet(f"{d}/labels.parquet")
        docs = spark.read.parquet(f"{d}/documents.parquet")
        for stage_name, stage in corpus_pipeline.STAGES:
            done = stage(spark, docs, d)
            assert stage_name == "packing" or done.columns == docs.columns
            assert rows or done.count() == 0


def test_a_task_of_the_classifier_has_one_worker(spark, tmp_path, capsys):
    """Two Python functions in a row would take two workers for every task, which later stages go on using beside the heap."""
    rows = corpus(40, 10)
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    labels_of(spark, rows).write.parquet(f"{tmp_path}/labels.parquet")
    corpus_pipeline.classifier(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).explain()
    plan = capsys.readouterr().out
    assert "MapInArrow" in plan and "EvalPython" not in plan
