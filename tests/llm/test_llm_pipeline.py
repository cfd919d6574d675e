import os

import corpus_pipeline
from prose import prose


def test_stages_keep_the_columns_and_do_their_work(spark, docs, tmp_path):
    item = prose(9000, 36)
    rows = [(i, prose(i, 90), "en", f"s{i % 4}", 1) for i in range(80)]
    rows += [(100 + i, rows[i][1] if i % 2 else rows[i][1] + " end", "en", "s1", 1) for i in range(10)]
    rows += [(200 + i, "\n".join(f"{w.upper()}!!" for w in prose(300 + i, 60).split()), "en", "s2", 1) for i in range(30)]
    rows += [(400, prose(400, 50) + "\n" + item, "en", "s3", 1), (401, prose(401, 60) + "\ntoken=abcdef123456", "en", None, 1), (402, None, None, None, None)]
    documents = docs(rows)
    folder = str(tmp_path)
    documents.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(r[0], int(not 200 <= r[0] < 230), 0) for r in rows if r[0] % 2 == 0], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    seen, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen, folder).write.parquet(os.path.join(folder, name))
        last, seen = seen, spark.read.parquet(os.path.join(folder, name))
        if k < 4:
            assert seen.columns == documents.columns
        kept[name] = {r["doc_id"]: r for r in seen.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == list(kept) and last is not None
    assert not any(200 <= d < 230 for d in kept["quality_classifier"]) and set(range(80)) <= set(kept["quality_classifier"])
    assert set(kept["near_dedup"]) == {d for d in kept["quality_classifier"] if not 100 <= d < 110}
    assert set(kept["near_dedup"]) - set(kept["decontamination"]) == {400}
    assert set(kept["secret_scan"]) == set(kept["decontamination"]) and kept["secret_scan"][401]["text"].endswith("[SECRET]")
    assert kept["mixture"] and all(r["copies"] >= 1 for r in kept["mixture"].values())
    ran = corpus_pipeline.run(spark, folder)
    assert sorted(map(str, ran.collect())) == sorted(map(str, kept["mixture"].values()))


def test_stages_take_empty_tables(spark, docs, tmp_path):
    folder = str(tmp_path)
    docs([]).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
