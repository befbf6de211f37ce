"""The pipeline against its stages' brute-force versions, and its contract."""

import corpus_pipeline
from pyspark.sql import functions as F
from test_operators import brute_decontaminate, brute_jaccard, brute_lines

from tracklake.llm import line_templates, quality_rules


def test_stages(spark, docs, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(quality_rules, "SHRINK", 5)
    bench = [(1, " ".join(rows[8][1].split()[50:80])), (2, None)]
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    now = table
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in now.collect()}
        out = stage(spark, now, str(tmp_path)).cache()
        seen.append((name, before, out))
        if name != "mixing":
            assert out.dtypes == table.dtypes
        now = out
    kept = {r.doc_id for r in quality_rules.judge(table).where("kept").collect()}
    assert {r.doc_id for r in seen[0][2].collect()} == kept
    after = {r.doc_id: r.text for r in seen[1][2].collect()}
    assert after == brute_lines(sorted(seen[1][1].items()), line_templates.MIN_DOCS, line_templates.TEMPLATE_DOCS)
    assert all(r.n_chars == len(r.text) for r in seen[1][2].collect())
    groups = brute_jaccard(seen[2][1].items(), 5, 80)
    assert {r.doc_id for r in seen[2][2].collect()} == {i for i, v in groups.items() if v[1] == i}
    hits = brute_decontaminate(seen[3][1].items(), bench)
    assert {r.doc_id for r in seen[3][2].collect()} == {i for i, v in hits.items() if not v[4]} and len(hits) > len(seen[3][2].collect())
    mixed = seen[4][2]
    assert mixed.columns == [*table.columns, "copy"] and mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.copy, r.text) for r in whole.collect()) == sorted((r.doc_id, r.copy, r.text) for r in mixed.collect())


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
