"""The pipeline on a small table: what each stage drops, by brute force."""

import os

import corpus_pipeline
import numpy as np


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(8)
    text = lambda n=60: " ".join(f"word{x}" for x in rng.integers(0, 4000, n)) + "."
    rows, quality = [], {}
    for i in range(120):
        rows.append((i, text(), "en", f"s{i % 4}", 0))
        quality[i] = 1
    for i in range(120, 160):
        rows.append((i, " | ".join(text(2) for _ in range(10)), "en", f"s{i % 4}", 0))
        quality[i] = 0
    item = text(30)
    rows += [(200, rows[0][1].upper(), "en", "s0", 0), (201, rows[1][1], "en", "s1", 0), (202, rows[2][1] + " .", "en", "s2", 0), (203, text(20) + " " + item + " " + text(20), "en", "s3", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in quality.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/out-{len(kept)}")
        docs = spark.read.parquet(f"{tmp_path}/out-{len(kept)}")
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        if len(kept) < 5:
            assert docs.columns == columns
    clean = set(range(3, 120))
    assert all(clean <= k for k in kept[:4]) and not kept[0] & set(range(120, 160))
    assert 0 not in kept[1] and 1 not in kept[1] and {200, 201} <= kept[1]
    assert 203 in kept[2] and 203 not in kept[3]
    assert kept[4] <= kept[3] and len(kept[4]) > 0.4 * len(kept[3]) and "mix_copies" in docs.columns
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == kept[4]


def test_stage_list():
    assert [f.__module__ for _, f in corpus_pipeline.STAGES] == ["corpus_pipeline"] * 5 and os.path.basename(corpus_pipeline.__file__) == "corpus_pipeline.py"
