"""Each stage of the pipeline on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import corpus_pipeline

LONG = "Very long texts go on and on with one word after another, so they do. " * 3000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, fp long, component long, keep_id long, p double, mix_rate string, hits int"


def test_stages_on_odd_rows(spark, tmp_path):
    plain = lambda i: f"This is sentence number {i} of a plain text, which says {i * 7} things in {i + 3} words or so, and no more."
    rows = [(i, plain(i), "en", "s", 0) for i in range(40)]
    odd = [(100, None, None, None, None), (101, "", "en", "s", 0), (102, LONG, "en", "s", 0), (103, LONG.upper(), "en", "t", 0), (104, plain(200), "de", "s", 0), (104, plain(200), "de", "s", 0), (None, plain(300), "en", "s", 0), (None, None, None, None, None), (105, plain(400) + " " + plain(500), "en", "s", 0)]
    table = spark.createDataFrame([(*r, 1, 2, 3, 4, 0.5, "own", 6) for r in rows + odd], SCHEMA)
    spark.createDataFrame([(i, int(i != 3), 0) for i in range(40)] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, plain(500)), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, str(tmp_path))
        assert out.columns[: len(table.columns)] == table.columns and stage(spark, table.limit(0), str(tmp_path)).count() == 0
        kept = out.collect()
        assert all(r.component == 3 and r.mix_rate == "own" for r in kept)
        got[name] = sorted(((r.doc_id is None, r.doc_id or 0) for r in kept))
    ids = [i for i in range(40)]
    named = lambda xs: sorted((x is None, x or 0) for x in xs)
    assert set(named([None, None])) <= set(got["quality"]) and (False, 104) in got["quality"]
    assert got["exact dedup"] == named([*ids, 101, 103, 104, 104, 105, None, None])  # of 100 and 101, both empty, and of 102 and 103 the greater stays
    assert got["near dedup"] == named([*ids, 100, 102, 104, 104, 105, None, None])  # here the least
    assert got["decontamination"] == named([*ids, 100, 101, 102, 103, 104, 104, None, None])
    assert not [x for x in got["mixing"] if x[0]]  # rows without a doc_id are not drawn
    assert got["mixing"].count((False, 104)) in (0, 2)


def test_no_text_is_lost_with_a_repeated_id(spark):
    table = spark.createDataFrame([(5, "a"), (5, "b"), (9, "A"), (7, "c"), (8, "C")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.exact_copies(spark, table, "").collect()) == [(5, "a"), (5, "b"), (8, "C"), (9, "A")]
