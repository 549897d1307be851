"""Raking of many cells as a table gives what raking on the driver does."""

import pytest

from keyloom.llm import mixing


@pytest.mark.parametrize("source", [0.7, {"s0": 0.4, "s1": 0.1, "absent": 0.1}])
def test_many_cells(spark, source, monkeypatch):
    rows = [(i, f"word {i} " * (1 + (i * i) % 9) + ("| x" if i % 5 == 0 else ""), f"l{i % 3}", f"s{i % 7 if i % 2 else 0}") for i in range(400)] + [(1000, "", "l0", "empty"), (1001, None, None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    how = mixing.Mix(source=source)
    want = {r.doc_id: r for r in mixing.mix(table, how).collect()}
    monkeypatch.setattr(mixing, "MAX_CELLS", 3)
    got = {r.doc_id: r for r in mixing.mix(table, how).collect()}
    assert want.keys() == got.keys() and all(abs(got[i].weight - want[i].weight) < 1e-6 * max(1, want[i].weight) for i in want)
    assert mixing.mix(table.filter("doc_id > 999"), how).count() == 2
