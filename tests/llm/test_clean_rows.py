"""Rows without an id of their own are judged by their own text."""

from quillgraph.llm import decontamination

from .conftest import prose


def test_clean_takes_contaminated_rows_only(spark):
    item = prose(77, 40)
    rows = [(None, item, "a"), (None, prose(1, 50), "b"), (7, item, "c"), (7, prose(2, 50), "d"), (8, prose(3, 50), "e"), (None, None, "f")]
    data = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    kept = decontamination.clean(data, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert kept.columns == data.columns
    assert sorted(r.source for r in kept.collect()) == ["b", "d", "e", "f"]
