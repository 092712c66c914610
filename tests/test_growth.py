"""Work that must not be done once more for every group or every reader: seen in the calls and plans, not in seconds."""

import pytest
from quirework.catalog import annotations, pages, scalars
from quirework.plans import fixtures as fx
from quirework.plans import near

from .conftest import SF_DIR


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keep_first_scans_groups_together(spark, monkeypatch):
    """Groups that end and go on at batch borders, in few tasks, without a grouped call of Python; ids with nulls are struct fields."""
    def refuse(*_):
        raise AssertionError("a call for each group")

    monkeypatch.setattr("pyspark.sql.pandas.group_ops.PandasGroupedOpsMixin.applyInPandas", refuse)
    monkeypatch.setattr("pyspark.sql.GroupedData.applyInPandas", refuse)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        # Chains of 1 to 9 places: every second one is dropped.
        chains = [[(g, k) for k in range(g % 9 + 1)] for g in range(200)]
        node = lambda g, k: (None if g == 0 else g, f"{k:02}")
        kind = "struct<ord: int, ann_id: string>"
        nodes = spark.createDataFrame([(node(*p),) for c in chains for p in c], f"node {kind}")
        edges = spark.createDataFrame([(node(*p), node(*q)) for c in chains for p, q in zip(c, c[1:])], f"earlier {kind}, later {kind}")
        want = {node(g, k) for c in chains for g, k in c if k % 2 == 0}
        for block in (3,):
            assert {tuple(r.node) for r in near.keep_first(nodes, edges, block).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_page_numbers_without_shuffled_text(spark):
    """Of a document, only page numbers reach the shuffle."""
    plan = _plan(fx.pages(spark, SF_DIR))
    below = plan[plan.index("Exchange"):]
    assert "Generate" in below and "Generate" not in plan[:plan.index("Exchange")]


@pytest.mark.parametrize("query", [pages.paste_annotations, annotations.dedupe_on_load])
def test_derived_tables_are_written_once(spark, query):
    """Annotations and pages are derived from the documents once, not by every branch of the plan."""
    read = query(spark, SF_DIR).inputFiles()
    assert read and not any(t in f for f in read for t in ("documents.parquet", "events.parquet"))


def test_characters_are_counted_without_a_sort(spark):
    """The one sort left is that of the words of a line."""
    plan = _plan(scalars.explode_characters(spark, SF_DIR))
    assert "SortAggregate" not in plan and plan.count("Sort [") == 1
