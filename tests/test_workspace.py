"""Saving: versions of a set of tables, failures half-way, and several savers."""

import pytest
from pyspark.sql import functions as F

from quirework.operators.workspace import Workspace
from quirework.sources.versions import SaveConflict, TableStore

PAGE = "doc_id long, page_number int, width double, height double, rotation int"
ANN = ("ann_id string, doc_id long, page_number int, type string, subtype string, custom boolean, stamped boolean, "
       "stamp_contents boolean, note string")


@pytest.fixture
def store(spark, tmp_path):
    out = TableStore(spark, str(tmp_path / "store"))
    assert out.version() == 0
    pages = spark.createDataFrame([(d, p, 600.0, 800.0, 0) for d in (1, 2) for p in range(3)], PAGE)
    anns = spark.createDataFrame(
        [("h", 1, 0, "highlight", "Highlight", False, False, False, None), ("foreign", 1, 1, "link", "Link", False, False, False, None),
         ("note", 2, 2, "text", "FreeText", False, False, False, None)], ANN)
    assert out.save({"pages": pages, "annotations": anns}, 0) == 1
    return out


def state(store):
    return (sorted(tuple(r) for r in store.read("pages").collect()), sorted((r.ann_id, r.doc_id, r.page_number, r.note) for r in store.read("annotations").collect()))


def changes(spark, *rows):
    cols = "doc_id long, ann_id string, op string, ts int, event_id int, page_number int, type string, subtype string, custom boolean, stamped boolean, stamp_contents boolean, note string"
    return spark.createDataFrame(rows, cols)


FIELDS = ["page_number", "type", "subtype", "custom", "stamped", "stamp_contents", "note"]


def test_save_and_reopen(spark, store):
    work = Workspace.open(store)
    assert {r.ann_id for r in work.current.collect()} == {"h"}
    work = work.edit(changes(spark, (1, "h", "update", 1, 1, None, None, None, None, None, None, "seen"),
                             (2, "new", "add", 1, 2, 0, "draw", "Ink", False, False, False, None)), FIELDS)
    work = work.delete(spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, page_number int"))
    before = state(store)
    saved = work.save()
    assert saved.base == 2 and state(store) != before
    assert state(store)[1] == [("foreign", 1, 0, None), ("note", 2, 1, None)]
    assert [r[:2] for r in state(store)[0]] == [(1, 0), (1, 1), (2, 0), (2, 1)]
    assert sorted(r.ann_id for r in store.read("annotations", 1).collect()) == ["foreign", "h", "note"]  # the old version is there still


def test_a_save_that_fails_leaves_the_old_version(spark, store):
    before = state(store)
    work = Workspace.open(store)
    bad = work.current.withColumn("note", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        Workspace(store, work.base, work.pages.filter("page_number = 0"), work.stored, bad).save()
    assert store.version() == 1 and state(store) == before
    # A commit file whose writer was lost is no version, and the next save goes past it.
    store._fs.create(store._at("commits", f"{2:012d}.json"), False).close()
    assert store.version() == 1 and state(store) == before
    assert store.save({"pages": work.pages.filter("page_number = 0")}, 1) == 3
    assert len(state(store)[0]) == 2 and state(store)[1] == before[1]


def test_two_savers(spark, store):
    first, second = Workspace.open(store), Workspace.open(store)
    first.rotate(spark.createDataFrame([(1, 0, 90)], "doc_id long, page_number int, degrees int")).save()
    with pytest.raises(SaveConflict):
        second.flatten(spark.createDataFrame([(1, 0)], "doc_id long, page_number int")).save()
    assert state(store)[0][0] == (1, 0, 800.0, 600.0, 90) and ("h", 1, 0, None) in state(store)[1]
