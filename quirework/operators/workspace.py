"""Documents opened from a store, edited, and saved as one new version."""

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.settle import settle
from ..sources.versions import TableStore
from . import annotations as ann
from . import pages as pg

PAGE_KEY = ["doc_id", "page_number"]


@dataclass(frozen=True)
class Workspace:
    """Pages, the annotation rows as stored, and the current annotations, of any number of documents.

    Each edit gives a new workspace; nothing of it is in the store before ``save``.  Edits of pages move the stored rows, too, as those
    that are not ours survive a save.  ``stored`` and ``current`` have the same columns.
    """

    store: TableStore
    base: int
    pages: DataFrame
    stored: DataFrame
    current: DataFrame

    @classmethod
    def open(cls, store: TableStore) -> "Workspace":
        base = store.version()
        stored = store.read("annotations", base)
        ours = ann.is_managed(F.col("subtype"), F.col("custom"), F.col("stamped"), F.col("stamp_contents"))
        return cls(store, base, store.read("pages", base), stored, stored.filter(ours))

    def _with(self, **tables) -> "Workspace":
        """Later edits read each table several times, so it is written once to the shared folder."""
        return replace(self, **{name: settle(df) for name, df in tables.items()})

    def edit(self, changes: DataFrame, fields: list[str]) -> "Workspace":
        """Add, update and remove annotations."""
        return self._with(current=ann.apply_changes(self.current, changes, fields))

    def _renumber(self, mapping: DataFrame) -> "Workspace":
        return self._with(**{n: pg.renumber(getattr(self, n), mapping) for n in ("pages", "stored", "current")})

    def reorder(self, requests: DataFrame) -> "Workspace":
        return self._renumber(pg.reorder_map(self.pages, requests))

    def delete(self, deletions: DataFrame) -> "Workspace":
        return self._renumber(pg.deletion_map(self.pages, deletions))

    def insert_blank(self, requests: DataFrame) -> "Workspace":
        valid = requests.join(pg.page_count(self.pages), "doc_id").filter(
            (F.col("at") >= 0) & (F.col("at") <= F.col("page_count"))).select("doc_id", "at", F.lit(1).alias("count"))
        return self._with(pages=pg.insert_blank(self.pages, requests), stored=pg.shift_for_insert(self.stored, valid),
                          current=pg.shift_for_insert(self.current, valid))

    def rotate(self, turns: DataFrame) -> "Workspace":
        return self._with(pages=pg.rotate_pages(self.pages, turns))

    def flatten(self, pages: DataFrame) -> "Workspace":
        """Annotations of these pages become part of them, foreign ones included."""
        return self._with(stored=ann.flatten(self.stored, pages)[0], current=ann.flatten(self.current, pages)[0])

    def save(self) -> "Workspace":
        """Write pages and annotations as the next version, and open it."""
        self.store.save({"pages": self.pages, "annotations": ann.sync_annotations(self.stored, self.current)}, self.base)
        return Workspace.open(self.store)
