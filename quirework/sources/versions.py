"""Tables that are saved together: written first, then switched to by one small file.

A save writes every table to a folder of its own and then creates the commit file of the next version, which names the folders.
Readers go by the newest commit, so a save that fails half-way leaves the old version, and one that started from an older
version than the present one is refused.
"""

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class SaveConflict(RuntimeError):
    """Someone else has saved since the tables were opened."""


class TableStore:
    """Versions of a set of tables below ``path``, on any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._commits = self._at("commits")
        self._fs = self._commits.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _numbers(self):
        if not self._fs.exists(self._commits):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(self._commits))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def _commit(self, number):
        stream = self._fs.open(self._at("commits", f"{number:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            return None  # its writer was lost while it wrote: no commit
        finally:
            stream.close()

    def version(self) -> int:
        """The newest version, 0 before the first save."""
        return next((n for n in reversed(self._numbers()) if self._commit(n)), 0)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        entry = self._commit(self.version() if version is None else version)[table]
        return self.spark.read.schema(StructType.fromJson(entry["schema"])).parquet(f"{self.path}/{entry['folder']}")

    def save(self, tables: dict[str, DataFrame], base: int) -> int:
        """Write the tables and switch to them; tables that aren't given stay as they are in version ``base``."""
        entries = dict(self._commit(base)) if base else {}
        folder = f"data/{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{self.path}/{folder}/{name}")
            entries[name] = {"folder": f"{folder}/{name}", "schema": df.schema.jsonValue()}
        if self.version() != base:
            raise SaveConflict(f"version {base} was opened, {self.version()} is there now")
        number = (self._numbers() or [0])[-1] + 1
        try:  # creating a file that is there already fails, so of two savers one wins
            stream = self._fs.create(self._at("commits", f"{number:012d}.json"), False)
        except Exception as e:
            raise SaveConflict(f"version {number} has just been saved") from e
        try:
            stream.write(bytearray(json.dumps(entries).encode()))
        finally:
            stream.close()
        return number
