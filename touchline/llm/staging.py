"""Tables between the steps of an operator, in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import lru_cache

from py4j.protocol import Py4JError, Py4JNetworkError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000  # id lists up to this many rows (8 bytes each) may be broadcast; longer ones are joined by shuffle


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="touchline-")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a session whose tasks run in the driver's own process may do without it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return _own_folder()
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


class Stage:
    """A folder below ``spark.checkpoint.dir`` for the written tables of one run; they cut lineage and survive lost executors.

    Tables that a later step has replaced are removed by ``free``; the rest go with ``remove``, or when the driver ends."""

    _open: dict[str, "Stage"] = {}

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.path, self.n = spark, f"{shared_folder(spark)}/touchline-{uuid.uuid4().hex}", 0
        self._tables: dict[int, tuple[DataFrame, str]] = {}
        self._hadoop, self._conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
        Stage._open[self.path] = self

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        at = f"{self.path}/{self.n}"
        df.write.parquet(at)
        table = self.spark.read.schema(df.schema).parquet(at)
        self._tables[id(table)] = (table, at)
        return table

    def _delete(self, at: str) -> None:
        path = self._hadoop(at)
        path.getFileSystem(self._conf).delete(path, True)

    def free(self, *tables: DataFrame) -> None:
        """Delete tables of this stage that nothing will read again."""
        for table in tables:
            if found := self._tables.pop(id(table), None):
                self._delete(found[1])

    def keep(self, *tables: DataFrame) -> None:
        """Delete all tables of this stage but these."""
        for at in [at for key, (_, at) in self._tables.items() if key not in {id(t) for t in tables}]:
            self._delete(at)
        self._tables = {id(t): self._tables[id(t)] for t in tables}

    def remove(self) -> None:
        """Delete all tables, once nothing reads them any more."""
        Stage._open.pop(self.path, None)
        self._delete(self.path)


@atexit.register
def _remove_all() -> None:
    for stage in list(Stage._open.values()):
        try:
            stage.remove()
        except (Py4JError, Py4JNetworkError, OSError):
            return  # the session's process is gone


def with_ids(df: DataFrame, ids: DataFrame, how: str, n_ids: int | None = None) -> DataFrame:
    """``df`` semi- or anti-joined on doc_id with a table of ids: by broadcast when its counted rows are few, else by shuffle."""
    n = ids.count() if n_ids is None else n_ids
    return df.join(F.broadcast(ids) if n <= BROADCAST_ROWS else ids.hint("merge"), "doc_id", how)
