"""Finished tables: what several readers need is written once in the shared folder and read from there.

Spark's committers publish the files, so a lost executor costs the tasks that it
was running, never a finished table, and no reader repeats the work behind it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of keys up to so many rows (some tens of bytes each) are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset, a
    local session gets a temporary folder; on a cluster that is an error,
    because each machine would write to a folder of its own.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if base is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="corvane-"))
        base = sc.getCheckpointDir()
    return base


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/corvane-{label}-{uuid.uuid4().hex}"
    fs, target = _fs(spark, path)
    fs.mkdirs(target.getParent())
    _SCRATCH.append(path)
    return path


_SCRATCH: list[str] = []


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it again."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    delete_at_end(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._corvane_path = path
    return out


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Have a folder that exists deleted when the driver ends."""
    fs, target = _fs(spark, path)
    fs.deleteOnExit(target)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote, once nothing reads them any more."""
    for df in tables:
        path = getattr(df, "_corvane_path", None)
        if path is not None:
            fs, target = _fs(df.sparkSession, path)
            fs.delete(target, True)
            if path in _SCRATCH:
                _SCRATCH.remove(path)


class Scratch:
    """Deletes, at its end, every table written since its start, but for those given to ``keep``.

    >>> with Scratch() as s:
    ...     out = s.keep(materialise(job(docs), "out"))
    """

    def __enter__(self) -> Scratch:
        self.before, self.kept = set(_SCRATCH), set()
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.add(df._corvane_path)
        return df

    def __exit__(self, *error: object) -> None:
        for path in [p for p in _SCRATCH if p not in self.before and p not in self.kept]:
            fs, target = _fs(SparkSession.getActiveSession(), path)
            fs.delete(target, True)
            _SCRATCH.remove(path)


def small_or_shuffled(keys: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``keys`` (a finished table of narrow rows) marked for broadcast if its row count, checked here, is within the bound."""
    return F.broadcast(keys) if keys.count() <= rows else keys.hint("merge")


def unused(name: str, *taken: DataFrame) -> str:
    """``name``, with underscores added until no table has a column of that name (in any case)."""
    names = {c.lower() for df in taken for c in df.columns}
    while name.lower() in names:
        name += "_"
    return name
