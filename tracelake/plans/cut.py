"""Lineage cuts for iterative plans.

Iterations write their state as a table in the shared checkpoint folder, so that
a lost executor costs a re-read and not a replay of all earlier rounds. A table
read back also starts with fresh size estimates, which a checkpointed plan keeps
multiplying with every self join.

Tables that a later round replaces are deleted at once, those inside ``scratch`` when
it is left, all others when the application ends.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_OPEN: list[list[DataFrame]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local session without one takes a folder of this machine; on a
    cluster each executor would write to its own disk."""
    sc = spark.sparkContext
    directory = sc._jsc.sc().getCheckpointDir()
    if not directory.isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):  # local-cluster runs on this machine too
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="tracelake-")
        sc.setCheckpointDir(folder)
        directory = sc._jsc.sc().getCheckpointDir()
    return directory.get()


def _file(spark: SparkSession, path: str):
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return file, file.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def cut(df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    ``replaces``: an earlier result of ``cut`` that nothing reads any more; its
    table is deleted once the new one is complete.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    file, system = _file(spark, path)
    system.deleteOnExit(file)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    if _OPEN:
        _OPEN[-1].append(out)
    if replaces is not None:
        drop(replaces)
    return out


def cut_counting(df: DataFrame, condition: Column, replaces: DataFrame | None = None) -> tuple[DataFrame, int]:
    """``cut`` and the number of rows that fulfil ``condition``, taken while they are written.

    The number is exact unless an executor was lost during the write; then it may be too great, never too small.
    """
    seen = Observation()
    out = cut(df.observe(seen, F.count_if(condition).alias("n")), replaces)
    return out, seen.get["n"]


def drop(df: DataFrame) -> None:
    """Delete the table behind a result of ``cut``."""
    file, system = _file(df.sparkSession, df._cut_path)
    system.delete(file, True)


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes the tables cut inside it when it is left; what reads them must be done by then."""
    _OPEN.append([])
    try:
        yield
    finally:
        for table in _OPEN.pop():
            drop(table)
