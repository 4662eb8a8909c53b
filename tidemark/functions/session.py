"""Session helpers shared by every operator: durable cut points and fresh column names."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Only where it is unset and all runs on this machine, as in local tests, a temporary one."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if context.applicationId not in _local:
        _local[context.applicationId] = tempfile.mkdtemp(prefix="tidemark-")
    return _local[context.applicationId]


_local: dict[str, str] = {}


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared folder, where it is on Spark's file systems."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(spark))


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage.

    A lost executor costs nothing afterwards: the rows are read back from the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, read again, and its place. A checkpoint also keeps how the rows are dealt out, under
    each name that their keys ever had; in loops of many joins these names multiply, so there tables are used."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


class Workspace:
    """The tables of one call, in a folder of its own within the shared folder. ``with Workspace(spark) as work`` deletes the folder at the end,
    also after a failure; what is to stay is written with ``result``, beside it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self._made = spark, f"{shared_folder(spark)}/work-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        remove(self.spark, self.path)

    def table(self, df: DataFrame) -> DataFrame:
        """``df`` as a table that lasts as long as this workspace, read again."""
        self._made += 1
        return self._write(df, f"{self.path}/{self._made}")

    def result(self, df: DataFrame) -> DataFrame:
        """``df`` as a table of its own, which stays."""
        return self._write(df, f"{shared_folder(self.spark)}/result-{uuid.uuid4().hex}")

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables of this workspace that nothing reads any more."""
        for path in {p.rsplit("/", 1)[0] for t in tables for p in t.inputFiles() if f"{self.path}/" in p}:
            remove(self.spark, path)

    def _write(self, df: DataFrame, path: str) -> DataFrame:
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle and checkpoint files of data that nothing refers to any more. In long loops they would
    stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores added until no column of ``taken`` is called so."""
    lowered = {t.lower() for t in taken}
    while name.lower() in lowered:
        name += "_"
    return name


_shipped: dict[str, str] = {}


def ship_package(spark: SparkSession) -> None:
    """Give executors this package, once for each application: their Python need not have it installed."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    import tidemark

    root = os.path.dirname(os.path.abspath(tidemark.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tidemark-"), "tidemark.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _shipped[application] = path
