"""Sessions, tables and shared storage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with adaptive execution, Arrow and UTC, for tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("veldspar")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of a data folder."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or, where it is unset, a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="veldspar-"))
        atexit.register(shutil.rmtree, _own[0][len("file://"):], True)
    return _own[0]


_own: list[str] = []


class Workspace:
    """Tables written to the shared folder, so that lost executors cost no recomputation.

    ``cut`` ends a lineage; ``drop`` deletes a table that no later plan reads.  What is left goes when the process ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self._count = 0
        atexit.register(self.close)

    def path(self, name: str) -> str:
        self._count += 1
        return f"{self.root}/{self._count:03d}-{name}"

    def cut(self, df: DataFrame, name: str = "t", count: bool = False) -> DataFrame:
        """Write a table and read it again; with ``count``, its ``rows`` are counted as it is written."""
        path, seen = self.path(name), Observation()
        (df.observe(seen, F.count(F.lit(1)).alias("n")) if count else df).write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.workspace_path = path
        if count:
            out.rows = seen.get["n"]
        return out

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "workspace_path", None)
        if path:
            self._delete(path)

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session may be gone already; a local folder can still be removed
            if self.root.startswith("file:"):
                shutil.rmtree(self.root[len("file:"):].replace("//", "/", 1), ignore_errors=True)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def data_dir(name: str = "sf0.001") -> str:
    return os.path.join(os.environ.get("VELDSPAR_DATA", "/root/testdata"), name)
