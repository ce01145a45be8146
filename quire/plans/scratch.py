"""Intermediate tables in the folder that all executors share.

A long plan is cut by writing it as Parquet below ``spark.checkpoint.dir`` and reading it again: the
files outlive any executor, later reads prune columns, and later plans have no lineage to recompute.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
#: In local mode, the temporary folder of each application.
_local: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; in local mode only, a temporary folder where it is unset."""
    conf = spark.sparkContext.getConf()
    if root := conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    if not conf.get("spark.master", "local").startswith("local") or conf.get("spark.master").startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    name = spark.sparkContext.applicationId
    if name not in _local:
        _local[name] = "file://" + tempfile.mkdtemp(prefix="quire-")
        _made.append((spark, _local[name]))
    return _local[name]


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system it is in."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables of one operator call, each below a folder of its own."""

    def __init__(self, spark: SparkSession, operator: str):
        self.spark, self.base = spark, f"{shared_root(spark)}/quire/{operator}-{uuid.uuid4().hex}"
        self._n = 0
        _made.append((spark, self.base))

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` once and return a DataFrame that reads it back."""
        self._n += 1
        path = f"{self.base}/{self._n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._quire_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        for df in frames:
            delete(self.spark, df._quire_path)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc and not spark.sparkContext._jsc.sc().isStopped():
                delete(spark, path)
        except Exception:  # the JVM may be gone already; the folder is then the cluster's to clean
            return
