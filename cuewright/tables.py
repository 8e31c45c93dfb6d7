"""Tables that cut lineage: written to the folder that driver and executors share, and read back."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_scratch: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is named: a local one if all run in one process, else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="cuewright-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: short lineage that survives lost executors.

    The files go when ``release`` or ``release_others`` says so, at the latest when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cuewright/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    key = spark.sparkContext.applicationId
    if key not in _scratch:
        _scratch[key] = []
        atexit.register(_sweep, spark, key)
    _scratch[key].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def release(df: DataFrame) -> None:
    """Delete a settled table that nothing will read again."""
    spark, path = df.sparkSession, df._settled_at
    _scratch[spark.sparkContext.applicationId].remove(path)
    _delete(spark, path)


def settled_now(spark: SparkSession) -> set[str]:
    """Marks what is settled, for ``release_others``."""
    return set(_scratch.get(spark.sparkContext.applicationId, []))


def release_others(keep: DataFrame, but: set[str]) -> None:
    """Delete what was settled since ``but`` was marked, and is not ``keep``."""
    spark = keep.sparkSession
    left = _scratch[spark.sparkContext.applicationId]
    for path in set(left) - but - {keep._settled_at}:
        left.remove(path)
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _sweep(spark: SparkSession, key: str) -> None:
    for path in _scratch.pop(key, []):
        try:
            _delete(spark, path)
        except Exception:  # the context may be down already  # noqa: BLE001, S110
            pass
