"""Session settings that every plan here assumes."""

from __future__ import annotations

import hashlib
import os
import tempfile
from functools import lru_cache
from pathlib import Path

from pyspark.sql import SparkSession

#: Adaptive execution picks partition counts, splits skewed joins and turns
#: joins into broadcasts when a side is measured to be small.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
}


def session(master: str | None = None, app: str = "lakemill", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | conf)
    return (builder.master(master) if master else builder).getOrCreate()


def reach_workers(spark: SparkSession) -> None:
    """Python workers import this package from the folder that the driver has
    it from, whatever their working folder is. Executors that do not see that
    folder get the package as any other, by --py-files."""
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


@lru_cache(maxsize=1)
def _one_machine() -> str:
    return f"file://{tempfile.mkdtemp(prefix='lakemill-')}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where
    that setting is absent, one machine's own folder serves a local master; a
    cluster must name a folder."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _one_machine()


def _at(spark: SparkSession, path: str):  # noqa: ANN202  a file system and a path in it, of the JVM
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def exists(spark: SparkSession, path: str) -> bool:
    system, at = _at(spark, path)
    return system.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    system, at = _at(spark, path)
    system.delete(at, True)


def fingerprint(spark: SparkSession, folder: str) -> str:
    """A hash of the files of a folder: their paths, sizes and times."""
    system, at = _at(spark, folder)
    found, listed = system.listFiles(at, True), []
    while found.hasNext():
        f = found.next()
        listed.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(listed)).encode()).hexdigest()[:16]
