"""What the training-data operators share: table reading and stage tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lakemill.session import delete, reach_workers, shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of rows that go to a Python worker at once.
BATCH_BYTES = 16 << 20


def in_batches(df: DataFrame, most: int = BATCH_BYTES) -> DataFrame:
    """df, with the session set to hand rows to Python in batches of at most
    `most` bytes: a worker's memory then doesn't depend on how long texts are.
    The setting is read when a plan runs, so it stays in the session."""
    reach_workers(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))
    return df


#: Whether Spark deletes a plan's shuffle files when it has run. They stay else
#: until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Stage tables that nobody has discarded, by DataFrame.
_paths: dict[int, tuple[DataFrame, str]] = {}


def stage(df: DataFrame, label: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back, so
    that later steps neither recompute it nor depend on any one executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{label}-{uuid.uuid4().hex}"
    schema = df.schema
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")  # nothing reads the shuffle files of a plan whose result is written
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(schema).parquet(path)
    _paths[id(out)] = out, path
    return out


def discard(*staged: DataFrame) -> None:
    """Deletes stage tables. Only for tables that no plan still to run reads;
    what was made from them must be a stage table itself."""
    for df in staged:
        _, path = _paths.pop(id(df), (None, None))
        if path:
            delete(df.sparkSession, path)


class Scratch:
    """The stage tables made while it is open, to be deleted together."""

    def __enter__(self) -> Scratch:
        self.before = set(_paths)
        return self

    def __exit__(self, *_: object) -> None:
        pass

    def clear(self, *kept: DataFrame) -> None:
        made = [df for key, (df, _) in list(_paths.items()) if key not in self.before]
        discard(*[df for df in made if not any(df is k for k in kept)])
