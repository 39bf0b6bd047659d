"""Helpers that the corpus operators share: tables, checkpoints, bucket counts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables in ``sf_dir``, by Spark's reader alone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none (tests on one machine) a folder under the
    warehouse directory is set, once.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write once to the shared folder, so a lost executor costs a reread only."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Paths made by :func:`work_dir`, for :func:`release`.
_made: list[str] = []


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def release(spark: SparkSession, since: int = 0, but: str | None = None) -> None:
    """Delete the working tables made since the ``since``-th, except one; for when nothing reads them any more."""
    jvm = spark.sparkContext._jvm
    for path in [p for p in _made[since:] if p != but]:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        _made.remove(path)


def made() -> int:
    """How many working tables there are; see :func:`release`."""
    return len(_made)


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage at a Parquet table in the shared folder: smaller than a checkpoint, and columns are pruned on rereading."""
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def buckets(spark: SparkSession, size: int = 0, most: int = 128 << 20) -> int:
    """Partitions that hashes are dealt to: the session's shuffle partitions, or more where ``size`` bytes would give one over ``most``."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // most))


def text_bytes(texts: DataFrame) -> int:
    """UTF-8 bytes of all texts, by a column aggregate."""
    return texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def free_name(name: str, taken: list[str]) -> str:
    """The name, with underscores after it while a column has it."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def dealt(df: DataFrame, n: int, key: str = "bucket") -> DataFrame:
    """Send row ``key`` = b to partition b, one bucket a partition."""
    return df.repartitionById(n, F.col(key).cast("int"))
