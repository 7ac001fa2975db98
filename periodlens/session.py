"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str | None = None, app: str = "periodlens", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; ``conf`` overrides (dots as ``__``)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the session names none, a folder is made on a local master only; on a cluster a
    machine-local folder would be lost with the machine, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="periodlens-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


INPUT_PARTITIONS = "spark.periodlens.inputPartitions"


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal the rows by ``key`` to as many partitions as the session's setting asks for.

    The setting is for inputs in fewer splits than there are cores, which only their owner knows.
    Unset, the input is read as it is split.
    """
    wanted = df.sparkSession.conf.get(INPUT_PARTITIONS, None)
    return df.repartition(int(wanted), key) if wanted else df


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a result feeds several branches: lineage is cut on storage that outlives any
    executor, and the planner then knows the real size of the table, so whether a join
    broadcasts it is decided by ``spark.sql.autoBroadcastJoinThreshold`` against that size.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """An inner or left join on columns of equal names in which null meets null."""
    named = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    same = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on]
    return left.join(named, same, how).drop(*[f"_r_{c}" for c in on])


def lookup_join(
    big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", nulls: bool = False
) -> DataFrame:
    """Join to a table that is usually small, without assuming that it is. ``nulls``: null meets null.

    The right side is written first, so its size is known when the join is planned: below the
    broadcast threshold the big side is not shuffled at all; above it Spark takes a shuffled
    join, where adaptive execution splits hot keys.
    """
    small = materialise(small, "lookup")
    return null_safe_join(big, small, on, how) if nulls else big.join(small, on, how)
