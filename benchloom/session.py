"""Session-level helpers shared by every operator.

Nothing here assumes a local machine: lineage is cut only in the folder the
session names in ``spark.checkpoint.dir``; a private folder is chosen only for a
``local[...]`` master that names none (tests, notebooks).
"""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a dimension counted at run time may be broadcast.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; Catalyst prunes its columns and pushes its filters down."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a context; they need not have it installed."""
    sc = spark.sparkContext
    if not getattr(sc, "_benchloom_shipped", False):
        package = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="benchloom-")
        sc.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name))
        sc._benchloom_shipped = True


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings the operators rely on, set on whatever session is given."""
    ship(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session, set on its context."""
    sc = spark.sparkContext
    conf = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if not conf:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        conf = tempfile.mkdtemp(prefix="benchloom-checkpoint-")
    sc.setCheckpointDir(conf)
    return conf


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Materialise ``df`` in the shared folder; it survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def join_dimension(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join a dimension, broadcasting it only when its counted size is within ``max_rows``.

    Beyond that the join shuffles both sides and adaptive execution splits skewed keys.
    """
    n = small.limit(max_rows + 1).count()
    return big.join(F.broadcast(small) if n <= max_rows else small, on, how)


def squash(name: Column) -> Column:
    """Names compared without case, blanks, hyphens and underscores."""
    return F.regexp_replace(F.lower(F.trim(name)), r"[\s_-]+", "")
