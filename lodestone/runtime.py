"""Where intermediate results go, and columns of any name."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which every executor sees. Where it is unset, a temporary one, in local mode only."""
    sc = spark.sparkContext
    if named := sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None):
        folder = named
    elif set_before := sc.getCheckpointDir():
        return set_before
    elif sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        folder = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def run_path(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/lodestone/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in any file system of Spark's, if it is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Compute df once and cut its lineage, in the shared folder, so that it outlives any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have, whatever the case."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        new = f"__{name}"
        while new.lower() in have:
            new = f"_{new}"
        have.add(new.lower())
        out.append(new)
    return out


def col(name: str) -> Column:
    """The top-level column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


#: A side of a join is broadcast only when its counted rows, times the bytes a row takes, stay below this.
BROADCAST_BYTES = 32 << 20


def join_small(df: DataFrame, side: DataFrame, on, how: str, row_bytes: int = 64) -> DataFrame:
    """Join with a materialised side. It is broadcast when counted to be small; beyond that Spark shuffles both sides by key."""
    small = side.count() * row_bytes <= BROADCAST_BYTES
    return df.join(F.broadcast(side) if small else side, on, how)


def spread(scan: DataFrame) -> DataFrame:
    """A scan of files, dealt to all cores if it has fewer tasks than there are. A large table has more, and is left as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
