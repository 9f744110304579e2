"""Session helpers shared by operators: table access and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a search's result up to which its keys are broadcast to the rows they pick.
MOST_PICKED = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the given tables by a path that any Spark file system may serve."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan whose rows are dealt over all cores if it has tasks for half of them at most, as with one large row group; else as it is.

    Splits are bounded, so what is shuffled is small for the cluster; tables of many files never are.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if 2 * scan.rdd.getNumPartitions() > cores else scan.repartition(cores)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in ``spark.checkpoint.dir``.

    Where that setting is missing a temporary folder is chosen if the master is local (tests); on a cluster that is
    an error, since executors could not see each other's files.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="groundspark-ckpt-"))


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own for a table, beside the checkpoints."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder on any file system that Spark writes to."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    Unlike a local checkpoint the files outlive any executor.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet beside the checkpoints and read from there: smaller than a checkpoint, and read by column."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def picked(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` is in ``found``, which is materialised; ``rows`` are shuffled only if very many are sought."""
    keys = found.select(key).distinct()
    return rows.join(F.broadcast(keys) if found.count() <= MOST_PICKED else keys, key, "left_semi")
