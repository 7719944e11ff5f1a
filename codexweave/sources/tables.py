"""Table readers and intermediate tables that outlive the loss of an executor."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data directory; Catalyst prunes its columns."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over as many partitions as there are cores, where a small input came in fewer.

    A file of one row group is one task, whatever is done to its rows; larger inputs have
    partitions enough and are left as they are.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the session has none and runs on one machine (tests) a fresh local folder is
    used; on a cluster without the setting this is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[context.applicationId] = made = tempfile.mkdtemp(prefix="codexweave-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
    return _LOCAL_FOLDERS[context.applicationId]


#: Local folders made for sessions on one machine that name none, by application; removed at exit.
_LOCAL_FOLDERS: dict[str, str] = {}


def remove_intermediate(spark: SparkSession) -> None:
    """Removes the intermediate tables of all sessions from the shared folder; call it when results are written and nothing runs."""
    jvm, root = spark.sparkContext._jvm, f"{shared_folder(spark)}/codexweave"
    path = jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialised(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as a parquet table in the shared folder and read back.

    Cuts the lineage: both the plan and the recomputation after a lost executor start
    at the written files. Written column by column, so readers still prune.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/codexweave/{label}-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def latest_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the greatest by ``order``; nulls in the order sort lowest."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by(F.struct(*[F.col(c) for c in rest]), F.struct(*order))
    out = df.groupBy(*keys).agg(pick.alias("_row"))
    return out.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])
