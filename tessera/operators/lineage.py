"""Cutting the lineage of tables that are read several times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def keep_dir(df: DataFrame) -> None:
    """Set the shared folder of spark.checkpoint.dir; a local one only where none is configured and the master is local."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tessera-"))


def keep(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in the shared folder.

    Plans that nest cached tables grow with every level; checkpointed ones do not, and they survive lost executors.
    """
    keep_dir(df)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, for loops that replace a table each round: it is computed once and can be ``dropped``."""
    keep_dir(df)
    spark = df.sparkSession
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(table: DataFrame | None) -> None:
    """Delete a table of ``stored`` that nothing reads any more."""
    path = getattr(table, "_stored_at", None)
    if path:
        sc = table.sparkSession.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
