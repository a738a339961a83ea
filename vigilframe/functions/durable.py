"""Intermediates that outlive executors: reliable checkpoints in the folder that the session names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Parts of checkpoint folders that go when the driver ends.
_GOING: set[str] = set()


def checkpoint_folder(spark: SparkSession, fallback: str | None = None) -> str:
    """The session's checkpoint folder, set here only where it has none.

    It is the one that `spark.checkpoint.dir` names. Without the setting it is `fallback` or, in local
    mode only, one below the warehouse: on a cluster a folder of the driver is no folder of the others.
    The session's own part of it goes when the driver ends.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or fallback
        if not named and not sc.master.startswith("local"):
            raise ValueError("name a folder that all machines share in spark.checkpoint.dir")
        sc.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    folder = sc.getCheckpointDir()
    if folder not in _GOING:  # Spark gives each session a part of its own in the folder that is named
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
        _GOING.add(folder)
    return folder


def durable(df: DataFrame, fallback: str | None = None) -> DataFrame:
    """Cut the lineage with a reliable checkpoint."""
    checkpoint_folder(df.sparkSession, fallback)
    return df.checkpoint(eager=True)
