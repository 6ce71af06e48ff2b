"""What a session needs before the operators run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Give the package to the workers where they don't find it on their path.

    The archive is made on the driver, and Spark's file server hands it out.
    """
    on_path = any(Path(p).resolve() == ROOT.parent for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p)
    context = spark.sparkContext
    if on_path or getattr(context, "_pageframe_shipped", False):
        return
    archive = Path(tempfile.mkdtemp()) / "pageframe.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, p.relative_to(ROOT.parent))
    context.addPyFile(str(archive))
    context._pageframe_shipped = True


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint.

    The folder is the cluster's shared one (``spark.checkpoint.dir``). Only on
    one machine, as in tests, a folder of the warehouse stands in where that is
    unset; on a cluster its absence is an error, as a machine's own folder would
    be lost with the machine. Spark removes the files when the table is no
    longer used where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(shared or spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints")
    return df.checkpoint()
