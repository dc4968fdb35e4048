"""Session construction and lineage cutting."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that every entry point shares; a cluster's own settings win over them.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = 8, shuffle_partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("corpusmill")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.driver.memory", memory)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none (tests, local runs) is one made on this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = os.path.join(tempfile.gettempdir(), "corpusmill-shared")
    os.makedirs(made, exist_ok=True)
    return f"file://{made}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from the shared folder (reliable checkpoint)."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder for a table that cuts lineage.

    All such tables of an application are in one folder, which goes when the application ends.
    """
    context = spark.sparkContext
    folder = f"{shared_dir(spark)}/corpusmill-{context.applicationId}"
    if getattr(context, "_corpusmill_scratch", None) != folder:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        system = path.getFileSystem(context._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
        context._corpusmill_scratch = folder
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per application.

    Where ``PYTHONPATH`` names its folder, or local workers start in it, they find it by themselves;
    elsewhere Spark's file server hands out an archive of it.
    """
    context, root = spark.sparkContext, os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    by_path = root in [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    by_folder = context.master.startswith("local[") and os.path.abspath(os.getcwd()) == root
    if by_path or by_folder or getattr(context, "_corpusmill_shipped", False):
        return
    # The driver's own scratch folder: it lives as long as the application, and executors fetch from the driver.
    context.addPyFile(shutil.make_archive(os.path.join(context._temp_dir, "corpusmill-package"), "zip", root, "corpusmill"))
    context._corpusmill_shipped = True
