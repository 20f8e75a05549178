"""Session construction shared by the benchmark, the tests and ad-hoc use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, app: str = "textmill", **conf: str) -> SparkSession:
    """A local session with the settings a cluster would normally provide.

    ``conf`` keys use ``__`` for ``.``.  ``spark.checkpoint.dir`` is set only here, for
    local runs; on a cluster it must name a folder that all executors share.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TEXTMILL_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.checkpoint.dir", os.environ.get("TEXTMILL_CHECKPOINT_DIR", "/tmp/textmill-checkpoints"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cutting lineage.

    The cluster's ``spark.checkpoint.dir`` wins; a default is set only where it is unset, and
    only for a local master, since executors of a cluster share no machine's folder.
    """
    context = spark.sparkContext
    chosen = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not chosen and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    chosen = chosen or "/tmp/textmill-checkpoints"
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(chosen)
    return chosen
