"""Session helpers: sane defaults for the reports and the shared checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings the reports rely on. They are only applied when a session is built
# here; a session handed in by a cluster keeps its own configuration.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Suggested settings for large clusters (100 TB class). Not applied by default:
# the cluster's own configuration wins; pass ``extra=SCALE_CONF`` to use them.
SCALE_CONF = {
    # Enough shuffle partitions for the widest stage; AQE coalesces the rest
    # to the advisory size, so small reports do not pay for them.
    "spark.sql.shuffle.partitions": "4000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    # Split a partition that holds a hot key (a third of the rows) at run time.
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    # Dimensions up to this size are broadcast; larger ones are shuffled.
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    # Scan splits sized for executor memory.
    "spark.sql.files.maxPartitionBytes": "256m",
    # Runtime filters from the dimension side into fact scans.
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "distkpi", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the defaults above."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set by the deployment (a path every executor can
    reach). Only when it is unset, as in local tests, a scratch folder is
    created and registered.
    """
    sc = spark.sparkContext
    path = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder every executor "
                               "can reach (a machine-local folder does not survive on a cluster)")
        path = tempfile.mkdtemp(prefix="distkpi-ckpt-")
        sc.setCheckpointDir(path)
        path = sc.getCheckpointDir() or path
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the checkpoint folder for materialised tables."""
    return os.path.join(checkpoint_dir(spark), name)
