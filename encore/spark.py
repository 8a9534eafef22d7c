"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import os
import shlex
import tempfile

from pyspark.sql import SparkSession

BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.ansi.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app: str = "encore", extra: dict | None = None) -> SparkSession:
    """Session for tests, bench and local runs. On a cluster, the submitter's
    settings win: we only fill in what is unset. `extra` is set in any case."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(BASE_CONF)
    if master and master.startswith("local"):
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
        conf["spark.driver.memory"] = os.environ.get("ENCORE_DRIVER_MEMORY", "8g")
    given = submitted()
    for k, v in {**{k: v for k, v in conf.items() if k not in given}, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def submitted() -> set[str]:
    """Settings that spark-submit or PYSPARK_SUBMIT_ARGS gave this process, or
    that a running session has."""
    from pyspark import SparkContext
    args = shlex.split(os.environ.get("PYSPARK_SUBMIT_ARGS", ""))
    given = {b.split("=", 1)[0] for a, b in zip(args, args[1:]) if a in ("--conf", "-c")}
    given |= {a.removeprefix("--conf=").split("=", 1)[0] for a in args if a.startswith("--conf=")}
    if "--driver-memory" in args:
        given.add("spark.driver.memory")
    if SparkContext._jvm is not None:            # started by spark-submit: its settings are system properties
        given |= {str(k) for k in SparkContext._jvm.System.getProperties().stringPropertyNames() if str(k).startswith("spark.")}
    if SparkContext._active_spark_context is not None:
        given |= {k for k, _ in SparkContext._active_spark_context.getConf().getAll()}
    return given


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (spark.checkpoint.dir).

    Only for a local master that has none (tests) do we create one under the
    temp folder; on a cluster the setting must name shared storage.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            return ""                        # a cluster must name shared storage itself
        d = tempfile.mkdtemp(prefix="encore-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d
