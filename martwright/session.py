"""Session construction and cluster-safe scratch locations.

Every operator in the library is a plain ``DataFrame -> DataFrame`` function;
this module only builds a session with the settings the operators assume
(AQE, skew-join splitting, UTC, no UI) and resolves the shared checkpoint
folder the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# runtime SQL settings the operators assume; applied only where the
# submit configuration (spark-submit --conf, spark-defaults) left them unset
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a partition once it is 4x the median and over 64 MB
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
# static settings fixed when the session starts: no web UI, no progress bar
_STATIC = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "martwright",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build a session with the library's defaults, or return the active one
    untouched (apart from explicit ``extra`` SQL settings / partitions).

    ``master`` is only set when given, so on a cluster the submit-time master
    wins; the runtime defaults above are applied only where the submit
    configuration did not set them; ``extra`` always wins.
    ``shuffle_partitions`` defaults to Spark's own value; on a cluster size
    it to ~2-3x the total cores and let AQE coalesce small ones.
    """
    extra = dict(extra or {})
    existing = SparkSession.getActiveSession()
    if existing is not None:
        # reuse the caller's session as configured; only explicit requests apply
        for k, v in extra.items():
            if k.startswith("spark.sql."):
                existing.conf.set(k, v)
        if shuffle_partitions:
            existing.conf.set("spark.sql.shuffle.partitions", str(shuffle_partitions))
        return existing
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**_STATIC, **extra}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    submitted = spark.sparkContext.getConf()
    for k, v in _DEFAULTS.items():
        if k not in extra and not submitted.contains(k):
            spark.conf.set(k, v)
    if shuffle_partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(shuffle_partitions))
    elif not any(submitted.contains(k) or k in extra for k in (
            "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.initialPartitionNum")):
        # nothing sized at submit time: start shuffles wide (8 per core) and
        # let AQE coalesce them to the advisory size
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum",
                       str(max(200, 8 * spark.sparkContext.defaultParallelism)))
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a scratch one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder (HDFS/S3/...)
    and is used as is.  Only a ``local`` session with nothing configured
    (unit tests) gets a fresh scratch folder; a cluster without the setting is
    an error, as executors could not see each other's files.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or \
        sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not conf_dir:
        conf_dir = tempfile.mkdtemp(prefix="martwright-ckpt-",
                                    dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared folder (never ``localCheckpoint``).

    Used where an iterative driver loop (stepwise selection, cross
    validation) would otherwise grow the plan, and where a result must
    survive the loss of the executors that computed it.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)
