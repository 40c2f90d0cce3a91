"""SparkSession helpers shared by tests, bench and the driver entry points."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings every job assumes.

    * UTC session time zone: event time is compared as UTC microseconds.
    * AQE on: runtime join strategy (broadcast of small resolved tables),
      partition coalescing and skew-join splitting.
    * UI off: no web server is started.
    """
    master = master or os.environ.get("TOLLGATE_MASTER", "local[8]")
    builder = (
        SparkSession.builder.master(master)
        .appName("tollgate")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Lineage cuts write to the shared checkpoint folder; let Spark delete
        # those files once the DataFrames that own them are gone.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("TOLLGATE_DRIVER_MEMORY", "16g"))
    )
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared (HDFS/S3) folder and
    is used as is.  Only when it is unset (local tests) a scratch folder is
    created and registered.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(conf_dir)
        return conf_dir
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local_dir = tempfile.mkdtemp(prefix="tollgate-ckpt-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", local_dir)
    spark.sparkContext.setCheckpointDir(local_dir)
    return local_dir


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tollgate`` importable in the executors' Python workers (the
    Arrow UDFs run there): zip the package on the driver once per
    application and hand it to ``addPyFile``, which distributes it."""
    import io
    import os
    import zipfile

    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _dirs, files in os.walk(pkg):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(root, name)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    folder = tempfile.mkdtemp(prefix="tollgate-code-")
    path = os.path.join(folder, "tollgate.zip")
    with open(path, "wb") as fh:
        fh.write(buf.getvalue())
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
