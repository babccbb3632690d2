"""Session defaults and the shared scratch folder."""

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

_local_roots: dict[str, str] = {}


def build_session(master: str | None = None, app: str = "gleanery", **conf: str) -> SparkSession:
    """Session with adaptive execution on; on a cluster, ``spark-submit`` sets the rest."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Checkpoints go when nothing refers to them any more.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    A temporary folder is used in local mode only, where driver and executors
    are one process.
    """
    context = spark.sparkContext
    root = spark.conf.get(CHECKPOINT_KEY, None)
    on_cluster = not context.master.startswith("local")
    if root and on_cluster and re.match(r"(file:/*)?/tmp(/|$)", root):
        raise RuntimeError(f"{CHECKPOINT_KEY} is {root}, a folder of one machine")
    option = context._jsc.sc().getCheckpointDir()
    if root:
        if not option.isDefined():
            context.setCheckpointDir(root)
        return root
    if option.isDefined():
        return option.get()
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    app = context.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="gleanery-")
        context.setCheckpointDir(_local_roots[app])
    return _local_roots[app]


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/{purpose}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Removes a scratch path that nothing reads any more."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(location, True)
