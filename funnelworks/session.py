"""Spark session defaults for the library.

Only settings that matter for correctness or for plan quality at scale are
set here; a cluster's own configuration wins for everything else
(``getOrCreate`` returns the existing session unchanged).
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the pipelines rely on.
# - UTC session zone: inputs are timestamp_ntz/date, so results never depend on
#   it, but it keeps any accidental zone conversion deterministic.
# - AQE: runtime re-planning turns small shuffled sides into broadcasts using
#   measured sizes, coalesces tiny partitions and splits skewed join partitions.
RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    # accounts a task combines by hashing (some hundred bytes each) before it sorts
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "100000",
}


def build_session(master: str | None = None, app_name: str = "funnelworks", **conf: str) -> SparkSession:
    """A session with the recommended settings (used by tests and the bench)."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    quiet = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        # remove checkpoint files once their frame is garbage-collected
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for k, v in {**RECOMMENDED_CONF, **quiet, **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    sc = _context(spark)
    if sc is not None:
        sc.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _context(spark: SparkSession):
    """The SparkContext of a classic session; None for a Spark Connect client,
    whose checkpoint folder is the server's own setting."""
    try:
        return spark.sparkContext
    except Exception:  # Spark Connect has no driver-side context
        return None


def ensure_checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder for checkpoints and intermediate tables.

    Uses ``spark.checkpoint.dir`` as the cluster sets it.  Only a local-mode
    session (tests, single-machine runs) may fall back to a fresh local
    folder; on a cluster a node-local folder would not be readable by other
    executors, so a missing setting is an error there.
    """
    sc = _context(spark)
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if sc is None:
        return configured
    configured = sc.getConf().get("spark.checkpoint.dir", None) or configured
    if configured:
        path = configured
    elif sc.master.startswith("local"):
        path = tempfile.mkdtemp(prefix="funnelworks-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder on shared storage")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A per-run folder under the shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark)
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a folder on shared storage")
    sc = _context(spark)
    app = sc.applicationId if sc is not None else "session"
    run = f"{name}-{app}-{uuid.uuid4().hex[:12]}"
    return f"{base.rstrip('/')}/funnelworks/{run}"


#: Folders of ``stored`` that are still to remove: path to session.
_stored: dict[str, SparkSession] = {}


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return a frame that
    reads it: later stages and retries start from the files, and a reader of
    few columns reads only those.  Runs a job.  The folder goes with
    ``discard``, or when the driver's Python process ends."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    remove_at_end(spark, path)
    again = spark.read.schema(df.schema).parquet(path)
    again._stored_at = path
    return again


def remove_at_end(spark: SparkSession, path: str) -> None:
    """Remove the folder when the driver's Python process ends."""
    if not _stored:
        atexit.register(_remove_stored)
    _stored[path] = spark


def discard(df: DataFrame) -> None:
    """Remove a table of ``stored`` that nothing reads any more."""
    remove_path(_stored.pop(df._stored_at), df._stored_at)


def remove_path(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _remove_stored() -> None:
    for path, spark in _stored.items():
        try:
            remove_path(spark, path)
        except Exception:  # the session has already ended; the cluster's cleanup takes it
            return
