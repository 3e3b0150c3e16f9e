"""Session helpers: a tuned local session for tests/bench, and the shared
checkpoint folder every lineage cut and scratch write goes to."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",  # with the frame that they were made for
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "quarry", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session. On a cluster pass master=None and let the
    launcher decide; locally this gives a single-JVM session."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(_DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and scratch tables.

    Read from ``spark.checkpoint.dir`` (set by the cluster). Where it is unset
    a local session gets a temporary one; on a cluster that would be a folder
    that executors can't see, so there it is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
    if not d and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not d:
        d = tempfile.mkdtemp(prefix="quarry-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    try:
        current = spark.sparkContext.getCheckpointDir()
    except Exception:  # pragma: no cover - older pyspark
        current = None
    if not current:
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def forget_at_exit(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder when the session's process ends."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)


def scratch_table(df, name: str):
    """Write ``df`` to the shared folder and read it back: cuts the lineage in
    one pass, survives lost executors, and serves several readers."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    forget_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(df) -> None:
    """Remove the files of a table of :func:`scratch_table` that nobody reads any more."""
    spark = df.sparkSession
    for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(parent)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cut_lineage(df):
    """Reliable lineage cut (written to the shared checkpoint folder, so it
    survives executor loss). Never a local checkpoint."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship_package(spark: SparkSession) -> None:
    """Make ``quarry`` importable in the Python workers (executors), once per
    SparkContext: the package is zipped into the shared checkpoint folder and
    added with ``addPyFile`` — the same as ``--py-files`` on a cluster."""
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_quarry_shipped", False):
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    path = scratch_path(spark, "quarry-pkg") + ".zip"
    local = path[len("file:"):] if path.startswith("file:") else path
    if "://" in local:  # a remote shared folder: build locally, let Spark copy it
        local = os.path.join(tempfile.mkdtemp(prefix="quarry-pkg-"), "quarry.zip")
    os.makedirs(os.path.dirname(local), exist_ok=True)
    with zipfile.ZipFile(local, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg):
            if "__pycache__" in root:
                continue
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.join("quarry", os.path.relpath(full, pkg)))
    sc.addPyFile(local)
    sc._quarry_shipped = True
