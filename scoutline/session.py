"""Session helpers: a tuned local session for tests/bench and the shared
checkpoint folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings a cluster job wants regardless of size: AQE re-plans joins and
# coalesces shuffle partitions at runtime, skew-join splits hot partitions,
# and the Arrow path keeps Python stages batched.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "scoutline", extra_conf: dict | None = None) -> SparkSession:
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", "16g"))
    for k, v in {**DEFAULT_CONF, **(extra_conf or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster the setting must point at shared storage and is read as is.
    Only when it is unset (tests, local runs) do we create a folder of our own.
    """
    sc = _context(spark)
    if sc is None:                       # Spark Connect: the server owns the setting
        d = spark.conf.get("spark.checkpoint.dir", None)
        if not d:
            raise ValueError("set spark.checkpoint.dir to a shared folder on the Spark Connect server")
        return d
    d = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder (HDFS/S3/...) "
                             "before running jobs that cut lineage")
        d = tempfile.mkdtemp(prefix="scoutline-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d.removeprefix("file:")


def _context(spark: SparkSession):
    """The SparkContext, or None under Spark Connect."""
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001  (Connect sessions have no context)
        return None


def default_parallelism(spark: SparkSession) -> int:
    sc = _context(spark)
    if sc is not None:
        return sc.defaultParallelism
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def cut_lineage(df):
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    The table survives lost executors, is computed once (an RDD checkpoint computes
    its plan for the count and again for the write), and its readers prune columns.
    :func:`release` deletes all tables of the application."""
    spark = df.sparkSession
    path = f"{_stored_root(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df):
    """The rows of a scan over as many tasks as run at once: a small file is few tasks, however much is done with its rows."""
    n = default_parallelism(df.sparkSession)
    if _context(df.sparkSession) is not None and df.rdd.getNumPartitions() >= n:
        return df
    return df.repartition(n)


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder, with its scheme; :func:`release` deletes it too."""
    return f"{_stored_root(spark)}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Delete the tables that :func:`cut_lineage` stored.  Call it once the results
    that read them are written."""
    sc = _context(spark)
    if sc is None:
        raise ValueError("Spark Connect: delete the folders below spark.checkpoint.dir on the server")
    path = sc._jvm.org.apache.hadoop.fs.Path(_stored_root(spark))
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def _stored_root(spark: SparkSession) -> str:
    sc = _context(spark)
    # checkpoint_dir drops file:, without which a cluster may take another default file system.
    folder = (sc.getConf().get("spark.checkpoint.dir") if sc is not None else None) or checkpoint_dir(spark)
    return f"{folder.rstrip('/')}/scoutline-{sc.applicationId if sc is not None else 'connect'}"


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``scoutline`` importable in Python workers (executors) by adding
    a zip of the package to the context once.  Operators that run Python in
    tasks call this when they build their plan."""
    import zipfile

    sc = _context(spark)
    key = sc.applicationId if sc is not None else id(spark)
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="scoutline-pkg-"), "scoutline.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    if sc is not None:
        sc.addPyFile(out)
    else:
        spark.addArtifacts(out, pyfile=True)
    _SHIPPED.add(key)
