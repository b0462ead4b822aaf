"""Session helpers: a local session for tests / bench, and lineage cutting.

On a cluster the session comes from the platform; the library never sets
configuration there.  Intermediate tables go to the folder that the session
names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(cpus: int | str = "*", app: str = "exposcope",
              shuffle_partitions: int = 8, driver_memory: str = "8g",
              extra: dict | None = None) -> SparkSession:
    """Local session with the settings we test and bench with."""
    b = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", driver_memory))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)  # local runs get a fresh folder when none is named
    return spark


_OWN_DIRS: list[str] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    It is read from the session.  Only where it is unset and all of Spark runs
    on this machine (a ``local`` master: tests, bench) a folder is made for the
    session and removed when Python exits; on a cluster an unset folder is an
    error, as tables there must be readable by every executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="exposcope-ckpt-")
        _OWN_DIRS.append(named)
        spark.conf.set("spark.checkpoint.dir", named)
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


@atexit.register
def _remove_own_dirs() -> None:
    for d in _OWN_DIRS:
        shutil.rmtree(d, ignore_errors=True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared checkpoint folder and
    read it back: later actions start from files that survive executor loss,
    and the plan above is computed exactly once (a plain RDD checkpoint would
    compute it twice and store Java-serialised rows).  The tables belong to the
    application; ``remove_tables`` deletes them when it is done with them.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/t-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_tables(spark: SparkSession) -> None:
    """Delete what ``cut_lineage`` wrote in this application; frames that still
    read such a table can't be used afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark).rstrip('/')}/tables")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``exposcope`` importable in Python workers (like ``--py-files``).

    Operators that run Python on executors (the isolation forest) call this;
    it zips the package once per application and hands it to ``addPyFile``,
    which distributes it to every executor.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    import exposcope
    pkg = os.path.dirname(os.path.abspath(exposcope.__file__))
    root = os.path.dirname(pkg)
    fd, path = tempfile.mkstemp(prefix="exposcope-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(app)
