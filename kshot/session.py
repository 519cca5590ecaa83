"""Session helpers: a local session for tests/bench and the shared folder for lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8, app: str = "kshot") -> SparkSession:
    """Local session for tests and the bench; cluster jobs pass their own session instead."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir`` (a path or URI, kept as given).

    Only a local master may run without one (tests, bench): a folder is then made once per session.
    On a cluster a machine-local folder would be invisible to the executors, so that raises.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="kshot-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def shared_dir(spark: SparkSession, name: str = "") -> str:
    """A fresh folder name under the shared folder, as a URI that any Spark reader or writer takes."""
    leaf = f"{name}-{uuid.uuid4().hex}" if name else uuid.uuid4().hex
    return f"{shared_root(spark)}/kshot/{leaf}"


def on_posix(spark: SparkSession) -> bool:
    """Whether the shared folder is on a mount that plain file IO reaches."""
    hpath = spark._jvm.org.apache.hadoop.fs.Path(shared_root(spark))
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getScheme() == "file"


def local_path(path: str) -> str:
    """The POSIX path behind a ``file:`` URI, for plain file IO on a shared mount."""
    return re.sub("^file:/*", "/", path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet under the shared folder and read it back (cuts lineage, survives
    executor loss, later uses read the written columns only)."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint dir (survives executor loss)."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)
