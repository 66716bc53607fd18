"""Session helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_written: dict[str, list[str]] = {}


def build_session(app: str = "chatloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; cluster settings given from outside win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**base, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor, once per context."""
    context = spark.sparkContext
    if getattr(context, "_chatloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="spark-")) / "chatloom.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, f"chatloom/{path.relative_to(root)}")
    context.addPyFile(str(target))
    context._chatloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: `spark.checkpoint.dir` where the cluster names one.

    Where it is unset and the master is local, a temporary folder is used; on a cluster without the
    setting this raises, since a machine-local folder would lose data with its machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark)}/chatloom-{name}-{uuid.uuid4().hex[:12]}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release_scratch(spark: SparkSession) -> int:
    """Delete what this session wrote below the shared folder for intermediate results, and say how many folders; DataFrames read from them end with it."""
    gone = 0
    for path in _written.pop(spark.sparkContext.applicationId, []):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        gone += bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True))
    return gone


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checked_broadcast(df: DataFrame, rows: int, max_rows: int = 200_000) -> DataFrame:
    """Broadcast `df` only if its counted size `rows` is within `max_rows`; beyond it Spark shuffles."""
    return F.broadcast(df) if rows <= max_rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def settled(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """`df` with columns as a generated row: each is computed once, however often later steps and filters use it, since Spark doesn't unfold a
    generator into them as it would unfold a projection."""
    old = [c for c in df.columns if c not in columns]
    return df.select(*old, F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


def set_aside(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """`df` with columns whose names begin with `_` renamed, and the way back: operators keep such names for themselves."""
    back = {f"kept__{i}": c for i, c in enumerate(df.columns) if c.startswith("_")}
    return df.withColumnsRenamed({c: k for k, c in back.items()}), back
