"""Session helpers shared by every operator: tables, shared storage, lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One test table, pruned to ``columns`` when any are given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share, as the session names it.

    A cluster sets ``spark.checkpoint.dir``. Only where nothing is set (a local
    test session) a folder of this machine is made and set for the session.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(configured)
        return configured
    existing = sc._jsc.sc().getCheckpointDir()
    if existing.isDefined():
        return existing.get()
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    own = "file://" + os.path.join(tempfile.gettempdir(), f"aroeira-{uuid.uuid4().hex}")
    sc.setCheckpointDir(own)
    return existing.get() if existing.isDefined() else own


def new_folder(spark: SparkSession, kind: str) -> str:
    """A path of its own in the shared folder; what is written there goes when the driver's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    hadoop_path, fs = _file_system(spark, path)
    fs.deleteOnExit(hadoop_path)
    return path


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once, written to the shared folder and read back.

    Cuts the lineage without tying it to executors that may be lost. The files go
    when the driver's JVM ends, or earlier through :func:`release`.
    """
    spark = df.sparkSession
    path = new_folder(spark, "table")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._aroeira_path = path
    if _made:
        _made[-1].append(out)
    return out


_made: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that :func:`durable` writes inside are deleted at the end, but those :func:`kept`."""
    _made.append([])
    try:
        yield
    finally:
        for df in _made.pop():
            release(df)


def kept(df: DataFrame) -> DataFrame:
    """A table of the innermost :func:`scratch` that stays; it then belongs to the scratch around it, if any."""
    if _made and any(x is df for x in _made[-1]):
        _made[-1] = [x for x in _made[-1] if x is not df]
        if len(_made) > 1:
            _made[-2].append(df)
    return df


def release(df: DataFrame) -> None:
    """Deletes the files of a table made by :func:`durable` that nothing reads any more."""
    path = getattr(df, "_aroeira_path", None)
    if path:
        hadoop_path, fs = _file_system(df.sparkSession, path)
        fs.delete(hadoop_path, True)


def _file_system(spark: SparkSession, path: str):
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(jsc.hadoopConfiguration())


def parallelism(spark: SparkSession) -> int:
    """Number of shuffle partitions the session plans with."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship(spark: SparkSession) -> SparkSession:
    """Makes this package importable in Python workers, once per application.

    The package's sources go out through Spark's own file server, as code does.
    """
    sc = spark.sparkContext
    if getattr(sc, "_aroeira_shipped", None) is None:
        here = Path(__file__).parent
        archive = Path(tempfile.mkdtemp(prefix="aroeira-code-")) / f"{here.name}.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(here.rglob("*.py")):
                z.write(p, p.relative_to(here.parent))
        sc.addPyFile(str(archive))
        sc._aroeira_shipped = str(archive)
    return spark
