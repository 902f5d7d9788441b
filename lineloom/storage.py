"""Written tables in the folder that driver and executors share.

A table written here cuts lineage: what reads it survives the loss of executors, and joins see a plain
scan whose exchange adaptive execution may split when one key is hot.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []
#: Names in the session's catalog of the bucketed tables among them, by path.
_NAMES: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset: on one machine a temporary folder, on a cluster one in the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        alone = spark.sparkContext.master.split("[")[0] == "local"
        root = "file://" + tempfile.mkdtemp(prefix="lineloom-shared-") if alone else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_lineloom"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, deleted when the driver's Python ends or by release()."""
    path = f"{shared_root(spark)}/lineloom/{label}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(release)
    _WRITTEN.append((spark, path))
    return path


def materialize(df: DataFrame, label: str, *, zstd: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd" if zstd else "snappy").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame) -> DataFrame:
    """A table in the shared folder, which cuts the lineage of a loop."""
    return materialize(df, "loop")


def bucketed(df: DataFrame, keys: tuple[str, ...], label: str) -> DataFrame:
    """A table in the shared folder with a bucket for each of the session's shuffle partitions: a join by the keys moves its other side alone.

    Rows move once, to be written, however many joins follow. Rows with one key stay in one bucket, in as many files as tasks wrote them.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = fresh_path(spark, label)
    name = _NAMES[path] = f"lineloom_{uuid.uuid4().hex}"
    df.repartition(n, *keys).write.format("parquet").bucketBy(n, *keys).option("path", path).saveAsTable(name)
    return spark.table(name)


def materialize_alone(make: Callable[[], DataFrame], label: str, *, zstd: bool = False) -> DataFrame:
    """materialize(make(), label), and then delete the tables that this wrote on its way."""
    before = len(_WRITTEN)
    out = materialize(make(), label, zstd=zstd)
    done, _WRITTEN[before:] = _WRITTEN[before:-1], _WRITTEN[-1:]
    for spark, path in done:
        drop(spark, path)
    return out


def drop(spark: SparkSession, path: str) -> None:
    """Delete one path of the shared folder, if the session still lives."""
    with contextlib.suppress(Exception):  # the session may be gone at interpreter exit
        if name := _NAMES.pop(path, None):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release() -> None:
    """Delete every table that fresh_path() named; what reads them can't be computed any more."""
    while _WRITTEN:
        drop(*_WRITTEN.pop())
