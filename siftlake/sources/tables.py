"""Written tables in the cluster's shared folder, which last as long as the application."""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; on a local master without one, in the temporary folder; on a cluster that is an error."""
    import tempfile

    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.gettempdir()
    return f"{root.rstrip('/')}/siftlake-tables/{spark.sparkContext.applicationId}"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _folder(spark: SparkSession, name: str, of: str) -> str:
    return f"{shared_folder(spark)}/{name}-{hashlib.sha256(of.encode()).hexdigest()[:16]}"


def made(spark: SparkSession, name: str, of: str) -> bool:
    """Whether `once` has made it whole."""
    return exists(spark, f"{_folder(spark, name, of)}/made")


def once(spark: SparkSession, name: str, of: str, make) -> str:
    """The folder of what is made from `of` (a path); made by make(folder) unless it is there whole. A mark is written last, so that what broke off is made again."""
    root = _folder(spark, name, of)
    if not made(spark, name, of):
        make(root)
        spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{root}/made")
    return root


_opened: dict[str, object] = {}


def opened(spark: SparkSession, name: str, of: str, make, open_):
    """open_(spark, folder) of what `once` makes, opened once in this session's driver."""
    root = once(spark, name, of, make)
    if root not in _opened:
        _opened[root] = open_(spark, root)
    return _opened[root]
