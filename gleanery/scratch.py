"""Intermediate tables in the folder that all executors share.

Cutting lineage by a written table keeps a job alive when an executor is lost:
the table is read again from the shared folder, unlike a local checkpoint.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """This session's own folder below ``spark.checkpoint.dir``.

    Where that setting is absent, a local master gets a temporary folder; on a
    cluster this is an error, because no other machine could read it.
    """
    context = spark.sparkContext
    app = context.applicationId
    if app not in _roots:
        root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
        if not root:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="gleanery-")
        _roots[app] = f"{root.rstrip('/')}/gleanery-{app}"
        atexit.register(clear, spark)
    return _roots[app]


def clear(spark: SparkSession) -> None:
    """Delete what this session has written to the shared folder; also called at exit."""
    try:
        root = _roots.pop(spark.sparkContext.applicationId, None)
        if root:
            path = spark._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the JVM may be gone already
        pass


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The frame in as many partitions as the session's shuffles have, however small it is: for stages whose rows are few but dear.

    Adaptive execution puts small partitions together by their bytes; a number
    that is named it leaves alone.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a frame once and go on from the written table."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
