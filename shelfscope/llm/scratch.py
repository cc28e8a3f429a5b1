"""Written tables that cut lineage, in the folder all executors share.

``spark.checkpoint.dir`` names that folder.  A session on one machine (unit tests, local runs) that
has none gets a temporary folder; on a cluster its absence is an error, as executors would not see
each other's files.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def base_dir(spark: SparkSession) -> str:
    """The shared scratch folder of the session."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="llm-scratch-")
    return _LOCAL[app]


def _filesystem(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the scratch folder and read it back.

    The files outlive executors, so a later stage that loses one rereads them instead of
    recomputing everything above.  They go when the application ends.
    """
    spark = df.sparkSession
    path = f"{base_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jpath, fs = _filesystem(spark, path)
    fs.deleteOnExit(jpath)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table from materialise() that nothing will read again."""
    path = getattr(df, "_scratch_path", None)
    if path:
        jpath, fs = _filesystem(df.sparkSession, path)
        fs.delete(jpath, True)
