"""Where loops write their rounds."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame


#: Spark then drops a query's shuffle files when the query ends, in place of some time after a collection.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, spent: Iterable[DataFrame] = ()) -> DataFrame:
    """df as a table in the folder of spark.checkpoint.dir, which all executors share (a local one only if that is
    unset and all runs on one machine). The shuffle files of the write go when it ends. Tables of earlier calls named in
    spent are deleted when it is written; no plan that is still to run may refer to them."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    if not root:
        root = os.environ["KERF_LOCAL_WORK"] = os.environ.get("KERF_LOCAL_WORK") or tempfile.mkdtemp(prefix="kerf-")
    path = f"{root.rstrip('/')}/kerf-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    for old in spent:
        where = spark._jvm.org.apache.hadoop.fs.Path(old.written_to)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out
