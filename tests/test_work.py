"""Tables that loops write between their rounds."""

from pathlib import Path

from pyspark.sql import functions as F

from kerf.plans.work import CLEANUP, written


def test_shuffle_files_go_with_their_write(spark):
    """F3, F8, F9, F10, F12: what a write shuffled is off the disk when it ends, not some time later; settings stay."""
    files = lambda: {p for p in Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*.data")}
    before, was = files(), spark.conf.get(CLEANUP)
    out = written(spark.range(200_000).groupBy((F.col("id") % 50_000).alias("k")).agg(F.sum("id").alias("s")))
    assert files() <= before and spark.conf.get(CLEANUP) == was
    assert out.count() == 50_000
    assert any(".zstd." in p.name for p in Path(out.written_to.removeprefix("file:")).rglob("part-*"))
