"""The views' joins: tables dealt by their bytes, with the same rows."""

import os

import pytest

from kerf.sources.views import size_of, view

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.mark.parametrize("name", ["boq", "elements", "quotes"])
def test_parts_go_with_bytes(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    plain = view(spark, SF, name)
    want = sorted(map(repr, plain.collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        dealt = view(spark, SF, name, 2_000)
        assert sorted(map(repr, dealt.collect())) == want
        # A task has no more than its share of the files, however few the shuffle partitions are.
        size = sum(size_of(spark, f"{SF}/{t}.parquet") for t in {"boq": ["lineitem", "orders"], "elements": ["lineitem", "part", "orders"], "quotes": ["lineitem", "supplier"]}[name])
        assert dealt.rdd.getNumPartitions() == -(-size // 2_000) > 4
        assert view(spark, SF, name).rdd.getNumPartitions() <= 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
