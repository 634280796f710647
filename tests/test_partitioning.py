"""Results do not depend on the number of shuffle partitions."""

import os

import pytest

import __spark_entry__ as E

SMOKE = "/root/testdata/sf0.001"
NAMES = ["byte_budget_split", "pack_segments", "norm_ppl", "greedy_pieces", "report_ranked"]


@pytest.mark.skipif(not os.path.isdir(SMOKE), reason="test data not present")
def test_independent_of_shuffle_partitions(spark):
    qs = E.queries()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    results = {}
    try:
        for parts in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            results[parts] = {n: sorted(map(tuple, qs[n](spark, SMOKE).collect())) for n in NAMES}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    for n in NAMES:
        assert results["1"][n] == results["7"][n], n
