"""Driver contract: entry() runs on sf0.001; every query has a consistent oracle key."""

import os

import pytest

import __spark_entry__ as E
from transvoc import catalog

SMOKE = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMOKE), reason="test data not present")
def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) >= 0
    assert set(df.columns) >= {"vocab_lang", "lang", "norm_ppl"}


def test_oracles_match_queries():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    own = set(catalog.QUERIES)
    assert own - set(o) == set()
