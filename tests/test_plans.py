"""Plan invariants of every registered query (plans only, nothing executed)."""

import contextlib
import io
import re

import pytest

from ledgerline.plans.catalog import spark_queries

from conftest import SF_SMALL


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(spark_queries()))
def test_no_nested_loop_and_pruned_scans(spark, name):
    text = _plan(spark_queries()[name](spark, SF_SMALL))
    assert not re.search(r"BroadcastNestedLoopJoin|CartesianProduct", text)
    # lineitem has 11 columns; every query reads a pruned subset of it.
    for cols in re.findall(r"FileScan parquet \[([^\]]*)\][^\n]*lineitem\.parquet", text):
        assert len(cols.split(",")) < 11, cols
