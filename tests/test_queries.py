"""Registered queries against their SQL on the smallest tables. TIDEMARK_ALL_QUERIES=1 runs them all."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import check_oracle  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

SF = "/root/testdata/sf0.001"
SOME = (
    "canonical_frame", "asof_author_state", "caption_features", "author_history_closed", "token_momentum",
    "segment_metrics", "decision_bands", "keep_delete", "group_kfold", "growth_grid", "mature_label",
)
NAMES = tuple(entry.oracle_sql()) if os.environ.get("TIDEMARK_ALL_QUERIES") else SOME


@pytest.fixture(scope="module")
def duck():
    if not Path(SF).exists():
        pytest.skip("no test tables")
    return check_oracle.connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert check_oracle.compare(got, duck.sql(entry.oracle_sql()[name]).df()) == "ok"


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 120
