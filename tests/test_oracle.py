"""Every query that SQL can express gives the rows of its SQL; the others give rows."""

import re

import pytest
from check_oracle import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

ORACLES = oracle_sql()
NO_SQL = {
    "knn_lsh",
    "classify_fit_eval",
    "classify_batch",
    "classify_weighted",
    "stream_classify",
}


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_only_models_and_approximations_lack_sql():
    own = {name for name in queries() if not re.match(r"op\d+_|pipeline$", name)}
    assert own - set(ORACLES) == NO_SQL


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, sf_dir, name):
    verdict, _seconds, _rows, detail = compare(spark, duck, name, queries()[name], ORACLES[name], sf_dir)
    assert verdict == "ok", detail


def test_entry(spark):
    rows = {r["metric"]: r["value"] for r in entry(spark).collect()}
    assert rows["MRR@10"] == 1.0  # every query finds itself, or its copy, in the index
    assert all(0 <= v <= 1 for v in rows.values())
    assert rows["Hit@1"] <= rows["Hit@5"] <= rows["Hit@10"]
