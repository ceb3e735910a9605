"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest
from compare import differences

from folioflow.plans.oracles import ORACLES
from folioflow.plans.queries import QUERIES

SF = Path("/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not SF.exists(), reason="test tables are not mounted")


@pytest.fixture(scope="module")
def twin():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_twin(spark, twin, name):
    assert differences(QUERIES[name](spark, str(SF)), twin, ORACLES[name]) == []
