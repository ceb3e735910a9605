"""No document text is shuffled by the lookups and duplicate decisions."""

from __future__ import annotations

import re
from pathlib import Path

import pytest

from folioflow.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not mounted")


@pytest.mark.parametrize("name", ["hash_lookup", "title_call_lookup", "duplicate_decisions", "duplicate_admission"])
def test_no_text_under_an_exchange(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().explainString(mode)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    exchanges = [block for block in plan.split("\n\n") if re.match(r"\(\d+\) Exchange", block)]
    assert exchanges and not any(re.search(r"\btext#", block) for block in exchanges)
