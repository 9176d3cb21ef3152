"""Every registered query, whole results, next to its SQL oracle on the smallest tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle_check import differences, duck

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, connection, name):
    assert differences(spark, connection, queries()[name], oracle_sql()[name], SF) is None


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_without_oracle(spark, name):
    frame = queries()[name](spark, SF)
    assert frame.count() > 0 and frame.columns


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    """The known totals of the flagship data, whole documents."""
    got = {r.lang: r for r in entry(spark).collect()}
    assert set(got) == {"de", "en", "es", "fr"} and all(r.errors > 0 and r.words > r.errors for r in got.values())


@pytest.mark.parametrize("name", sorted(set(queries()) - {"stream_leaderboard", "stream_rescoring"}))
def test_plan_has_no_cross_join(spark, name):
    plan = queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scans_read_only_what_they_need(spark):
    plan = queries()["wer_by_lang"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in plan
    plan = queries()["length_range"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(n_chars), GreaterThan(n_chars,450), LessThan(n_chars,4500)]" in plan


def test_report_scores_once(spark):
    plan = queries()["leaderboard_report"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
