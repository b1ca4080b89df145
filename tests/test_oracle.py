"""Every registered query equals its SQL twin (DuckDB) on the small fixture tables."""

import pytest

import __spark_entry__ as entry
from cohortcart.plans import queries as _queries
from tests.conftest import SF_SMALL
from tests.harness import compare, duck

# the training-data queries have tests of their own in tests/llm
KEYS = sorted(_queries.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(KEYS) <= set(entry.oracle_sql()) and set(KEYS) <= set(entry.queries())
    assert len(KEYS) == 35


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    df = entry.queries()[key](spark, SF_SMALL)
    res = compare(df, entry.oracle_sql()[key], con)
    assert res["ok"], res
    assert not res["type_mismatch"], res


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["Medical_Condition", "total_admissions", "readmissions", "readmission_rate_percent"]
    assert df.count() > 0


def test_narrowed_brackets_and_many_ranges_match_the_oracle(spark):
    """Small bounds force the paths that large inputs take."""
    from cohortcart.operators import rfm as RFM
    from cohortcart.operators import risk as RK
    from cohortcart.plans.queries import RUN_TS
    from cohortcart.sources import fixtures as FX
    from tests.conftest import SF_CHECK

    con = duck(SF_CHECK)
    sql = entry.oracle_sql()
    scores = RFM.rfm_scores(FX.transactions(spark, SF_CHECK), FX.AS_OF, select_rows=100)
    assert compare(scores, sql["rfm_scores"], con)["ok"]
    records = RK.risk_records(RK.risk_factors(FX.admissions(spark, SF_CHECK)), RUN_TS, rows_per_range=1000)
    assert compare(records, sql["risk_batch"], con)["ok"]


@pytest.mark.parametrize("key", ["transactions_scan", "monthly_trend", "rfm_values", "risk_alerts"])
def test_results_do_not_depend_on_the_session_time_zone(spark, con, key):
    """Timestamps are wall-clock (TIMESTAMP_NTZ) and literals are cast from text."""
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        res = compare(entry.queries()[key](spark, SF_SMALL), entry.oracle_sql()[key], con)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert res["ok"], res
