"""The facts FIXTURES.md records for the sf0.01 tables, reproduced by the operators."""

import pytest
from pyspark.sql import functions as F

from cohortcart.operators import quality as Q
from cohortcart.operators import readmission as RA
from cohortcart.operators import rfm as RFM
from cohortcart.operators import risk as RK
from cohortcart.sources import fixtures as FX
from tests.conftest import SF_CHECK


@pytest.fixture(scope="module")
def adm(spark):
    return FX.admissions(spark, SF_CHECK)


@pytest.fixture(scope="module")
def tx(spark):
    return FX.transactions(spark, SF_CHECK)


def test_admission_facts(adm):
    assert adm.count() == 15_000
    assert adm.select("Name").distinct().count() == 1_500
    nulls = Q.missing_audit(adm, ["Discharge_Date", "Age", "Medical_Condition", "Billing_Amount"]).first()
    assert tuple(nulls) == (246, 170, 1_936, 300)


def test_readmission_facts(adm):
    flagged = RA.flag_readmissions(adm)
    assert RA.readmissions(flagged).count() == 1_574
    days = F.col("days_until_readmission")
    assert flagged.filter(days == 0).count() == 45
    assert flagged.filter(days < 0).count() == 879


def test_risk_category_facts(adm):
    got = {r["risk_category"]: r["n"] for r in
           RK.score_risk(RA.flag_readmissions(adm), sort=False).groupBy("risk_category")
           .agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {"Very High Risk": 287, "High Risk": 3_628, "Moderate Risk": 7_432, "Low Risk": 3_372,
                   "Very Low Risk": 281}


def test_transaction_facts(tx):
    p = Q.profile(tx).first()
    assert (p["TotalRows"], p["TotalInvoices"], p["TotalCustomers"], p["TotalProducts"], p["TotalCountries"]) == \
        (60_000, 14_743, 1_425, 2_000, 25)
    assert str(p["EarliestDate"]) == "1995-01-01" and str(p["LatestDate"]) == "2001-08-01"
    assert tx.filter(F.col("Quantity") < 0).count() == 20_046


def test_segment_facts(tx):
    got = {r["SalesSegment"]: r["CustomerCount"] for r in RFM.sales_segments(tx).collect()}
    assert got == {"High Value": 5, "Medium Value": 531, "Low Value": 533, "Dormant": 356}
