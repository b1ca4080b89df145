"""Plan shape: one scan for the fused RFM aggregate, no single-partition NTILE, no Python in plans,
stable results under different partitioning."""

import re

import pytest

import __spark_entry__ as entry
from cohortcart.operators import readmission as RA
from cohortcart.operators import rfm as RFM
from cohortcart.plans.inspect import plan_text
from cohortcart.plans.queries import TABLE_QUERIES, bind
from cohortcart.session import scratch_path
from cohortcart.sources import fixtures as FX
from cohortcart.sources.tables import load_admissions, load_transactions
from tests.conftest import SF_SMALL


def plan(df) -> str:
    return plan_text(df)


@pytest.fixture(scope="module")
def stored(spark):
    root = scratch_path(spark, "plan-inputs")
    FX.admissions(spark, SF_SMALL).write.parquet(f"{root}/admissions")
    FX.transactions(spark, SF_SMALL).write.parquet(f"{root}/transactions")
    return root


def test_rfm_values_scans_once(spark, stored):
    p = plan(RFM.rfm_values(load_transactions(spark, f"{stored}/transactions"), "2002-01-01"))
    assert p.count("FileScan parquet") == 1
    assert "SortMergeJoin" not in p and "BroadcastHashJoin" not in p


def test_rfm_values_prunes_columns(spark, stored):
    p = plan(RFM.rfm_values(load_transactions(spark, f"{stored}/transactions"), "2002-01-01"))
    assert "Description" not in p and "UnitPrice" not in p and "Country" not in p
    assert "PushedFilters: [IsNotNull(CustomerID)]" in p


def test_rfm_scores_are_comparisons_over_the_stored_values(spark, stored):
    df = RFM.rfm_scores(load_transactions(spark, f"{stored}/transactions"), "2002-01-01", sort=False)
    p = plan(df)
    assert "Exchange" not in p and "Window" not in p and "Join" not in p, p


def test_readmission_rate_hashes_narrow_rows(spark, stored, monkeypatch):
    """The day table: one window, no sort-based aggregate, nothing but its own columns in an exchange."""
    plans, write = [], RA.stored
    monkeypatch.setattr(RA, "stored", lambda df, name: (plans.append(plan(df)), write(df, name))[1])
    p = plan(RA.readmission_rate(load_admissions(spark, f"{stored}/admissions"), "Medical_Condition"))
    assert plans[0].count("Window [") == 1 and "Join" not in plans[0] and plans[0].count("FileScan") == 1
    for text in (plans[0], p):
        assert "SortAggregate" not in text
    assert p.count("FileScan") == 2                      # the rows once more, and the day table
    # the row-level data is never hash-partitioned by the patient alone
    assert not re.search(r"hashpartitioning\(Name#\d+, \d+\)", plans[0])


def test_flagged_rows_move_no_whole_rows(spark, stored, monkeypatch):
    plans, write = [], RA.stored
    monkeypatch.setattr(RA, "stored", lambda df, name: (plans.append(plan(df)), write(df, name))[1])
    p = plan(RA.readmissions(RA.flag_readmissions(load_admissions(spark, f"{stored}/admissions"))))
    assert all("SortAggregate" not in text for text in (*plans, p))
    assert not re.search(r"Doctor|Hospital|Room_Number", " ".join(re.findall(r"Exchange [^\n]*", p)))


def test_all_rates_share_one_flag_pipeline(spark, stored):
    from cohortcart.plans.queries import _rate_dimensions
    p = plan(RA.readmission_rates(load_admissions(spark, f"{stored}/admissions"), _rate_dimensions()))
    assert p.count("FileScan") == 2 and "SortAggregate" not in p


def test_scoring_has_no_join(spark, stored):
    from cohortcart.operators import risk as RK
    p = plan(RK.risk_factors(load_admissions(spark, f"{stored}/admissions")))
    assert "Join" not in p and "Exchange" not in p


def test_flagged_rows_and_direct_rates_agree(spark, stored):
    adm = load_admissions(spark, f"{stored}/admissions")
    for dim in ["Medical_Condition", "Medication"]:
        direct = sorted(map(tuple, RA.readmission_rate(adm, dim, sort=False).collect()), key=str)
        flagged = sorted(map(tuple, RA.rate_from_flags(RA.flag_readmissions(adm), dim, sort=False).collect()),
                         key=str)
        assert direct == flagged


def test_no_python_in_any_plan(spark, stored):
    def inputs(spark_, src, table):
        return (load_admissions if table == "admissions" else load_transactions)(spark_, f"{src}/{table}")
    for key in TABLE_QUERIES:
        if key in ("risk_batch", "risk_alerts"):
            continue
        p = plan(bind(key, inputs)(spark, stored))
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p and "PythonUDF" not in p, key


@pytest.mark.parametrize("key", ["readmit_rate_age", "rfm_scores", "sales_segments", "risk_distribution"])
def test_results_do_not_depend_on_shuffle_partitions(spark, key):
    q = entry.queries()[key]
    before = sorted(map(tuple, q(spark, SF_SMALL).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        after = sorted(map(tuple, q(spark, SF_SMALL).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert before == after


def test_breakdowns_add_up(spark):
    qs = entry.queries()
    total = qs["readmissions_30d"](spark, SF_SMALL).count()
    for key in ["readmit_rate_condition", "readmit_rate_age", "readmit_rate_los", "readmit_rate_admission_type",
                "readmit_rate_insurance", "readmit_rate_medication", "readmit_rate_test_results"]:
        rows = qs[key](spark, SF_SMALL).collect()
        assert sum(r["readmissions"] for r in rows) == total, key
        assert sum(r[1] for r in rows) == 1500, key


def test_alert_filters_reach_the_scan(spark, tmp_location):
    from cohortcart.operators import risk as RK
    from cohortcart.plans.queries import RUN_TS
    adm = FX.admissions(spark, SF_SMALL)
    RK.risk_records(RK.risk_factors(adm), RUN_TS).write.parquet(tmp_location)
    due = RK.due_for_alert(spark.read.parquet(tmp_location), RUN_TS[:10])
    p = plan_text(due, "formatted")                     # the simple mode truncates filter lists
    pushed = [line for line in p.split("\n") if line.startswith("PushedFilters")][0]
    assert "GreaterThanOrEqual(CalculationDate" in pushed and "LessThan(CalculationDate" in pushed
    assert "In(RiskCategory" in pushed


def test_list_table_columns_reads_the_catalog(spark, tmp_location):
    from cohortcart.operators.quality import list_table_columns
    spark.sql(f"CREATE TABLE cols_t (a INT, b STRING) USING parquet LOCATION '{tmp_location}'")
    assert [r[0] for r in list_table_columns(spark, "cols_t").collect()] == ["a", "b"]


def test_results_do_not_depend_on_input_partitioning(spark):
    from cohortcart.operators import sales as S
    adm = FX.admissions(spark, SF_SMALL)
    tx = FX.transactions(spark, SF_SMALL)
    cases = [
        (lambda a, t: RA.readmission_rate(a, "Medication", sort=False), (adm, tx)),
        (lambda a, t: RA.flag_readmissions(a).select("Admission_ID", "is_readmission"), (adm, tx)),
        (lambda a, t: RFM.rfm_scores(t, "2002-01-01", sort=False, select_rows=50), (adm, tx)),
        (lambda a, t: S.country_sales(t, sort=False), (adm, tx)),
    ]
    for build, (a, t) in cases:
        base = sorted(map(tuple, build(a, t).collect()), key=str)
        for n in (1, 7):
            again = sorted(map(tuple, build(a.repartition(n), t.repartition(n)).collect()), key=str)
            assert again == base
