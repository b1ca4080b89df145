"""The registry of runnable queries: one entry per operator of the analyses.

``TABLE_QUERIES`` defines each query over its input tables (``admissions`` and/or
``transactions`` DataFrames); ``queries()`` feeds them the fixture tables derived
from the test parquet in ``sf_dir`` (``cohortcart.plans.oracle`` holds the SQL
twin under the same key), and the bench feeds them stored copies.
``risk_batch`` and ``risk_alerts`` really run the scoring job, into fresh tables
under the session's checkpoint directory, and return what was written; the two
reports read a stored score table that holds two runs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortcart.functions.bands import age_group, stay_length_group
from cohortcart.operators import baskets as BK
from cohortcart.operators import quality as Q
from cohortcart.operators import readmission as RA
from cohortcart.operators import rfm as RFM
from cohortcart.operators import risk as RK
from cohortcart.operators import sales as S
from cohortcart.plans import basket_store, flag_store
from cohortcart.plans.jobs import run_risk_batch
from cohortcart.session import scratch_path, stored
from cohortcart.sources import fixtures as FX
from cohortcart.sources import tables as T

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = FX.AS_OF
RUN_TS, SECOND_RUN_TS = FX.RUN_TS, FX.SECOND_RUN_TS

BASKETS_UNTIL = "1997-03-15"
FLAGS_UNTIL, FLAGS_FROM = "1995-07-01", "1997-01-01"        # the admissions in between arrive last

ADM, TX = "admissions", "transactions"
BUILDERS = {ADM: FX.admissions, TX: FX.transactions}


def _run_job(spark: SparkSession, adm: DataFrame, table: str) -> DataFrame:
    """Runs the job into fresh tables and returns ``table`` of them; the catalog entries are dropped, the
    files stay under the checkpoint folder until that is cleaned."""
    tag = uuid.uuid4().hex[:10]
    names = {"risk": f"patient_readmission_risk_{tag}", "alerts": f"patient_alerts_{tag}"}
    location = scratch_path(spark, "risk-batch")
    run_risk_batch(spark, adm, RUN_TS, risk_table=names["risk"], alerts_table=names["alerts"], location=location)
    schema = spark.table(names[table]).schema
    for name in names.values():
        spark.sql(f"DROP TABLE {name}")
    return spark.read.schema(schema).parquet(f"{location}/{names[table]}")


def _two_runs(spark: SparkSession, adm: DataFrame) -> DataFrame:
    """A stored score table that holds two runs."""
    first = RK.risk_records(RK.risk_factors(adm), RUN_TS)
    n = F.lit(adm.count())
    again = F.lit(SECOND_RUN_TS).cast("timestamp_ntz")
    both = F.array(F.struct(F.col("ID").alias("i"), F.col("CalculationDate").alias("c")),
                   F.struct((F.col("ID") + n).alias("i"), again.alias("c")))
    rows = first.withColumn("_run", F.explode(both))
    return stored(rows.select(F.col("_run.i").alias("ID"), *first.columns[1:-1],
                              F.col("_run.c").alias("CalculationDate")), "two-runs")


def _baskets(spark: SparkSession, tx: DataFrame) -> DataFrame:
    """The stored roll-up, built from the lines before a day and then refreshed with all of them."""
    location = scratch_path(spark, "baskets")
    basket_store.refresh(tx.where(F.col("InvoiceDate") < F.lit(f"{BASKETS_UNTIL} 00:00:00").cast("timestamp_ntz")), location)
    basket_store.refresh(tx, location)
    return basket_store.read(spark, location)


def _kept_flags(spark: SparkSession, adm: DataFrame) -> DataFrame:
    """The stored flags, after a first load, later admissions, and admissions that come late."""
    location, day = scratch_path(spark, "flags"), F.col("Date_of_Admission")
    first, later = day < F.lit(FLAGS_UNTIL).cast("date"), day >= F.lit(FLAGS_FROM).cast("date")
    flag_store.add(adm.where(first), location)
    flag_store.add(adm.where(later), location)
    flag_store.add(adm.where(~F.coalesce(first | later, F.lit(False))), location)
    return flag_store.read(spark, location)


def _hot_patient(adm: DataFrame) -> DataFrame:
    """A third of the admissions belong to one patient."""
    return adm.withColumn("Name", F.when(F.col("Admission_ID") % 3 == 0, F.lit("Hot Patient")).otherwise(F.col("Name")))


def _rate_dimensions() -> dict[str, Column]:
    return {"Medical_Condition": F.col("Medical_Condition"), "age_group": age_group("Age"),
            "stay_length_group": stay_length_group(RA.length_of_stay()), "Admission_Type": F.col("Admission_Type"),
            "Insurance_Provider": F.col("Insurance_Provider"), "Medication": F.col("Medication"),
            "Test_Results": F.col("Test_Results")}


def _rate(dim: str, count_name: str = "total_admissions"):
    return lambda spark, adm: RA.readmission_rate(adm, dim, dim, count_name)


# key -> (input tables, fn(spark, *inputs) -> DataFrame)
TABLE_QUERIES: dict[str, tuple[tuple[str, ...], Callable[..., DataFrame]]] = {
    # hospital readmission
    "admissions_scan": ((ADM,), lambda spark, adm: adm),
    "list_columns": ((ADM,), lambda spark, adm: Q.list_columns(adm)),
    "missing_audit_admissions": ((ADM,), lambda spark, adm: Q.missing_audit(adm, T.ADMISSION_AUDIT_COLUMNS)),
    "impute_billing_mean": ((ADM,), lambda spark, adm: Q.impute_mean(adm, "Billing_Amount")),
    "readmissions_30d": ((ADM,), lambda spark, adm: RA.readmissions(RA.flag_readmissions(adm))),
    "readmit_rate_condition": ((ADM,), _rate("Medical_Condition")),
    "readmit_rate_age": ((ADM,), lambda spark, adm: RA.rate_by_age(adm)),
    "readmit_rate_los": ((ADM,), lambda spark, adm: RA.rate_by_stay(adm)),
    "readmit_rate_admission_type": ((ADM,), _rate("Admission_Type")),
    "readmit_rate_insurance": ((ADM,), _rate("Insurance_Provider")),
    "readmit_rate_medication": ((ADM,), _rate("Medication", "total_prescriptions")),
    "readmit_rate_test_results": ((ADM,), _rate("Test_Results", "total_tests")),
    "readmit_rates_all": ((ADM,), lambda spark, adm: RA.readmission_rates(adm, _rate_dimensions())),
    "readmissions_without_id": ((ADM,), lambda spark, adm: RA.readmissions(
        RA.flag_readmissions(adm.drop("Admission_ID")))),
    "readmit_rate_hot_patient": ((ADM,), lambda spark, adm: RA.readmission_rate(
        _hot_patient(adm), "Medical_Condition")),
    # the same from flags kept in a table that batches of admissions were added to
    "kept_readmissions_30d": ((ADM,), lambda spark, adm: RA.readmissions(_kept_flags(spark, adm))),
    "kept_readmit_rate_condition": ((ADM,), lambda spark, adm: RA.rate_from_flags(
        _kept_flags(spark, adm), "Medical_Condition")),
    "risk_score": ((ADM,), lambda spark, adm: RK.score_risk(RA.flag_readmissions(adm))),
    "risk_batch": ((ADM,), lambda spark, adm: _run_job(spark, adm, "risk")),
    "risk_alerts": ((ADM,), lambda spark, adm: _run_job(spark, adm, "alerts")),
    "risk_results_sorted": ((ADM,), lambda spark, adm: RK.risk_results(_two_runs(spark, adm))),
    "risk_distribution": ((ADM,), lambda spark, adm: RK.risk_distribution(_two_runs(spark, adm))),
    # customer sales
    "transactions_scan": ((TX,), lambda spark, tx: tx),
    "dataset_profile": ((TX,), lambda spark, tx: Q.profile(tx)),
    "missing_audit_transactions": ((TX,), lambda spark, tx: Q.missing_audit(
        tx, T.TRANSACTION_AUDIT_COLUMNS, T.transaction_audit_names())),
    "monthly_trend": ((TX,), lambda spark, tx: S.monthly_trend(tx)),
    "country_sales": ((TX,), lambda spark, tx: S.country_sales(tx)),
    "customer_behaviour": ((TX,), lambda spark, tx: S.customer_behaviour(tx)),
    "rfm_values": ((TX,), lambda spark, tx: RFM.rfm_values(tx, AS_OF)),
    "rfm_scores": ((TX,), lambda spark, tx: RFM.rfm_scores(tx, AS_OF)),
    "sales_segments": ((TX,), lambda spark, tx: RFM.sales_segments(tx)),
    # the same reports from the stored basket roll-up
    "basket_monthly_trend": ((TX,), lambda spark, tx: BK.monthly_trend(_baskets(spark, tx))),
    "basket_country_sales": ((TX,), lambda spark, tx: BK.country_sales(_baskets(spark, tx))),
    "basket_customer_behaviour": ((TX,), lambda spark, tx: BK.customer_behaviour(_baskets(spark, tx))),
    "basket_rfm_values": ((TX,), lambda spark, tx: BK.rfm_values(_baskets(spark, tx), AS_OF)),
    "basket_rfm_scores": ((TX,), lambda spark, tx: BK.rfm_scores(_baskets(spark, tx), AS_OF)),
    "basket_sales_segments": ((TX,), lambda spark, tx: BK.sales_segments(_baskets(spark, tx))),
}


def bind(key: str, inputs: Callable[[SparkSession, str], DataFrame]) -> Callable[..., DataFrame]:
    """``(spark, source) -> DataFrame`` for ``key``, with ``inputs(spark, table_name)`` providing tables."""
    needs, fn = TABLE_QUERIES[key]
    return lambda spark, source: fn(spark, *[inputs(spark, source, t) for t in needs])


def queries() -> dict[str, Query]:
    """Registered queries over the fixture tables derived from the test parquet in ``sf_dir``."""
    return {k: bind(k, lambda spark, d, t: BUILDERS[t](spark, d)) for k in TABLE_QUERIES}
