"""The scoring job by run date: numbers stay unique whatever the order of dates and repetitions."""

import uuid

import pytest
from pyspark.sql import functions as F

from cohortcart.operators import risk as RK
from cohortcart.plans import ledger
from cohortcart.plans.jobs import run_risk_batch
from cohortcart.session import scratch_path
from cohortcart.sources import fixtures as FX
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def admissions(spark):
    path = scratch_path(spark, "job-admissions")
    FX.admissions(spark, SF_SMALL).where("Admission_ID <= 4000").write.parquet(path)
    return spark.read.parquet(path)


class Job:
    """The job into fresh tables by run date."""

    def __init__(self, spark, located=True):
        tag = uuid.uuid4().hex[:8]
        self.spark = spark
        self.names = {"risk_table": f"scores_{tag}", "alerts_table": f"alerts_{tag}"}
        self.location = scratch_path(spark, "job") if located else None

    def run(self, day, rows):
        return run_risk_batch(self.spark, rows, f"{day} 08:00:00", location=self.location, by_run_date=True, **self.names)

    def forget(self):
        """Drops the catalog entries; the files stay."""
        for name in self.names.values():
            self.spark.sql(f"DROP TABLE {name}")
            self.spark.sql(f"DROP TABLE {ledger.ledger_name(name)}")

    def check(self, rows_by_day):
        """Unique numbers, the right rows per date, numbers without gaps within a date's range."""
        for name in self.names.values():
            table = self.spark.table(name)
            n, different = table.agg(F.count("ID"), F.count_distinct("ID")).first()
            assert n == different == table.count(), name
            ranges = {r["run_key"]: (r["first_id"], r["reserved"]) for r in
                      ledger.reservations(self.spark, name).orderBy("reservation").collect()}
            for r in table.groupBy("run_date").agg(F.count("ID").alias("n"), F.min("ID").alias("lo"), F.max("ID").alias("hi")).collect():
                first, reserved = ranges[str(r["run_date"])]
                assert r["lo"] == first and r["hi"] == first + r["n"] - 1 and r["n"] <= reserved
        scores = {str(r["run_date"]): r["count"] for r in self.spark.table(self.names["risk_table"]).groupBy("run_date").count().collect()}
        assert scores == rows_by_day


def test_dates_out_of_order_and_filled_in_later(spark, admissions):
    job, ten = Job(spark), admissions.limit(10)
    for day in ("2002-01-03", "2002-01-01", "2002-01-02"):
        job.run(day, ten)
    job.check({"2002-01-01": 10, "2002-01-02": 10, "2002-01-03": 10})


def test_repeated_runs_keep_or_renew_their_range(spark, admissions):
    job = Job(spark)
    less, more = admissions.where("Admission_ID % 2 = 0"), admissions
    a = job.run("2002-01-01", less)
    b = job.run("2002-01-02", less)
    again = job.run("2002-01-01", less)
    assert again == a and b.first_risk_id == a.first_risk_id + less.count()
    renewed = job.run("2002-01-01", more)                    # more rows than its range holds
    assert renewed.first_risk_id == b.first_risk_id + less.count()
    job.check({"2002-01-01": more.count(), "2002-01-02": less.count()})
    fewer = job.run("2002-01-01", less)                      # fits the renewed range
    assert fewer.first_risk_id == renewed.first_risk_id
    job.run("2002-01-03", more)
    job.check({"2002-01-01": less.count(), "2002-01-02": less.count(), "2002-01-03": more.count()})


def test_numbers_go_on_after_the_catalog_is_lost(spark, admissions):
    job, some = Job(spark), admissions.limit(20)
    job.run("2002-01-01", some)
    job.forget()
    job.run("2002-01-02", some)
    job.check({"2002-01-01": 20, "2002-01-02": 20})


def test_a_table_without_a_ledger_is_taken_over(spark, admissions):
    job, some = Job(spark), admissions.limit(20)
    first = job.run("2002-01-01", some)
    for name in job.names.values():
        spark.createDataFrame([], ledger.LEDGER_COLUMNS).write.insertInto(ledger.ledger_name(name), overwrite=True)
    second = job.run("2002-01-02", some)
    assert second.first_risk_id == first.first_risk_id + 20


def test_no_scan_of_the_scores_for_the_largest_number(spark, admissions, monkeypatch):
    job = Job(spark)
    job.run("2002-01-01", admissions)
    read = []
    plain = spark.table

    def table(name):
        read.append(name)
        return plain(name)

    monkeypatch.setattr(spark, "table", table)
    ledger.open_ledger(spark, job.names["risk_table"])
    ledger.reserve(spark, job.names["risk_table"], "2002-01-02", 5)
    assert set(read) == {ledger.ledger_name(job.names["risk_table"])}


def test_empty_run_and_no_alerts(spark, admissions):
    job = Job(spark)
    job.run("2002-01-01", admissions.where("false"))
    job.run("2002-01-02", admissions.limit(5))
    job.check({"2002-01-02": 5})


def test_records_of_a_run_are_the_scored_admissions(spark, admissions):
    job = Job(spark)
    job.run("2002-01-05", admissions)
    got = spark.table(job.names["risk_table"]).drop("run_date", "ID")
    want = RK.risk_records(RK.risk_factors(admissions), "2002-01-05 08:00:00").drop("ID")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
