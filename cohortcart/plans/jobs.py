"""The repeatable scoring job: score every admission, append the scores, raise alerts.

Two write jobs in order (alerts read the score table just written), no transaction around them.  The run
time is one explicit timestamp stamped on every row.  Output tables are parquet tables created on first
use, optionally at an explicit location in shared storage.

By default each run appends, so a second run adds a second set of rows; ``ID`` continues after the
table's current maximum, which assumes a single writer per table.  With ``by_run_date=True`` both tables
are partitioned by ``run_date`` and a run replaces its date's partition: a failed and repeated run leaves
one set of rows with the same ids, and the alert step reads one partition.  Ids then come from ranges
that a ledger beside each table reserves per date (``cohortcart.plans.ledger``) before rows are written,
so they are unique whatever the order of dates, repetitions and row counts.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortcart.operators.risk import build_alerts, due_for_alert, risk_factors, risk_records
from cohortcart.plans.ledger import ledger_name, open_ledger, reserve

# ---- fixed values: names of the output tables and their columns ------------------------------
RISK_TABLE = "PatientReadmissionRisk"
ALERTS_TABLE = "PatientAlerts"

# ID is BIGINT: row counts at the target scale exceed the INT range.
RISK_TABLE_COLUMNS = ("ID BIGINT, PatientName STRING, MedicalCondition STRING, Age INT, AdmissionType STRING, "
                      "InsuranceProvider STRING, Medication STRING, TestResults STRING, LengthOfStay INT, "
                      "TotalRiskScore INT, RiskCategory STRING, CalculationDate TIMESTAMP_NTZ")
ALERTS_TABLE_COLUMNS = ("ID BIGINT, PatientName STRING, AlertType STRING, AlertMessage STRING, "
                        "CreatedDate TIMESTAMP_NTZ")
# -----------------------------------------------------------------------------------------
RUN_DATE = "run_date"


@dataclass
class RiskBatchResult:
    risk_table: str
    alerts_table: str
    run_ts: str
    first_risk_id: int
    first_alert_id: int


def ensure_table(spark: SparkSession, name: str, columns: str, location: str | None = None,
                 partitioned: bool = False) -> bool:
    """``CREATE TABLE IF NOT EXISTS`` (parquet), at ``location`` when given; True if it existed."""
    existed = spark.catalog.tableExists(name)
    where = f" LOCATION '{location}'" if location else ""
    parts = f" PARTITIONED BY ({RUN_DATE} DATE)" if partitioned else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet{parts}{where}")
    if partitioned and location and not existed and _exists(spark, location):
        spark.catalog.recoverPartitions(name)          # partitions of earlier runs
    return existed


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, asked of the file system that Spark itself uses for it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _max_id(table: DataFrame, may_hold_rows: bool = True) -> int:
    """Largest ``ID`` so far; 0 without a scan for a managed table this run created.  A table created at an
    explicit location may hold rows of earlier runs, so its ``ID`` column is always read."""
    if not may_hold_rows:
        return 0
    return table.agg(F.max("ID")).first()[0] or 0


def _append(rows: DataFrame, name: str, day: str | None) -> None:
    """Appends to the table, or replaces its partition of ``day``."""
    if day is None:
        rows.write.insertInto(name)
        return
    spark = rows.sparkSession
    rows.createOrReplaceTempView("_scoring_rows")
    columns = ", ".join(rows.columns)
    spark.sql(f"INSERT OVERWRITE TABLE {name} PARTITION ({RUN_DATE} = DATE '{day}') SELECT {columns} FROM _scoring_rows")
    spark.catalog.dropTempView("_scoring_rows")


def run_risk_batch(spark: SparkSession, admissions: DataFrame, run_ts: dt.datetime | str | None = None,
                   risk_table: str = RISK_TABLE, alerts_table: str = ALERTS_TABLE,
                   location: str | None = None, by_run_date: bool = False) -> RiskBatchResult:
    """Score all admissions into ``risk_table`` and alert on today's High / Very High rows."""
    if run_ts is None:
        run_ts = dt.datetime.now().replace(microsecond=0)
    ts_text = run_ts.isoformat(sep=" ") if isinstance(run_ts, dt.datetime) else str(run_ts)
    day = ts_text[:10] if by_run_date else None

    def prepared(name: str, columns: str, n: int) -> int:
        """Creates the table; the id that the first of this run's ``n`` rows follows."""
        existed = ensure_table(spark, name, columns, f"{location}/{name}" if location else None, by_run_date)
        if not by_run_date:
            return _max_id(spark.table(name), existed or location is not None)
        open_ledger(spark, name, f"{location}/{ledger_name(name)}" if location else None)
        return reserve(spark, name, day, n).before

    n = admissions.count()
    first_risk = prepared(risk_table, RISK_TABLE_COLUMNS, n)
    _append(risk_records(risk_factors(admissions), ts_text, first_risk, n), risk_table, day)

    scores = spark.table(risk_table)
    if by_run_date:
        scores = scores.where(F.col(RUN_DATE) == F.lit(day).cast("date")).drop(RUN_DATE)
    # how many alerts there are is needed for their range only
    due = due_for_alert(scores, ts_text[:10]).count() if by_run_date else n
    first_alert = prepared(alerts_table, ALERTS_TABLE_COLUMNS, due)
    _append(build_alerts(scores, ts_text[:10], ts_text, first_alert, due), alerts_table, day)
    return RiskBatchResult(risk_table, alerts_table, ts_text, first_risk, first_alert)


def main(argv: list[str] | None = None) -> RiskBatchResult:
    """Command-line run of the scoring job, e.g. from a scheduler:

    ``python -m cohortcart.plans.jobs --admissions <table or parquet path> [--location <dir>]
    [--run-ts "YYYY-MM-DD HH:MM:SS"] [--risk-table NAME] [--alerts-table NAME] [--by-run-date]``
    """
    import argparse

    from cohortcart.sources.tables import load_admissions

    parser = argparse.ArgumentParser(prog="cohortcart.plans.jobs", description=main.__doc__)
    parser.add_argument("--admissions", required=True, help="catalog table or parquet path")
    parser.add_argument("--location", default=None, help="shared folder for the output tables")
    parser.add_argument("--run-ts", default=None, help="run time stamped on every row (default: now)")
    parser.add_argument("--risk-table", default=RISK_TABLE)
    parser.add_argument("--alerts-table", default=ALERTS_TABLE)
    parser.add_argument("--by-run-date", action="store_true", help="replace the run date's partition")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    result = run_risk_batch(spark, load_admissions(spark, args.admissions), args.run_ts,
                            args.risk_table, args.alerts_table, args.location, args.by_run_date)
    print(result)
    return result


if __name__ == "__main__":
    main()
