"""Additive rule-based readmission risk score, the persisted score records, alerts and reports."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortcart.functions.bands import (ALERT_CATEGORIES, RISK_CATEGORY_ORDER, RISK_RULEBOOK, first_match,
                                        risk_category)
from cohortcart.functions.rounding import pct_half_up_int
from cohortcart.operators.placing import order_by_counts
from cohortcart.operators.ranking import global_row_number
from cohortcart.operators.readmission import length_of_stay, tie_columns
from cohortcart.operators.shares import share_by

# ---- fixed values: alert text -----------------------------------------------------------
ALERT_TYPE = "Readmission Risk"
ALERT_MESSAGE_PREFIX = "Patient identified as "
ALERT_MESSAGE_SUFFIX = " for 30-day readmission. Consider enhanced follow-up."
# -----------------------------------------------------------------------------------------

# ---- fixed values: names of scored attributes and of the persisted record -----------------
SCORE_COLUMNS = ["Name", "Medical_Condition", "Age", "Admission_Type", "Insurance_Provider", "Medication",
                 "Test_Results", "length_of_stay", "total_risk_score", "risk_category", "was_readmitted"]

# persisted record column <- scored column, in table order after ID
RECORD_COLUMNS = [("PatientName", "Name"), ("MedicalCondition", "Medical_Condition"), ("Age", "Age"),
                  ("AdmissionType", "Admission_Type"), ("InsuranceProvider", "Insurance_Provider"),
                  ("Medication", "Medication"), ("TestResults", "Test_Results"),
                  ("LengthOfStay", "length_of_stay"), ("TotalRiskScore", "total_risk_score"),
                  ("RiskCategory", "risk_category")]
# -----------------------------------------------------------------------------------------


def timestamp_text(ts) -> str:
    """A wall-clock timestamp literal (no time zone is applied)."""
    if isinstance(ts, dt.datetime):
        return ts.isoformat(sep=" ")
    if isinstance(ts, dt.date):
        return f"{ts.isoformat()} 00:00:00"
    return str(ts)


def risk_factors(admissions: DataFrame, rulebook: dict = RISK_RULEBOOK, admitted: str = "Date_of_Admission",
                 discharged: str = "Discharge_Date") -> DataFrame:
    """All columns of the admissions plus ``length_of_stay``, one column of points per factor of
    ``rulebook``, ``total_risk_score`` and ``risk_category``: a projection of the scan, no join.

    A NULL stay earns 0 points here (no rule holds).
    """
    f = admissions.withColumn("length_of_stay", length_of_stay(admitted, discharged))
    points = [first_match(col, rules, default).cast("int").alias(name)
              for name, (col, rules, default) in rulebook.items()]
    f = f.select("*", *points)
    total = reduce(add, [F.col(name) for name in rulebook])
    return (f.withColumn("total_risk_score", total.cast("int"))
            .withColumn("risk_category", risk_category("total_risk_score")))


def score_risk(flagged: DataFrame, rulebook: dict = RISK_RULEBOOK, sort: bool = True) -> DataFrame:
    """Per flagged admission: the scored attributes, total score, category and observed readmission
    (``was_readmitted``, to validate the score against; the points never look at it), highest score
    first.  The score has a few hundred values at most, so rows are placed by counting (``placing``), with a
    hash of the admission (not returned) as tie-breaker; the flags are computed once."""
    scored = risk_factors(flagged, rulebook).withColumn("was_readmitted", F.col("is_readmission"))
    if not sort:
        return scored.select(*SCORE_COLUMNS)
    ties = tie_columns(flagged, "", "")
    scored = scored.select(*SCORE_COLUMNS, F.xxhash64(*ties).alias("_ties"))
    return order_by_counts(scored, "total_risk_score", "_ties", ascending=False).drop("_ties")


def risk_records(factors: DataFrame, run_ts, start_id: int = 0, n: int | None = None, **rank_options) -> DataFrame:
    """Rows of the persisted score table for one run: ``ID`` continues after ``start_id`` in order of the
    admission id and then of all other columns (exact and gap-free), and every row carries the same
    ``CalculationDate``."""
    derived = {*RISK_RULEBOOK, "length_of_stay", "total_risk_score", "risk_category"}
    ties = [c for c in tie_columns(factors, "", "") if c not in derived]
    # only the record's columns and the order's move; the order beyond the id travels as it is needed
    kept = dict.fromkeys([src for _, src in RECORD_COLUMNS] + ties)
    ranked = global_row_number(factors.select(*kept), [(c, True) for c in ties], "_seq", n, **rank_options)
    return ranked.select((F.col("_seq") + F.lit(start_id)).cast("long").alias("ID"),
                         *[F.col(src).alias(dst) for dst, src in RECORD_COLUMNS],
                         F.lit(timestamp_text(run_ts)).cast("timestamp_ntz").alias("CalculationDate"))


def due_for_alert(records: DataFrame, as_of) -> DataFrame:
    """High / Very High records calculated on day ``as_of``.

    The day test is a range on ``CalculationDate`` (pushed to the scan); it compares the *date*
    of the calculation, which is what the alert step intends - an equality between the stored
    timestamp and midnight would only hold for runs at exactly 00:00:00.
    """
    day = as_of if isinstance(as_of, dt.date) and not isinstance(as_of, dt.datetime) else \
        dt.date.fromisoformat(str(as_of)[:10])
    lo = F.lit(f"{day.isoformat()} 00:00:00").cast("timestamp_ntz")
    hi = F.lit(f"{(day + dt.timedelta(days=1)).isoformat()} 00:00:00").cast("timestamp_ntz")
    return records.filter(F.col("RiskCategory").isin(ALERT_CATEGORIES)
                          & (F.col("CalculationDate") >= lo) & (F.col("CalculationDate") < hi))


def build_alerts(records: DataFrame, as_of, created_ts, start_id: int = 0, n: int | None = None) -> DataFrame:
    """One alert per record ``due_for_alert``, numbered in order of the records.  ``n`` (about how many
    records there are; counted if not given) only sets how finely the numbering is split."""
    ranked = global_row_number(due_for_alert(records, as_of), [("ID", True)], "_seq", n)
    message = F.concat(F.lit(ALERT_MESSAGE_PREFIX), F.col("RiskCategory"), F.lit(ALERT_MESSAGE_SUFFIX))
    return ranked.select((F.col("_seq") + F.lit(start_id)).cast("long").alias("ID"), "PatientName",
                         F.lit(ALERT_TYPE).alias("AlertType"), message.alias("AlertMessage"),
                         F.lit(timestamp_text(created_ts)).cast("timestamp_ntz").alias("CreatedDate"))


def risk_results(records: DataFrame) -> DataFrame:
    """All persisted score records, highest score first, then by ``ID``.  The records are a stored table, so they are
    placed by counting without storing them again; a score shared by many rows is split by ``ID``."""
    return order_by_counts(records, "TotalRiskScore", "ID", ascending=False, store=False)


def risk_distribution(records: DataFrame, sort: bool = True) -> DataFrame:
    """Records per category and their whole-percent share, in severity order."""
    return share_by(records, "RiskCategory", "PatientCount", "Percentage", pct_half_up_int,
                    RISK_CATEGORY_ORDER, sort=sort)
