"""Declarative bands and rulebooks, turned into first-match ``CASE`` Columns.

A rule is ``(condition, value)``; a condition is one of
``("<", x)``, ``(">", x)``, ``(">=", x)``, ``("between", lo, hi)`` (inclusive),
``("==", v)``, ``("in", [v, ...])``.  The first rule that holds wins; otherwise
the default.  A NULL input satisfies no condition, so it takes the default.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: labels, bounds, points and thresholds of the analyses ----------------
AGE_GROUPS = [
    (("<", 18), "Under 18"),
    (("between", 18, 35), "18-35"),
    (("between", 36, 50), "36-50"),
    (("between", 51, 65), "51-65"),
    (("between", 66, 80), "66-80"),
]
AGE_GROUP_ELSE = "Over 80"

STAY_GROUPS = [
    (("<", 3), "Less than 3 days"),
    (("between", 3, 7), "3-7 days"),
    (("between", 8, 14), "8-14 days"),
    (("between", 15, 21), "15-21 days"),
]
STAY_GROUP_ELSE = "More than 21 days"

# factor name -> (input column, rules, points when no rule holds)
RISK_RULEBOOK = {
    "condition_risk": ("Medical_Condition", [
        (("==", "Asthma"), 35), (("==", "Obesity"), 31), (("==", "Diabetes"), 25),
        (("==", "Arthritis"), 18), (("==", "Hypertension"), 12), (("==", "Cancer"), 6)], 0),
    "insurance_risk": ("Insurance_Provider", [
        (("==", "Aetna"), 35), (("==", "UnitedHealthcare"), 25), (("==", "Cigna"), 20),
        (("==", "Blue Cross"), 15), (("==", "Medicare"), 10)], 0),
    "admission_type_risk": ("Admission_Type", [
        (("==", "Emergency"), 33), (("==", "Urgent"), 18), (("==", "Elective"), 12)], 0),
    "age_risk": ("Age", [
        (("between", 51, 65), 31), (("between", 18, 35), 26), (("between", 36, 50), 19),
        (("between", 66, 80), 13)], 0),
    "medication_risk": ("Medication", [
        (("==", "Lipitor"), 30), (("in", ["Paracetamol", "Aspirin", "Ibuprofen"]), 20),
        (("==", "Penicillin"), 14)], 0),
    "length_of_stay_risk": ("length_of_stay", [
        (("between", 15, 21), 30), ((">", 21), 27), (("between", 3, 7), 18), (("<", 3), 16),
        (("between", 8, 14), 9)], 0),
    "test_results_risk": ("Test_Results", [
        (("==", "Abnormal"), 29), (("==", "Inconclusive"), 24), (("==", "Normal"), 9)], 0),
}

RISK_CATEGORIES = [
    ((">=", 180), "Very High Risk"),
    ((">=", 140), "High Risk"),
    ((">=", 100), "Moderate Risk"),
    ((">=", 60), "Low Risk"),
]
RISK_CATEGORY_ELSE = "Very Low Risk"
RISK_CATEGORY_ORDER = ["Very High Risk", "High Risk", "Moderate Risk", "Low Risk"]   # then all others
ALERT_CATEGORIES = ["Very High Risk", "High Risk"]

SALES_SEGMENTS = [
    ((">=", 2000), "High Value"),
    (("between", 800, 1999), "Medium Value"),
    (("between", 400, 799), "Low Value"),
]
SALES_SEGMENT_ELSE = "Dormant"
SALES_SEGMENT_ORDER = ["High Value", "Medium Value", "Low Value", "Dormant"]         # then all others
# -----------------------------------------------------------------------------------------


def condition(col: Column, cond: Sequence) -> Column:
    op = cond[0]
    if op == "<":
        return col < F.lit(cond[1])
    if op == ">":
        return col > F.lit(cond[1])
    if op == ">=":
        return col >= F.lit(cond[1])
    if op == "between":
        return col.between(F.lit(cond[1]), F.lit(cond[2]))
    if op == "==":
        return col == F.lit(cond[1])
    if op == "in":
        return col.isin(list(cond[1]))
    raise ValueError(f"unknown condition {cond!r}")


def first_match(col: Column | str, rules: Sequence, default) -> Column:
    """``CASE WHEN rule1 THEN v1 WHEN rule2 THEN v2 ... ELSE default END``."""
    c = F.col(col) if isinstance(col, str) else col
    expr = None
    for cond, value in rules:
        test = condition(c, cond)
        expr = F.when(test, F.lit(value)) if expr is None else expr.when(test, F.lit(value))
    return F.lit(default) if expr is None else expr.otherwise(F.lit(default))


def rank_of(col: Column | str, order: Sequence[str]) -> Column:
    """Sort rank of a label: its 1-based position in ``order``, ``len(order)+1`` for anything else."""
    rules = [(("==", label), i + 1) for i, label in enumerate(order)]
    return first_match(col, rules, len(order) + 1)


def age_group(age: Column | str = "Age") -> Column:
    return first_match(age, AGE_GROUPS, AGE_GROUP_ELSE)


def stay_length_group(stay: Column | str = "length_of_stay") -> Column:
    return first_match(stay, STAY_GROUPS, STAY_GROUP_ELSE)


def sales_segment(total: Column | str = "TotalSales") -> Column:
    return first_match(total, SALES_SEGMENTS, SALES_SEGMENT_ELSE)


def risk_category(score: Column | str = "total_risk_score") -> Column:
    return first_match(score, RISK_CATEGORIES, RISK_CATEGORY_ELSE)


# ---- SQL twins, for the oracle queries --------------------------------------------------

def _sql_literal(value) -> str:
    return f"'{value}'" if isinstance(value, str) else str(value)


def condition_sql(col: str, cond: Sequence) -> str:
    op = cond[0]
    if op in ("<", ">", ">="):
        return f"{col} {op} {_sql_literal(cond[1])}"
    if op == "between":
        return f"{col} BETWEEN {_sql_literal(cond[1])} AND {_sql_literal(cond[2])}"
    if op == "==":
        return f"{col} = {_sql_literal(cond[1])}"
    if op == "in":
        return f"{col} IN ({', '.join(_sql_literal(v) for v in cond[1])})"
    raise ValueError(f"unknown condition {cond!r}")


def first_match_sql(col: str, rules: Sequence, default) -> str:
    arms = " ".join(f"WHEN {condition_sql(col, cond)} THEN {_sql_literal(value)}" for cond, value in rules)
    return f"CASE {arms} ELSE {_sql_literal(default)} END"


def rank_of_sql(col: str, order: Sequence[str]) -> str:
    return first_match_sql(col, [(("==", label), i + 1) for i, label in enumerate(order)], len(order) + 1)
