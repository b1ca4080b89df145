"""Hand-written edge cases: each pins one semantic of the analyses (FIXTURES.md section 3)."""

import datetime as dt
from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortcart.functions.bands import age_group, sales_segment, stay_length_group
from cohortcart.operators import quality as Q
from cohortcart.operators import readmission as RA
from cohortcart.operators import rfm as RFM
from cohortcart.operators import risk as RK
from cohortcart.operators import sales as S
from cohortcart.operators.ranking import ntile
from cohortcart.plans.jobs import run_risk_batch
from cohortcart.sources.tables import ADMISSIONS_SCHEMA, TRANSACTIONS_SCHEMA

D = dt.date


def admission(i, name, admitted, discharged, **kw):
    row = {f.name: None for f in ADMISSIONS_SCHEMA.fields}
    row.update(Admission_ID=i, Name=name, Date_of_Admission=admitted, Discharge_Date=discharged)
    row.update(kw)
    return tuple(row[f.name] for f in ADMISSIONS_SCHEMA.fields)


def admissions_df(spark, rows):
    return spark.createDataFrame(rows, ADMISSIONS_SCHEMA)


def flags(spark, rows):
    out = RA.flag_readmissions(admissions_df(spark, rows))
    return {r["Admission_ID"]: (r["days_until_readmission"], r["is_readmission"]) for r in out.collect()}


def test_readmission_window_edges(spark):
    rows = [
        admission(1, "a", D(2019, 12, 20), D(2020, 1, 1)), admission(2, "a", D(2020, 1, 31), D(2020, 2, 2)),  # day 30
        admission(3, "b", D(2019, 12, 20), D(2020, 1, 1)), admission(4, "b", D(2020, 2, 1), D(2020, 2, 2)),   # day 31
        admission(5, "c", D(2020, 1, 1), D(2020, 1, 5)), admission(6, "c", D(2020, 1, 5), D(2020, 1, 6)),     # same day
        admission(7, "d", D(2020, 1, 1), D(2020, 1, 9)), admission(8, "d", D(2020, 1, 5), D(2020, 1, 6)),     # overlap
        admission(9, "e", D(2020, 1, 1), None), admission(10, "e", D(2020, 1, 10), D(2020, 1, 11)),           # no discharge
    ]
    f = flags(spark, rows)
    assert f[1] == (30, 1) and f[3] == (31, 0)
    assert f[5] == (0, 0) and f[7] == (-4, 0)
    assert f[9] == (None, 0)
    assert f[2] == (None, 0) and f[10] == (None, 0)          # last stays


def test_same_day_ties_follow_the_tie_breaker(spark):
    # three admissions of one patient on one day, then one 10 days later
    rows = [admission(30, "p", D(2020, 1, 1), D(2020, 1, 2)), admission(10, "p", D(2020, 1, 1), D(2020, 1, 2)),
            admission(20, "p", D(2020, 1, 1), D(2020, 1, 2)), admission(40, "p", D(2020, 1, 12), D(2020, 1, 13))]
    f = flags(spark, rows)
    assert f[10] == (-1, 0) and f[20] == (-1, 0)    # followed by the same day
    assert f[30] == (10, 1)                          # the last of the day is followed by the next day
    assert f[40] == (None, 0)


def test_null_patient_is_one_patient(spark):
    rows = [admission(1, None, D(2020, 1, 1), D(2020, 1, 2)), admission(2, None, D(2020, 1, 10), D(2020, 1, 11))]
    assert flags(spark, rows)[1] == (8, 1)


def test_flag_matches_plain_window_with_a_hot_patient(spark):
    """One patient holds a third of the rows: same answer as LEAD over PARTITION BY Name."""
    from pyspark.sql import Window
    base = spark.range(3000).select(
        F.col("id").alias("Admission_ID"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("p"), (F.col("id") % 97).cast("string")))
         .alias("Name"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") * 7 % 400).cast("int")).alias("Date_of_Admission"))
    base = base.withColumn("Discharge_Date", F.date_add("Date_of_Admission", (F.col("Admission_ID") % 5).cast("int")))
    ours = RA.flag_readmissions(base).select("Admission_ID", "next_admission", "is_readmission")
    w = Window.partitionBy("Name").orderBy("Date_of_Admission", "Admission_ID")
    plain = base.withColumn("next_admission", F.lead("Date_of_Admission").over(w))
    plain = plain.withColumn("is_readmission", F.when(
        F.datediff("next_admission", "Discharge_Date").between(1, 30), 1).otherwise(0))
    plain = plain.select("Admission_ID", "next_admission", "is_readmission")
    assert ours.exceptAll(plain).count() == 0 and plain.exceptAll(ours).count() == 0


def test_age_and_stay_bands(spark):
    ages = spark.createDataFrame([(a,) for a in [17, 18, 35, 36, 80, 81, None]], "Age int")
    got = [r[0] for r in ages.select(age_group("Age")).collect()]
    assert got == ["Under 18", "18-35", "18-35", "36-50", "66-80", "Over 80", "Over 80"]
    stays = spark.createDataFrame([(s,) for s in [-1, 2, 3, 7, 8, 14, 15, 21, 22, None]], "s int")
    got = [r[0] for r in stays.select(stay_length_group("s")).collect()]
    assert got == ["Less than 3 days", "Less than 3 days", "3-7 days", "3-7 days", "8-14 days", "8-14 days",
                   "15-21 days", "15-21 days", "More than 21 days", "More than 21 days"]


def test_risk_score_extremes_and_thresholds(spark):
    top = admission(1, "hi", D(2020, 1, 1), D(2020, 1, 16), Medical_Condition="Asthma", Insurance_Provider="Aetna",
                    Admission_Type="Emergency", Age=60, Medication="Lipitor", Test_Results="Abnormal")
    low = admission(2, "lo", D(2020, 1, 1), None, Medical_Condition="Migraine", Insurance_Provider="Self Pay",
                    Admission_Type="Newborn", Age=90, Medication="None", Test_Results="Other")
    scored = {r["Name"]: r for r in RK.score_risk(RA.flag_readmissions(admissions_df(spark, [top, low]))).collect()}
    assert (scored["hi"]["total_risk_score"], scored["hi"]["risk_category"]) == (223, "Very High Risk")
    assert (scored["lo"]["total_risk_score"], scored["lo"]["risk_category"]) == (0, "Very Low Risk")
    assert scored["lo"]["length_of_stay"] is None
    from cohortcart.functions.bands import risk_category
    scores = spark.createDataFrame([(s,) for s in [180, 179, 140, 139, 100, 99, 60, 59]], "s int")
    got = [r[0] for r in scores.select(risk_category("s")).collect()]
    assert got == ["Very High Risk", "High Risk", "High Risk", "Moderate Risk", "Moderate Risk", "Low Risk",
                   "Low Risk", "Very Low Risk"]


def test_impute_mean(spark):
    rows = [admission(i, "x", D(2020, 1, 1), None, Billing_Amount=b)
            for i, b in [(1, Decimal("10.00")), (2, Decimal("20.00")), (3, None)]]
    out = Q.impute_mean(admissions_df(spark, rows), "Billing_Amount")
    assert out.columns == [f.name for f in ADMISSIONS_SCHEMA.fields]
    assert sorted(r[0] for r in out.select("Billing_Amount").collect()) == [Decimal("10.00"), Decimal("15.00"),
                                                                           Decimal("20.00")]


def test_missing_audit_on_empty_table_is_null(spark):
    empty = spark.createDataFrame([], ADMISSIONS_SCHEMA)
    row = Q.missing_audit(empty, ["Name", "Age"]).collect()[0]
    assert row.asDict() == {"Missing_Name": None, "Missing_Age": None}


def test_risk_job_appends_and_alerts(spark, tmp_location):
    rows = [admission(1, "hi", D(2020, 1, 1), D(2020, 1, 16), Medical_Condition="Asthma", Insurance_Provider="Aetna",
                      Admission_Type="Emergency", Age=60, Medication="Lipitor", Test_Results="Abnormal"),
            admission(2, "mid", D(2020, 1, 1), D(2020, 1, 3), Medical_Condition="Cancer", Age=40),
            admission(3, "lo", D(2020, 2, 1), None)]
    adm = admissions_df(spark, rows)
    tables = dict(risk_table="risk_t", alerts_table="alerts_t", location=tmp_location)
    first = run_risk_batch(spark, adm, "2021-03-04 10:15:00", **tables)
    assert spark.table("risk_t").count() == 3
    assert spark.table("alerts_t").count() == 1
    second = run_risk_batch(spark, adm, "2021-03-04 11:00:00", **tables)
    risk = spark.table("risk_t")
    assert risk.count() == 6 and second.first_risk_id == 3
    assert sorted(r[0] for r in risk.select("ID").collect()) == [1, 2, 3, 4, 5, 6]
    alerts = spark.table("alerts_t").orderBy("ID").collect()
    # the second run on the same day alerts again for both runs' rows
    assert [a["ID"] for a in alerts] == [1, 2, 3]
    assert alerts[0]["AlertMessage"] == ("Patient identified as Very High Risk for 30-day readmission. "
                                         "Consider enhanced follow-up.")
    assert first.run_ts == "2021-03-04 10:15:00"
    dist = {r["RiskCategory"]: (r["PatientCount"], r["Percentage"])
            for r in RK.risk_distribution(risk).collect()}
    assert dist["Very High Risk"] == (2, 33)


def tx_df(spark, rows):
    full = []
    for customer, invoice, qty, total in rows:
        full.append((invoice, "s1", "d", qty, dt.datetime(2001, 5, 1), Decimal("1.00000"), customer, "X",
                     Decimal(str(total))))
    return spark.createDataFrame(full, TRANSACTIONS_SCHEMA)


def test_returns_only_customer_absent_from_rfm(spark):
    df = tx_df(spark, [(1, "i1", 2, 10), (2, "i2", -1, -5), (2, "i3", -3, -7)])
    assert [r["CustomerID"] for r in RFM.rfm_values(df, "2002-01-01").collect()] == [1]


def test_segment_boundaries(spark):
    totals = [2000, 1999.5, 1999, 800, 799.5, 799, 400, 399.99, -5]
    df = spark.createDataFrame([(Decimal(str(t)),) for t in totals], "t decimal(38,5)")
    got = [r[0] for r in df.select(sales_segment("t")).collect()]
    assert got == ["High Value", "Dormant", "Medium Value", "Medium Value", "Dormant", "Low Value", "Low Value",
                   "Dormant", "Dormant"]


def test_ntile_small_inputs(spark):
    seven = spark.range(7).withColumnRenamed("id", "k")
    sizes = [r[1] for r in ntile(seven, 5, [("k", True)], "t").groupBy("t").count().orderBy("t").collect()]
    assert sizes == [2, 2, 1, 1, 1]
    three = spark.range(3).withColumnRenamed("id", "k")
    assert [r["t"] for r in ntile(three, 5, [("k", True)], "t").orderBy("k").collect()] == [1, 2, 3]
    assert ntile(three.where("k < 0"), 5, [("k", True)], "t").count() == 0


def test_integer_average_truncates(spark):
    df = tx_df(spark, [(1, "i1", 1, 10), (2, "i2", 1, 10), (2, "i3", 1, 10)])
    row = S.customer_behaviour(df).collect()[0]
    assert row["AvgInvoicesPerCustomer"] == 1 and row["TotalCustomers"] == 2
    assert row["AvgSpentPerCustomer"] == Decimal("15.000000")


def test_distinct_counts_keep_a_null_group(spark):
    from cohortcart.operators.aggregates import grouped_with_distinct
    df = spark.createDataFrame([("a", "i1", 1), ("a", "i1", 2), ("a", "i2", None), (None, "i3", 3), (None, None, 4)],
                               "g string, inv string, c int")
    out = grouped_with_distinct(df, {"g": F.col("g")}, {"n_inv": "inv", "n_c": "c"},
                                [F.count(F.lit(1)).alias("rows")])
    got = {r["g"]: (r["rows"], r["n_inv"], r["n_c"]) for r in out.collect()}
    assert got == {"a": (3, 2, 2), None: (2, 1, 2)}
    expand = df.groupBy("g").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("inv").alias("n_inv"),
                                 F.count_distinct("c").alias("n_c"))
    assert {r["g"]: (r["rows"], r["n_inv"], r["n_c"]) for r in expand.collect()} == got


def test_risk_job_continues_ids_of_rows_at_an_existing_location(spark, tmp_location):
    """After a restart an in-memory catalog has forgotten the tables; re-creating them over the
    same location re-attaches the stored rows, and IDs must continue after them."""
    rows = [admission(1, "a", D(2020, 1, 1), D(2020, 1, 3)), admission(2, "b", D(2020, 1, 2), D(2020, 1, 4))]
    adm = admissions_df(spark, rows)
    tables = dict(risk_table="risk_r", alerts_table="alerts_r", location=tmp_location)
    run_risk_batch(spark, adm, "2021-01-01 09:00:00", **tables)
    spark.sql("DROP TABLE risk_r")              # external tables: the files stay
    spark.sql("DROP TABLE alerts_r")
    second = run_risk_batch(spark, adm, "2021-01-02 09:00:00", **tables)
    assert second.first_risk_id == 2
    assert sorted(r[0] for r in spark.table("risk_r").select("ID").collect()) == [1, 2, 3, 4]


def plain_flag(df, ties):
    """The flag from a plain window per patient, in the same total order."""
    from pyspark.sql import Window
    w = Window.partitionBy("Name").orderBy(F.col("Date_of_Admission").asc_nulls_first(),
                                           *[F.col(c).asc_nulls_first() for c in ties])
    gap = F.datediff("next_admission", "Discharge_Date")
    return (df.withColumn("next_admission", F.lead("Date_of_Admission").over(w))
            .withColumn("days_until_readmission", gap)
            .withColumn("is_readmission", F.when(gap.between(1, 30), 1).otherwise(0)))


def same_rows(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


def test_flag_with_null_repeated_and_no_ids(spark):
    """Ties are broken by all columns, so every input has one answer."""
    from tests.conftest import SF_SMALL
    from cohortcart.sources import fixtures as FX
    adm = FX.admissions(spark, SF_SMALL).withColumn("Date_of_Admission", F.date_trunc("month", "Date_of_Admission").cast("date"))
    adm = adm.unionByName(adm.where("Admission_ID % 5 = 0"))                     # repeated rows
    variants = {
        "null": adm.withColumn("Admission_ID", F.lit(None).cast("long")),
        "constant": adm.withColumn("Admission_ID", F.lit(7).cast("long")),
        "some": adm.withColumn("Admission_ID", F.when(F.col("Admission_ID") % 2 == 0, F.col("Admission_ID") % 10)),
        "none": adm.drop("Admission_ID"),
        "hot": adm.withColumn("Name", F.when(F.col("Admission_ID") % 3 == 0, F.lit("hot")).otherwise(F.col("Name"))),
    }
    for name, df in variants.items():
        plain = plain_flag(df, RA.tie_columns(df))
        assert same_rows(RA.flag_readmissions(df), plain), name
        rate = RA.readmission_rate(df, "Medical_Condition", sort=False)
        assert same_rows(rate, RA.rate_from_flags(plain, "Medical_Condition", sort=False)), name


def test_rates_of_all_dimensions_equal_the_single_ones(spark):
    from tests.conftest import SF_SMALL
    from cohortcart.sources import fixtures as FX
    adm = FX.admissions(spark, SF_SMALL)
    dims = {c: F.col(c) for c in ("Medical_Condition", "Medication", "Test_Results")}
    together = RA.readmission_rates(adm, dims).collect()
    for dim in dims:
        single = [tuple(r) for r in RA.readmission_rate(adm, dim, sort=False).collect()]
        assert sorted(map(str, single)) == sorted(str(tuple(r)[1:]) for r in together if r["dimension"] == dim)


def test_names_may_be_compared_without_case(spark):
    df = admissions_df(spark, [admission(1, "Ann", D(2020, 1, 1), D(2020, 1, 2)),
                               admission(2, "ANN", D(2020, 1, 10), D(2020, 1, 11))])
    apart = RA.flag_readmissions(df).agg(F.sum("is_readmission")).first()[0]
    together = RA.flag_readmissions(df, same_person=F.lower).agg(F.sum("is_readmission")).first()[0]
    assert (apart, together) == (0, 1)
    assert RA.readmission_rate(df, "Name", sort=False, same_person=F.lower).agg(F.sum("readmissions")).first()[0] == 1


def test_columns_may_have_other_names(spark):
    names = {"Name": "who", "Date_of_Admission": "came", "Discharge_Date": "left", "Medical_Condition": "why",
             "Admission_ID": "no", "Age": "years"}
    df = admissions_df(spark, [admission(1, "a", D(2020, 1, 1), D(2020, 1, 2), Age=40),
                               admission(2, "a", D(2020, 1, 10), D(2020, 1, 11), Age=40)]).withColumnsRenamed(names)
    who = dict(patient="who", admitted="came", discharged="left")
    out = RA.readmissions(RA.flag_readmissions(df, **who, admission_id="no"), **who, condition="why").collect()
    assert [(r["who"], r["days_until_readmission"]) for r in out] == [("a", 8)]
    assert RA.rate_by_stay(df, patient="who", admitted="came", discharged="left", admission_id="no").first()[2] == 1
    assert RA.rate_by_age(df, age="years", **who, admission_id="no").first()["readmissions"] == 1


def test_repeated_run_of_a_date_leaves_one_set_of_rows(spark, tmp_location):
    adm = admissions_df(spark, [admission(i, f"p{i}", D(2020, 1, 1), D(2020, 1, 16), Medical_Condition="Asthma",
                                          Insurance_Provider="Aetna", Admission_Type="Emergency", Age=60,
                                          Medication="Lipitor", Test_Results="Abnormal") for i in range(5)])
    tables = dict(risk_table="risk_d", alerts_table="alerts_d", location=tmp_location, by_run_date=True)
    run_risk_batch(spark, adm, "2021-03-04 10:15:00", **tables)
    run_risk_batch(spark, adm, "2021-03-05 10:15:00", **tables)
    once = [sorted(map(str, spark.table(t).collect())) for t in ("risk_d", "alerts_d")]
    run_risk_batch(spark, adm, "2021-03-05 10:15:00", **tables)                 # tried again
    assert [sorted(map(str, spark.table(t).collect())) for t in ("risk_d", "alerts_d")] == once
    assert sorted(r["ID"] for r in spark.table("risk_d").collect()) == list(range(1, 11))
    for table in ("risk_d", "alerts_d"):                                        # a catalog that forgot the tables
        spark.sql(f"DROP TABLE {table}")
    run_risk_batch(spark, adm, "2021-03-05 10:15:00", **tables)
    assert [sorted(map(str, spark.table(t).collect())) for t in ("risk_d", "alerts_d")] == once
    plan = spark.table("risk_d").where("run_date = DATE '2021-03-05'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(run_date" in plan


def test_checkpoint_folder(spark, monkeypatch):
    """A configured folder is used; without one only a local master may fall back to its own."""
    from cohortcart import session
    assert session.ensure_checkpoint_dir(spark)

    class Context:
        folder = None

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, path):
            self.folder = path

    class Session:
        def __init__(self, **conf):
            self.sparkContext = Context()
            self.conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: conf.get(key, default))})

    cluster = {"spark.master": "spark://host:7077"}
    assert session.ensure_checkpoint_dir(Session(**cluster, **{"spark.checkpoint.dir": "hdfs:///c"})) == "hdfs:///c"
    assert session.ensure_checkpoint_dir(Session(**{"spark.master": "local[4]"})).startswith("/tmp/")
    try:
        session.ensure_checkpoint_dir(Session(**cluster))
    except RuntimeError:
        pass
    else:
        raise AssertionError("no folder on a cluster must raise")


def test_scoring_job_command_line(spark, tmp_location):
    from cohortcart.plans.jobs import main
    rows = [admission(1, "a", D(2020, 1, 1), D(2020, 1, 3)), admission(2, "a", D(2020, 1, 10), D(2020, 1, 12))]
    admissions_df(spark, rows).write.parquet(f"{tmp_location}/adm")
    result = main(["--admissions", f"{tmp_location}/adm", "--location", tmp_location,
                   "--run-ts", "2021-05-06 07:08:09", "--risk-table", "cli_risk", "--alerts-table", "cli_alerts"])
    assert result.run_ts == "2021-05-06 07:08:09"
    stored = spark.table("cli_risk").collect()
    assert len(stored) == 2 and {str(r["CalculationDate"]) for r in stored} == {"2021-05-06 07:08:09"}

_ROW = st.tuples(st.sampled_from(["a", "b", "c", None]),                  # patient (NULL is one patient)
                 st.one_of(st.none(), st.integers(0, 40)),                # admission day (NULL allowed)
                 st.one_of(st.none(), st.integers(-3, 12)))               # stay (negative and NULL allowed)


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(_ROW, min_size=1, max_size=40))
def test_day_table_flag_equals_the_window_flag(spark, rows):
    """The skew-safe day-table plan equals LEAD over PARTITION BY patient on any data."""
    base = D(2020, 1, 1)
    data = []
    for i, (name, day, stay) in enumerate(rows):
        admitted = None if day is None else base + dt.timedelta(days=day)
        discharged = None if admitted is None or stay is None else admitted + dt.timedelta(days=stay)
        data.append(admission(i, name, admitted, discharged))
    df = admissions_df(spark, data)
    cols = ["Admission_ID", "next_admission", "days_until_readmission", "is_readmission"]
    ours = sorted(map(tuple, RA.flag_readmissions(df).select(cols).collect()))
    plain = sorted(map(tuple, plain_flag(df, ["Admission_ID"]).select(cols).collect()))
    assert ours == plain
