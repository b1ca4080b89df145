"""The two input tables of the analyses, derived from the TPC-H-like test parquet.

``admissions`` stands for the hospital table (one row per order) and
``transactions`` for the sales table (one row per line item).  The same rules are
emitted twice: as a Spark plan (``admissions`` / ``transactions``) and as SQL text
(``admissions_sql`` / ``transactions_sql``) for the DuckDB oracle.  Both are built
from the value lists below so they cannot drift apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values (must stay exactly as listed: they define the fixture data) ----------
GENDERS = ["Female", "Male"]                                        # o_custkey % 2
BLOOD_TYPES = ["A+", "A-", "B+", "B-", "AB+", "AB-", "O+", "O-"]    # o_custkey % 8
CONDITIONS = ["Asthma", "Obesity", "Diabetes", "Arthritis",
              "Hypertension", "Cancer", "Migraine", None]           # (o_orderkey*31 + o_custkey*17) % 8
INSURERS = ["Aetna", "UnitedHealthcare", "Cigna", "Blue Cross",
            "Medicare", "Self Pay"]                                 # c_nationkey % 6
MEDICATIONS = ["Lipitor", "Paracetamol", "Aspirin", "Ibuprofen",
               "Penicillin", "None"]                                # (o_orderkey + o_custkey) % 6
ADMISSION_TYPES = [("1-URGENT", "Emergency"), ("2-HIGH", "Urgent"),
                   ("3-MEDIUM", "Elective")]                        # o_orderpriority, else Newborn
ADMISSION_TYPE_ELSE = "Newborn"
TEST_RESULTS = [("F", "Normal"), ("O", "Abnormal")]                 # o_orderstatus, else Inconclusive
TEST_RESULT_ELSE = "Inconclusive"
SALES_SCALE = "0.001"                                               # brings totals into the 400/800/2000 bands
AS_OF = "2002-01-01"                                                # fixed "today" of the fixtures
RUN_TS = f"{AS_OF} 10:15:00"                                        # fixed run time of the scoring job
SECOND_RUN_TS = "2002-01-02 09:30:00"                               # a later run in the same table
# -----------------------------------------------------------------------------------------


def _pick(index: Column, values: list) -> Column:
    expr = None
    for i, v in enumerate(values):
        if v is None:
            continue
        expr = (F.when(index == i, F.lit(v)) if expr is None else expr.when(index == i, F.lit(v)))
    return expr


def _pick_sql(index: str, values: list) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v is not None)
    return f"CASE {index} {arms} END"


def _map(col: Column, pairs: list, default: str) -> Column:
    expr = None
    for k, v in pairs:
        expr = F.when(col == k, F.lit(v)) if expr is None else expr.when(col == k, F.lit(v))
    return expr.otherwise(F.lit(default))


def _map_sql(col: str, pairs: list, default: str) -> str:
    arms = " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in pairs)
    return f"CASE {arms} ELSE '{default}' END"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One admission per order; the patient is the customer name."""
    o = _read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    j = o.join(c, o.o_custkey == c.c_custkey, "inner")
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    admitted = F.col("o_orderdate").cast("date")
    return j.select(
        ok.alias("Admission_ID"),
        F.col("c_name").alias("Name"),
        F.when(ck % 89 == 0, F.lit(None)).otherwise(1 + (ck * 7) % 95).cast("int").alias("Age"),
        _pick(ck % 2, GENDERS).alias("Gender"),
        _pick(ck % 8, BLOOD_TYPES).alias("Blood_Type"),
        _pick((ok * 31 + ck * 17) % 8, CONDITIONS).alias("Medical_Condition"),
        admitted.alias("Date_of_Admission"),
        F.concat(F.lit("Dr "), (ok % 40).cast("string")).alias("Doctor"),
        F.concat(F.lit("Hospital "), (ok % 12).cast("string")).alias("Hospital"),
        _pick(F.col("c_nationkey") % 6, INSURERS).alias("Insurance_Provider"),
        F.when(ok % 50 == 0, F.lit(None))
         .otherwise(F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(18,2)").alias("Billing_Amount"),
        (100 + ok % 400).cast("int").alias("Room_Number"),
        _map(F.col("o_orderpriority"), ADMISSION_TYPES, ADMISSION_TYPE_ELSE).alias("Admission_Type"),
        F.when(ok % 61 == 0, F.lit(None).cast("date"))
         .otherwise(F.date_add(admitted, ((ok * 13 + ck) % 31).cast("int"))).alias("Discharge_Date"),
        _pick((ok + ck) % 6, MEDICATIONS).alias("Medication"),
        _map(F.col("o_orderstatus"), TEST_RESULTS, TEST_RESULT_ELSE).alias("Test_Results"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sales line per line item; returned lines carry negative quantity and value."""
    orders = (_read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
              .join(_read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"),
                    F.col("o_custkey") == F.col("c_custkey"))
              .join(_read(spark, sf_dir, "nation").select("n_nationkey", "n_name"),
                    F.col("c_nationkey") == F.col("n_nationkey")))
    lines = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag")
    part = _read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    j = (lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
         .join(part, F.col("l_partkey") == F.col("p_partkey")))
    sign = F.when(F.col("l_returnflag") == "R", F.lit(-1)).otherwise(F.lit(1))
    factor = F.lit(SALES_SCALE).cast("decimal(4,3)")
    return j.select(
        F.col("l_orderkey").cast("string").alias("InvoiceNo"),
        F.col("l_partkey").cast("string").alias("StockCode"),
        F.when(F.col("l_partkey") % 37 == 0, F.lit(None)).otherwise(F.col("p_name")).alias("Description"),
        (F.col("l_quantity").cast("int") * sign).cast("int").alias("Quantity"),
        F.col("o_orderdate").alias("InvoiceDate"),
        (F.col("p_retailprice").cast("decimal(18,2)") * factor).cast("decimal(18,5)").alias("UnitPrice"),
        F.when(F.col("o_custkey") % 20 == 0, F.lit(None)).otherwise(F.col("o_custkey")).alias("CustomerID"),
        F.col("n_name").alias("Country"),
        (sign * F.col("l_extendedprice").cast("decimal(18,2)") * factor).cast("decimal(18,5)").alias("Total_Sales"),
    )


# ---- SQL twins for the DuckDB oracle (base tables are registered as views) -------------

def admissions_sql() -> str:
    return f"""
SELECT
  o.o_orderkey AS Admission_ID,
  c.c_name AS Name,
  CAST(CASE WHEN o.o_custkey % 89 = 0 THEN NULL ELSE 1 + (o.o_custkey * 7) % 95 END AS INTEGER) AS Age,
  {_pick_sql('o.o_custkey % 2', GENDERS)} AS Gender,
  {_pick_sql('o.o_custkey % 8', BLOOD_TYPES)} AS Blood_Type,
  {_pick_sql('(o.o_orderkey * 31 + o.o_custkey * 17) % 8', CONDITIONS)} AS Medical_Condition,
  CAST(o.o_orderdate AS DATE) AS Date_of_Admission,
  'Dr ' || CAST(o.o_orderkey % 40 AS VARCHAR) AS Doctor,
  'Hospital ' || CAST(o.o_orderkey % 12 AS VARCHAR) AS Hospital,
  {_pick_sql('c.c_nationkey % 6', INSURERS)} AS Insurance_Provider,
  CASE WHEN o.o_orderkey % 50 = 0 THEN NULL ELSE CAST(o.o_totalprice AS DECIMAL(18,2)) END AS Billing_Amount,
  CAST(100 + o.o_orderkey % 400 AS INTEGER) AS Room_Number,
  {_map_sql('o.o_orderpriority', ADMISSION_TYPES, ADMISSION_TYPE_ELSE)} AS Admission_Type,
  CASE WHEN o.o_orderkey % 61 = 0 THEN NULL
       ELSE CAST(o.o_orderdate AS DATE) + CAST((o.o_orderkey * 13 + o.o_custkey) % 31 AS INTEGER) END
    AS Discharge_Date,
  {_pick_sql('(o.o_orderkey + o.o_custkey) % 6', MEDICATIONS)} AS Medication,
  {_map_sql('o.o_orderstatus', TEST_RESULTS, TEST_RESULT_ELSE)} AS Test_Results
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"""


def transactions_sql() -> str:
    sign = "CASE WHEN l.l_returnflag = 'R' THEN -1 ELSE 1 END"
    factor = f"CAST({SALES_SCALE} AS DECIMAL(4,3))"
    return f"""
SELECT
  CAST(l.l_orderkey AS VARCHAR) AS InvoiceNo,
  CAST(l.l_partkey AS VARCHAR) AS StockCode,
  CASE WHEN l.l_partkey % 37 = 0 THEN NULL ELSE p.p_name END AS Description,
  CAST(CAST(l.l_quantity AS INTEGER) * {sign} AS INTEGER) AS Quantity,
  o.o_orderdate AS InvoiceDate,
  CAST(CAST(p.p_retailprice AS DECIMAL(18,2)) * {factor} AS DECIMAL(18,5)) AS UnitPrice,
  CASE WHEN o.o_custkey % 20 = 0 THEN NULL ELSE o.o_custkey END AS CustomerID,
  n.n_name AS Country,
  CAST({sign} * CAST(l.l_extendedprice AS DECIMAL(18,2)) * {factor} AS DECIMAL(18,5)) AS Total_Sales
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN part p ON l.l_partkey = p.p_partkey"""
