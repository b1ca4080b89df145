"""Declared schemas of the two input tables and their loaders.

A source is either a catalog table name or a parquet path; parquet is read with
the declared schema (no inference), so column pruning and filter pushdown reach
the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import (DateType, DecimalType, IntegerType, LongType, StringType, StructField, StructType,
                               TimestampNTZType)


def _schema(*fields) -> StructType:
    return StructType([StructField(name, dtype, True) for name, dtype in fields])


ADMISSIONS_SCHEMA = _schema(
    ("Admission_ID", LongType()), ("Name", StringType()), ("Age", IntegerType()), ("Gender", StringType()),
    ("Blood_Type", StringType()), ("Medical_Condition", StringType()), ("Date_of_Admission", DateType()),
    ("Doctor", StringType()), ("Hospital", StringType()), ("Insurance_Provider", StringType()),
    ("Billing_Amount", DecimalType(18, 2)), ("Room_Number", IntegerType()), ("Admission_Type", StringType()),
    ("Discharge_Date", DateType()), ("Medication", StringType()), ("Test_Results", StringType()))

TRANSACTIONS_SCHEMA = _schema(
    ("InvoiceNo", StringType()), ("StockCode", StringType()), ("Description", StringType()),
    ("Quantity", IntegerType()), ("InvoiceDate", TimestampNTZType()), ("UnitPrice", DecimalType(18, 5)),
    ("CustomerID", LongType()), ("Country", StringType()), ("Total_Sales", DecimalType(18, 5)))

# The admission columns of the source table; Admission_ID is an added tie-breaker.
ADMISSION_AUDIT_COLUMNS = [f.name for f in ADMISSIONS_SCHEMA.fields if f.name != "Admission_ID"]
TRANSACTION_AUDIT_COLUMNS = [f.name for f in TRANSACTIONS_SCHEMA.fields]


def transaction_audit_names(columns=TRANSACTION_AUDIT_COLUMNS) -> list[str]:
    """``Null<Column>`` with underscores dropped (``Total_Sales`` -> ``NullTotalSales``)."""
    return ["Null" + c.replace("_", "") for c in columns]


def _load(spark: SparkSession, src: str, schema: StructType) -> DataFrame:
    if "/" in src or src.endswith(".parquet"):
        return spark.read.schema(schema).parquet(src)
    return spark.table(src)


def load_admissions(spark: SparkSession, src: str) -> DataFrame:
    return _load(spark, src, ADMISSIONS_SCHEMA)


def load_transactions(spark: SparkSession, src: str) -> DataFrame:
    return _load(spark, src, TRANSACTIONS_SCHEMA)
