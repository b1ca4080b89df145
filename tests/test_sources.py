"""Loaders: parquet paths with the declared schema, catalog tables by name."""

from cohortcart.sources import fixtures as FX
from cohortcart.sources.tables import (ADMISSIONS_SCHEMA, TRANSACTIONS_SCHEMA, load_admissions,
                                       load_transactions, transaction_audit_names)
from tests.conftest import SF_SMALL


def test_fixture_schemas_are_the_declared_ones(spark):
    assert FX.admissions(spark, SF_SMALL).schema.simpleString() == ADMISSIONS_SCHEMA.simpleString()
    assert FX.transactions(spark, SF_SMALL).schema.simpleString() == TRANSACTIONS_SCHEMA.simpleString()


def test_load_from_parquet_path_and_catalog(spark, tmp_location):
    FX.transactions(spark, SF_SMALL).write.parquet(f"{tmp_location}/tx")
    by_path = load_transactions(spark, f"{tmp_location}/tx")
    assert by_path.schema.simpleString() == TRANSACTIONS_SCHEMA.simpleString()
    assert by_path.count() == 6000
    spark.sql(f"CREATE TABLE project_t USING parquet LOCATION '{tmp_location}/tx'")
    assert load_transactions(spark, "project_t").count() == 6000
    FX.admissions(spark, SF_SMALL).write.parquet(f"{tmp_location}/adm")
    assert load_admissions(spark, f"{tmp_location}/adm").count() == 1500


def test_transaction_audit_names():
    assert transaction_audit_names() == ["NullInvoiceNo", "NullStockCode", "NullDescription", "NullQuantity",
                                         "NullInvoiceDate", "NullUnitPrice", "NullCustomerID", "NullCountry",
                                         "NullTotalSales"]
