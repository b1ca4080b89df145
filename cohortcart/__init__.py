"""cohortcart: Spark-native cohort (readmission) and customer (RFM) analytics.

Every operator takes a DataFrame and returns a DataFrame; only bounded sets
of sort keys are collected to the driver.  Subpackages:

* ``sources``   - table loaders, declared schemas, the test fixtures
* ``functions`` - Column builders: bands, rulebooks, exact rounding
* ``operators`` - the analytical operators (quality, readmission, risk, sales, rfm)
* ``plans``     - batch jobs, the query registry and plan inspection helpers
"""

__version__ = "0.1.0"
