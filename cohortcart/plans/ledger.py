"""Ranges of record numbers, reserved before rows are written.

A *ledger* stands beside a table whose rows are numbered by the runs that write them.  A run asks for
``count`` numbers under a run key (its date); the answer is written to the ledger first, the rows after.
A range once given is never given again: a run that is repeated gets its own range back if it needs no
more numbers than before, and a fresh range behind all others if it does.  So dates may come in any
order, be filled in later or be run again, and no number ever appears twice.  The largest number given
is the ledger's, so no run has to look for it in the table.

The ledger is a small table (one row per reservation) of one file each, written by Spark, so it lives
wherever the table's storage is.  A table that already holds rows without a ledger is taken over with
one scan for its largest number.

Reservations are made by one writer per table at a time, as the tables themselves are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER_COLUMNS = "run_key STRING, first_id BIGINT, reserved BIGINT, reservation BIGINT"
TAKEN_OVER = ""                    # run key of the numbers a table held before it had a ledger


@dataclass(frozen=True)
class Range:
    """``count`` numbers from ``first``."""

    first: int
    count: int

    @property
    def before(self) -> int:
        """The number that the range's first follows."""
        return self.first - 1


def ledger_name(table: str) -> str:
    return f"{table}_ids"


def reservations(spark: SparkSession, table: str) -> DataFrame:
    """``run_key, first_id, reserved, reservation`` of all ranges given for ``table``; the last reservation
    of a run key is the one in force."""
    return spark.table(ledger_name(table))


def open_ledger(spark: SparkSession, table: str, location: str | None = None) -> None:
    """Creates the ledger of ``table`` if there is none, at ``location`` when given."""
    name = ledger_name(table)
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({LEDGER_COLUMNS}) USING parquet{where}")
    if reservations(spark, table).isEmpty():
        held = spark.table(table).agg(F.max("ID")).first()[0]
        if held:
            _write(spark, name, TAKEN_OVER, Range(1, held), 0)


def _write(spark: SparkSession, name: str, run_key: str, given: Range, reservation: int) -> None:
    row = spark.createDataFrame([(run_key, given.first, given.count, reservation)], LEDGER_COLUMNS)
    row.coalesce(1).write.insertInto(name)


def reserve(spark: SparkSession, table: str, run_key: str, count: int) -> Range:
    """The range of ``count`` numbers for ``run_key``: its range in force if that is long enough, else a
    fresh one behind all ranges given so far."""
    known = reservations(spark, table)
    mine = known.where(F.col("run_key") == run_key).agg(
        F.max_by(F.struct("first_id", "reserved"), "reservation").alias("last")).first()["last"]
    if mine is not None and mine["reserved"] >= count:
        return Range(mine["first_id"], mine["reserved"])
    end = known.agg(F.max(F.col("first_id") + F.col("reserved")).alias("end"), F.max("reservation").alias("r")).first()
    given = Range(end["end"] or 1, count)
    _write(spark, ledger_name(table), run_key, given, (end["r"] if end["r"] is not None else 0) + 1)
    return given
