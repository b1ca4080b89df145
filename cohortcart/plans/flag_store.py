"""Readmission flags kept as a table that new admissions are added to.

A flag depends on the patient's next admission only, so of all stored rows just the *tail* of a patient
(the last admission so far) can change when later admissions arrive.  ``add`` therefore reads the tails of
the patients that the batch names, flags those rows together with the batch, and appends the result.

Layout under ``location`` (shared storage)::

    rows/flag_version=<version>/flag_state=<closed|tail|undated>/    the rows that one batch wrote
    ledger/                                                          generation, version, rebuilt buckets

Every row carries its generation and a bucket (hash of the patient); files are sorted by bucket, so a
filter on buckets skips row groups.  A row is in force from the last generation that rebuilt its bucket
on, and a tail only while its patient has no newer tail.

Late batches.  A batch may also hold admissions before a patient's tail, or without a date.  The buckets of
such patients are then read whole, flagged again and written anew; all other buckets go on by their tails.

Flagging.  Rows are dealt by bucket once, and that same order serves ``LEAD`` per patient, the sort of the
files and the write.  Patients with more than ``CROWDED`` rows are flagged by ``flag_readmissions``, which
never holds a patient in one task.  Rows are counted by ``GROUPS`` hashes of the patient first; patients are
counted only in groups that pass the bound.  Where rows are so many that buckets grow large, buckets are
dealt in parts.

Readers follow the ledger, whose row is written after the rows: they see the state before or after a batch,
and a batch that died is simply added again.  Generations whose every bucket was rebuilt since are not opened
any more.  Only the ledger (one row per batch, back to the last
``compact``) and bucket numbers reach the driver.  One ``add`` at a time per location.

Defined cases: NULL patients form one patient; rows without a date come before all others (``undated`` where no
admission follows); repeated rows count as often as they come; an empty batch changes nothing.  Column
names ``flag_state``, ``flag_version``, ``flag_generation`` and ``flag_bucket`` are taken.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.utils import AnalysisException

from cohortcart.operators.readmission import ADMISSION_ID, flag_readmissions, flags_after, tie_columns
from cohortcart.session import stored

LEDGER_SCHEMA = "generation INT, version STRING, rebuilt ARRAY<INT>, whole BOOLEAN"
CLOSED, TAIL, UNDATED = "closed", "tail", "undated"
BUCKETS = 1024
CROWDED = 100_000            # rows of a patient that one task may order
GROUPS = 65_536              # hashes of the patient by which rows are counted
BUCKET_ROWS = 1_000_000      # rows of a bucket (on average) that are dealt as one part
HELPERS = StructType([StructField("flag_generation", IntegerType()), StructField("flag_bucket", LongType()),
                      StructField("flag_version", StringType()), StructField("flag_state", StringType())])


@dataclass(frozen=True)
class Names:
    """The columns that say who was admitted when, and what makes two names one person."""

    patient: str = "Name"
    admitted: str = "Date_of_Admission"
    same_person: Callable[[Column], Column] | None = None

    def person(self) -> Column:
        name = F.col(self.patient)
        return self.same_person(name) if self.same_person else name

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.person()), F.lit(BUCKETS).cast("long"))


def _folder(location: str, version: str) -> str:
    return f"{location}/rows/flag_version={version}"


def _ledger(spark: SparkSession, location: str) -> list:
    """Ledger rows by generation, from the last one that wrote the whole table on, and without those that all
    buckets have left behind."""
    try:
        rows = spark.read.schema(LEDGER_SCHEMA).parquet(f"{location}/ledger").orderBy("generation").collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    start = max((k for k, r in enumerate(rows) if r["whole"]), default=0)
    since = _since(rows[start:])
    oldest = min(since.get(b, 0) for b in range(BUCKETS))
    return [r for r in rows[start:] if r["generation"] >= oldest]


def _since(ledger: list) -> dict[int, int]:
    """The last generation that rebuilt a bucket, for those that were rebuilt."""
    since = {}
    for r in ledger:
        since |= dict.fromkeys(r["rebuilt"], r["generation"])
    return since


def _append(spark: SparkSession, location: str, generation: int, version: str, rebuilt: list[int], whole: bool) -> None:
    row = spark.createDataFrame([(generation, version, rebuilt, whole)], LEDGER_SCHEMA)
    row.coalesce(1).write.mode("append").parquet(f"{location}/ledger")


def _in_force(spark: SparkSession, location: str, ledger: list, columns: StructType) -> DataFrame:
    """All rows whose bucket was not rebuilt by a later generation (tails: newest and older ones)."""
    schema = StructType([*columns.fields, *HELPERS.fields])
    rows = (spark.read.schema(schema).option("basePath", f"{location}/rows")
            .parquet(*[_folder(location, r["version"]) for r in ledger]))
    since = _since(ledger)
    if since and len(ledger) > 1:
        # one literal array with a place per bucket, so that a row's bound is found in one step
        bounds = F.split(F.lit(",".join(str(since.get(b, 0)) for b in range(BUCKETS))), ",").cast("array<int>")
        rows = rows.where(F.col("flag_generation") >= F.get(bounds, F.col("flag_bucket").cast("int")))
    return rows


def _newest(tails: DataFrame, names: Names, generations: int) -> DataFrame:
    """The newest tail of each patient: one narrow aggregate, and a join only where there are generations."""
    if generations == 1:
        return tails
    last = tails.groupBy(names.person().alias("_lp")).agg(F.max("flag_generation").alias("_lg"))
    return tails.join(last, names.person().eqNullSafe(F.col("_lp")) & (F.col("flag_generation") == F.col("_lg")), "left_semi")


def _columns(spark: SparkSession, location: str, ledger: list) -> StructType:
    found = spark.read.parquet(_folder(location, ledger[0]["version"])).schema
    return StructType([f for f in found.fields if f.name not in HELPERS.names])


def _state(spark: SparkSession, location: str, ledger: list, columns: StructType, names: Names) -> DataFrame:
    rows = _in_force(spark, location, ledger, columns)
    tails = _newest(rows.where(F.col("flag_state") == TAIL), names, len(ledger))
    return rows.where(F.col("flag_state") != TAIL).unionByName(tails)


def read(spark: SparkSession, location: str, names: Names = Names()) -> DataFrame:
    """The admissions added so far with ``next_admission``, ``days_until_readmission`` and ``is_readmission``, as
    ``flag_readmissions`` over all of them would give."""
    ledger = _ledger(spark, location)
    if not ledger:
        raise ValueError(f"no flags stored at {location}")
    return _state(spark, location, ledger, _columns(spark, location, ledger), names).drop(*HELPERS.names)


def _write(flagged: DataFrame, path: str, generation: int, names: Names, dealt: bool = False) -> None:
    """Appends flagged rows with their state.  Rows not ``dealt`` by bucket are rebalanced by it: Spark splits
    the bucket of a patient with very many rows and merges small ones."""
    open_end = F.col("next_admission").isNull()
    state = (F.when(open_end & F.col(names.admitted).isNotNull(), TAIL).when(open_end, UNDATED).otherwise(CLOSED))
    rows = flagged.select("*", F.lit(generation).alias("flag_generation"),
                          *([] if dealt else [names.bucket().alias("flag_bucket")]), state.alias("flag_state"))
    rows = rows if dealt else rows.hint("rebalance", "flag_bucket")
    rows.sortWithinPartitions("flag_state", "flag_bucket").write.mode("append").partitionBy("flag_state").parquet(path)


def _group(person: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(GROUPS), person), F.lit(GROUPS)).alias("_g")


def _by_lead(rows: DataFrame, parts: int, names: Names, discharged: str = "Discharge_Date",
             admission_id: str | None = ADMISSION_ID, lo: int = 1, hi: int = 30, **_) -> DataFrame:
    """``flag_readmissions`` over rows dealt by bucket, with the bucket: ``LEAD`` in the order of day and tie
    columns."""
    deal = [F.col("flag_bucket")]
    if parts > 1:
        deal.append(F.pmod(F.xxhash64(F.lit(parts), names.person()), F.lit(parts)))
    order = [names.admitted, *tie_columns(rows, names.patient, names.admitted, admission_id)]
    dealt = rows.withColumn("flag_bucket", names.bucket()).repartition(*deal)
    following = F.lead(names.admitted).over(
        Window.partitionBy(*deal, names.person()).orderBy(*[F.col(c).asc_nulls_first() for c in order]))
    flagged = flags_after(dealt.withColumn("next_admission", following), discharged, lo, hi)
    return flagged.select(*rows.columns, "next_admission", "days_until_readmission", "is_readmission", "flag_bucket")


def _flag(rows: DataFrame, counts: DataFrame, path: str, generation: int, names: Names, options: dict) -> None:
    """Flags ``rows`` and writes them.  ``counts`` (``_g, _n``) add up to at least the rows of each group."""
    many = F.col("_n") > CROWDED
    groups = counts.groupBy("_g").agg(F.sum("_n").alias("_n"))
    total, crowded = groups.agg(F.sum("_n"), F.count_if(many)).first()
    parts = -(-total // (BUCKETS * BUCKET_ROWS))
    if crowded:
        some = stored(groups.where(many).select("_g"), "crowded-groups")
        found = rows.select(names.person().alias("_p")).withColumn("_g", _group(F.col("_p"))).join(some, "_g", "left_semi")
        chosen = stored(found.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).where(many).select("_p"), "crowded")
        crowded = not chosen.isEmpty()
    if not crowded:
        return _write(_by_lead(rows, parts, names, **options), path, generation, names, dealt=True)
    same = names.person().eqNullSafe(F.col("_p"))
    _write(_by_lead(rows.join(chosen, same, "left_anti"), parts, names, **options), path, generation, names, dealt=True)
    few = stored(rows.join(chosen, same, "left_semi"), "to-flag")
    _write(flag_readmissions(few, **options), path, generation, names)


def _late_buckets(touched: DataFrame, rows: DataFrame, tails: DataFrame, names: Names) -> list[int]:
    """Buckets with a touched patient whose new rows do not all follow the tail.  At most ``BUCKETS`` numbers."""
    person = names.person()
    ends = tails.select(person.alias("_tp"), F.col(names.admitted).alias("_td"))
    undated = rows.where(F.col("flag_state") == UNDATED).select(person.alias("_up")).distinct()
    early = (touched.join(ends, F.col("_p").eqNullSafe(F.col("_tp")))
             .where(F.col("_undated") | (F.col("_first") < F.col("_td"))).select("_b"))
    # patients known by rows without a date: whether one of them is the last is seen in the whole bucket
    floating = touched.join(undated, F.col("_p").eqNullSafe(F.col("_up")), "left_semi").select("_b")
    return sorted(r[0] for r in early.unionByName(floating).distinct().collect())


def add(batch: DataFrame, location: str, names: Names = Names(), **options) -> list[int]:
    """Adds the admissions of ``batch`` to the flags at ``location``; returns the buckets that were rebuilt.

    ``options`` go to ``flag_readmissions`` (``discharged``, ``admission_id``, ``lo``, ``hi``) and must be the
    same each time, as must the columns."""
    spark = batch.sparkSession
    ledger = _ledger(spark, location)
    options |= {"patient": names.patient, "admitted": names.admitted, "same_person": names.same_person}
    version = uuid.uuid4().hex[:12]
    path = _folder(location, version)
    if not ledger:
        if not batch.isEmpty():
            _flag(batch, batch.select(_group(names.person()), F.lit(1).alias("_n")), path, 1, names, options)
            _append(spark, location, 1, version, [], True)
        return []
    generation = ledger[-1]["generation"] + 1
    admitted = F.col(names.admitted)
    touched = stored(batch.groupBy(names.person().alias("_p")).agg(
        F.min(admitted).alias("_first"), F.max(admitted.isNull()).alias("_undated"),
        F.min(names.bucket()).alias("_b"), F.count(F.lit(1)).alias("_n")), "touched")
    buckets = [r[0] for r in touched.select("_b").distinct().collect()]
    if not buckets:
        return []
    columns = _columns(spark, location, ledger)
    rows = _in_force(spark, location, ledger, columns)
    if len(buckets) < BUCKETS // 2:
        rows = rows.where(F.col("flag_bucket").isin(buckets))          # reaches the scan
    mine = rows.where(F.col("flag_state") != CLOSED).join(touched, names.person().eqNullSafe(F.col("_p")), "left_semi")
    mine = stored(mine, "touched-rows")
    tails = _newest(mine.where(F.col("flag_state") == TAIL), names, len(ledger))
    late = _late_buckets(touched, mine, tails, names)
    old = tails.where(~F.col("flag_bucket").isin(late)) if late else tails
    work = old.select(*batch.columns).unionByName(batch)
    counts = touched.select(_group(F.col("_p")), (F.col("_n") + 1).alias("_n"))          # one for the tail
    if late:
        whole = _state(spark, location, ledger, columns, names).where(F.col("flag_bucket").isin(late))
        work = work.unionByName(whole.select(*batch.columns))
        before = rows.where(F.col("flag_bucket").isin(late))                              # older tails included
        counts = counts.unionByName(before.select(_group(names.person()), F.lit(1).alias("_n")))
    _flag(work, counts, path, generation, names, options)
    _append(spark, location, generation, version, [int(b) for b in late], False)
    return late


def compact(spark: SparkSession, location: str, names: Names = Names()) -> None:
    """Writes the rows in force as one generation, so that readers and batches open fewer files."""
    ledger = _ledger(spark, location)
    if len(ledger) < 2:
        return
    version, generation = uuid.uuid4().hex[:12], ledger[-1]["generation"] + 1
    _write(read(spark, location, names), _folder(location, version), generation, names)
    _append(spark, location, generation, version, [], True)
