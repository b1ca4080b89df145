"""30-day readmission detection and readmission rates by any dimension.

The readmission flag of an admission needs the date of the patient's *next* admission: ``LEAD(admission
day) OVER (PARTITION BY patient ORDER BY admission day, ...)``.  That window would put one patient's whole
history (or all rows without a name) into one task.  The same value comes from a *day table*:

* rows of one patient and day are consecutive in the window order, so every row but the day's last is
  followed by a row of the same day, and the last by the patient's next day;
* the day's last row is a ``max`` per (patient, day), combined map-side;
* the next day is a ``lead`` over one row per patient and day, so its partitions are bounded by the
  calendar, not by the data.

Order.  Admissions of one patient and day are ordered by the admission id where the table has one, then
by all other columns in table order.  Only rows equal in every column stay tied, and those are
interchangeable, so NULL, repeated or missing ids are ordered as well as good ones.

Ties in two tiers.  A row's *rank* is one number made of its id and a hash of all its columns.  The day
table keeps the largest rank of each (patient, day), and the largest with the hash turned round: the
two agree exactly if all rows that share the day's largest id are equal.  These are fixed-width
numbers, so the aggregate hashes and never sorts, and whole rows do not move.  Only where they
disagree, which the write of the day table counts as it goes, are the columns of those days' rows
compared.

The day table (one narrow row per patient and day) is stored in the shared checkpoint folder: rates and
flags read it back, and a lost executor costs a re-read.  There is one plan for all sizes.  Rates need
no join with the rows: all rows are counted as if followed by the same day, and the day's last rows add
the difference that their true next day makes, by a code of their dimension values.  Row output joins
the day table to the rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from cohortcart.functions.bands import age_group, stay_length_group
from cohortcart.functions.rounding import pct_half_up
from cohortcart.session import stored

ADMISSION_ID = "Admission_ID"
HASH_BITS = 60                     # of a rank; with a BIGINT id above them it fits DECIMAL(38)


def tie_columns(df: DataFrame, patient: str = "Name", admitted: str = "Date_of_Admission",
                admission_id: str | None = ADMISSION_ID) -> list[str]:
    """Columns that order admissions of one patient and day: the id if there is one, then all others."""
    rest = [c for c in df.columns if c not in (patient, admitted)]
    return sorted(rest, key=lambda c: c != admission_id)


def _person(patient: str, same_person: Callable[[Column], Column] | None) -> Column:
    name = F.col(patient)
    return same_person(name) if same_person else name


def row_hash(columns: list[Column]) -> Column:
    """64-bit hash of the columns that also tells which of them are NULL."""
    nulls = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in columns])
    return F.xxhash64(nulls, *columns)


def _decimal(value: int) -> Column:
    return F.lit(str(value)).cast("decimal(20,0)")


def rank_columns(df: DataFrame, admission_id: str | None) -> tuple[Column, Column]:
    """A row's rank, and its rank with the hash turned round.  NULL ids rank lowest; a table without an
    integer id ranks by the hash alone, so that days with different rows count as tied."""
    h = F.shiftrightunsigned(row_hash([F.col(c) for c in df.columns]), 64 - HASH_BITS).cast("decimal(19,0)")
    top = (1 << HASH_BITS) - 1
    if admission_id in df.columns and isinstance(df.schema[admission_id].dataType, IntegralType):
        above = F.coalesce(F.col(admission_id).cast("decimal(20,0)") + _decimal((1 << 63) + 1), F.lit(0).cast("decimal(21,0)"))
    else:
        above = F.lit(0).cast("decimal(21,0)")
    base = (above * F.lit(str(1 << HASH_BITS)).cast("decimal(19,0)")).cast("decimal(38,0)")
    return (base + h).cast("decimal(38,0)"), (base + (_decimal(top) - h)).cast("decimal(38,0)")


def day_table(df: DataFrame, person: Column, admitted: str, admission_id: str | None,
              carried: dict[str, Column], ties: list[str]) -> DataFrame:
    """``_p, _d, _rank, _next_day`` and the ``carried`` columns (fixed-width) of each day's last row; one row
    per patient and day, stored."""
    rank, turned = rank_columns(df, admission_id)
    rows = df.select(person.alias("_p"), F.col(admitted).alias("_d"), rank.alias("_rank"), turned.alias("_turned"),
                     *[c.alias(name) for name, c in carried.items()])
    days = rows.groupBy("_p", "_d").agg(F.max("_rank").alias("_top"), F.max("_turned").alias("_low"),
                                        *[F.max_by(name, "_rank").alias(name) for name in carried])
    by_patient = Window.partitionBy("_p").orderBy(F.col("_d").asc_nulls_first())
    whole = F.lit(str(1 << HASH_BITS)).cast("decimal(38,0)")
    tied = (F.col("_top") + F.col("_low")) % whole != whole - 1
    days = days.withColumn("_next_day", F.lead("_d").over(by_patient)).withColumn("_tied", tied)
    seen = Observation()
    out = ["_p", "_d", F.col("_top").alias("_rank"), "_next_day", *carried]
    days = stored(days.observe(seen, F.count_if("_tied").alias("ties")).select(*out, "_tied"), "days")
    if not seen.get["ties"]:
        return days.drop("_tied")
    # the second tier: all columns are compared, for the tied days only
    some = days.where("_tied").select(F.col("_p").alias("_tp"), F.col("_d").alias("_td"))
    wide = df.select(person.alias("_p"), F.col(admitted).alias("_d"), F.struct(
        F.struct(*ties).alias("t"), rank.alias("_rank"), *[c.alias(name) for name, c in carried.items()]).alias("_t"))
    last = (wide.join(some, F.col("_p").eqNullSafe(F.col("_tp")) & F.col("_d").eqNullSafe(F.col("_td")))
            .groupBy("_tp", "_td").agg(F.max("_t").alias("_last")))
    mended = days.where("_tied").join(last, F.col("_p").eqNullSafe(F.col("_tp")) & F.col("_d").eqNullSafe(F.col("_td"))).select(
        "_p", "_d", F.col("_last._rank").alias("_rank"), "_next_day", *[F.col(f"_last.{c}").alias(c) for c in carried])
    return stored(days.where("not _tied").drop("_tied").unionByName(mended), "days")


def _copies(df: DataFrame, person: Column, admitted: str, rank: Column, days: DataFrame) -> DataFrame:
    """Days whose last row comes more than once: ``_cp, _cd, _cr`` and the number of copies ``_n``."""
    rows = df.select(person.alias("_cp"), F.col(admitted).alias("_cd"), rank.alias("_cr"))
    counts = rows.groupBy("_cp", "_cd", "_cr").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    same = F.col("_p").eqNullSafe(F.col("_cp")) & F.col("_d").eqNullSafe(F.col("_cd")) & F.col("_rank").eqNullSafe(F.col("_cr"))
    return stored(counts.join(days.select("_p", "_d", "_rank"), same, "left_semi"), "copies")


def flags_after(df: DataFrame, discharged: str, lo: int, hi: int) -> DataFrame:
    """``days_until_readmission`` and ``is_readmission`` of rows with ``next_admission``."""
    gap = F.datediff(F.col("next_admission"), F.col(discharged))
    return (df.withColumn("days_until_readmission", gap)
            .withColumn("is_readmission", F.when(gap.between(lo, hi), 1).otherwise(0)))


def flag_readmissions(df: DataFrame, patient: str = "Name", admitted: str = "Date_of_Admission",
                      discharged: str = "Discharge_Date", admission_id: str | None = ADMISSION_ID,
                      lo: int = 1, hi: int = 30,
                      same_person: Callable[[Column], Column] | None = None) -> DataFrame:
    """Add ``next_admission``, ``days_until_readmission`` and ``is_readmission`` to every admission.

    ``days_until_readmission`` = days from this discharge to the next admission (NULL for the last stay or
    a missing discharge); ``is_readmission`` = 1 when it lies in ``[lo, hi]``, else 0.  NULL patients form
    one patient, as in ``PARTITION BY``.  ``same_person`` maps names to what identifies a person, e.g.
    ``F.lower`` to ignore case.  Of rows that are equal in every column one is the day's last.
    """
    person = _person(patient, same_person)
    rank, _ = rank_columns(df, admission_id)
    days = day_table(df, person, admitted, admission_id, {}, tie_columns(df, patient, admitted, admission_id))
    copies = _copies(df, person, admitted, rank, days)
    ranked = df.select("*", person.alias("_person"), rank.alias("_own"))
    joined = ranked.join(days, F.col("_person").eqNullSafe(F.col("_p")) & F.col(admitted).eqNullSafe(F.col("_d")))
    last = F.col("_own") == F.col("_rank")
    followed = joined.select(*df.columns, "_person", "_own", "_next_day", last.alias("_last"))
    if not copies.isEmpty():
        # equal rows: one is followed by the next day, the others by the same day
        same = (F.col("_person").eqNullSafe(F.col("_cp")) & F.col(admitted).eqNullSafe(F.col("_cd"))
                & F.col("_own").eqNullSafe(F.col("_cr")))
        one = followed.join(copies, same).groupBy(*df.columns, "_next_day").agg(F.count(F.lit(1)).alias("_n"))
        each = one.select(*df.columns, "_next_day", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_k"))
        followed = followed.join(copies, same, "left_anti").select(*df.columns, "_next_day", "_last").unionByName(
            each.select(*df.columns, "_next_day", (F.col("_k") == 1).alias("_last")))
    return flags_after(followed.select(*df.columns, F.when(F.col("_last"), F.col("_next_day")).otherwise(F.col(admitted)).alias("next_admission")),
                       discharged, lo, hi)


def readmissions(flagged: DataFrame, lo: int = 1, hi: int = 30, patient: str = "Name",
                 admitted: str = "Date_of_Admission", discharged: str = "Discharge_Date",
                 condition: str = "Medical_Condition") -> DataFrame:
    """Admissions followed by another admission of the same patient ``lo..hi`` days after discharge."""
    return flagged.where(F.col("days_until_readmission").between(lo, hi)).select(
        patient, F.col(admitted).alias("current_admission"), F.col(discharged).alias("current_discharge"),
        condition, "next_admission", "days_until_readmission")


def length_of_stay(admitted: str = "Date_of_Admission", discharged: str = "Discharge_Date") -> Column:
    return F.datediff(F.col(discharged), F.col(admitted))


def readmission_counts(df: DataFrame, dims: dict[str, Column], patient: str = "Name",
                       admitted: str = "Date_of_Admission", discharged: str = "Discharge_Date",
                       admission_id: str | None = ADMISSION_ID, lo: int = 1, hi: int = 30,
                       same_person: Callable[[Column], Column] | None = None) -> DataFrame:
    """Admissions ``n`` and readmissions ``hits`` per combination of ``dims`` (name -> expression).

    No join with the rows: every row counts a hit if a same-day next admission would be one, and the last
    row of each day adds or takes what its true next day changes.  That row's values of ``dims`` come
    along as a code (two hashes), which the counted combinations then name."""
    def hit(next_day: str) -> Column:
        return F.coalesce(F.datediff(F.col(next_day), F.col("_e")).between(lo, hi).cast("int"), F.lit(0))

    def code(columns: list[Column], seed: int) -> Column:
        return F.xxhash64(F.lit(seed), row_hash(columns)) if seed else row_hash(columns)

    named = {f"_k{i}": expr for i, expr in enumerate(dims.values())}
    keys = [F.col(k) for k in named]
    values = list(dims.values())
    days = day_table(df, _person(patient, same_person), admitted, admission_id,
                     {"_e": F.col(discharged), "_c": code(values, 0)}, tie_columns(df, patient, admitted, admission_id))
    moved = (days.select("_c", (hit("_next_day") - hit("_d")).alias("h")).where("h <> 0")
             .groupBy("_c").agg(F.sum("h").alias("_moved")))
    every = df.select(*[e.alias(k) for k, e in named.items()], F.col(admitted).alias("_d"), F.col(discharged).alias("_e"))
    counted = every.groupBy(*named).agg(F.count(F.lit(1)).alias("n"), F.sum(hit("_d")).alias("_h"))
    counted = counted.withColumn("_code", code(keys, 0)).join(moved, F.col("_code") == F.col("_c"), "left")
    return counted.select(*[F.col(k).alias(name) for k, name in zip(named, dims, strict=True)], "n",
                          (F.col("_h") + F.coalesce("_moved", F.lit(0))).alias("hits"))


def _with_rate(counts: DataFrame, count_name: str) -> DataFrame:
    return (counts.withColumnsRenamed({"n": count_name, "hits": "readmissions"})
            .withColumn("readmission_rate_percent", pct_half_up(F.col("readmissions"), F.col(count_name))))


def readmission_rate(admissions: DataFrame, dim: Column | str, name: str | None = None,
                     count_name: str = "total_admissions", sort: bool = True, **options) -> DataFrame:
    """Admissions, readmissions and the readmission rate (%, 2 places, half-up) per value of ``dim``.

    The denominator counts every admission of the group, last stays included; NULL keys form a group.
    ``options`` go to ``readmission_counts``."""
    expr = F.col(dim) if isinstance(dim, str) else dim
    out = _with_rate(readmission_counts(admissions, {name or (dim if isinstance(dim, str) else "dim"): expr},
                                        **options), count_name)
    return out.orderBy(F.desc("readmission_rate_percent")) if sort else out


def readmission_rates(admissions: DataFrame, dims: dict[str, Column], **options) -> DataFrame:
    """``dimension, value, total_admissions, readmissions, readmission_rate_percent`` for several
    dimensions from one pass: the flags are computed once, counted per combination of values, and those
    counts are added up per dimension."""
    counts = readmission_counts(admissions, dims, **options)
    each = F.array(*[F.struct(F.lit(name).alias("dimension"), F.col(name).cast("string").alias("value"))
                     for name in dims])
    stacked = counts.select(F.explode(each).alias("k"), "n", "hits").select("k.*", "n", "hits")
    return _with_rate(stacked.groupBy("dimension", "value").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")),
                      "total_admissions")


def rate_from_flags(flagged: DataFrame, dim: Column | str, name: str | None = None,
                    count_name: str = "total_admissions", sort: bool = True) -> DataFrame:
    """Admissions, readmissions and rate per value of ``dim`` over already flagged admissions."""
    key = (F.col(dim) if isinstance(dim, str) else dim).alias(name or (dim if isinstance(dim, str) else "dim"))
    out = _with_rate(flagged.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum("is_readmission").alias("hits")),
                     count_name)
    return out.orderBy(F.desc("readmission_rate_percent")) if sort else out


def rate_by_age(admissions: DataFrame, sort: bool = True, age: str = "Age", **options) -> DataFrame:
    return readmission_rate(admissions, age_group(age), "age_group", "total_patients", sort, **options)


def rate_by_stay(admissions: DataFrame, sort: bool = True, admitted: str = "Date_of_Admission",
                 discharged: str = "Discharge_Date", **options) -> DataFrame:
    return readmission_rate(admissions, stay_length_group(length_of_stay(admitted, discharged)), "stay_length_group",
                            "total_admissions", sort, admitted=admitted, discharged=discharged, **options)
