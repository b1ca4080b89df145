"""Readmission flags kept as a table: every way of adding rows equals one full run."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cohortcart.operators import readmission as RA
from cohortcart.plans import flag_store as store
from cohortcart.plans.inspect import plan_text
from cohortcart.session import scratch_path
from cohortcart.sources import fixtures as FX
from cohortcart.sources.tables import ADMISSIONS_SCHEMA
from tests.conftest import SF_SMALL


def stay(i, name, day, nights=2, condition="Asthma"):
    day = dt.date(2001, 1, 1) + dt.timedelta(days=day) if day is not None else None
    out = day + dt.timedelta(days=nights) if day and nights is not None else None
    return (i, name, 40, "F", "A+", condition, day, "D", "H", "I", Decimal("1.00"), 1, "Urgent", out, "M", "T")


def frame(spark, rows):
    return spark.createDataFrame(rows, ADMISSIONS_SCHEMA)


def rows(df):
    return sorted(map(str, df.collect()))


def assert_full_run(spark, location, all_rows, names=store.Names()):
    full = RA.flag_readmissions(frame(spark, all_rows), same_person=names.same_person)
    kept = store.read(spark, location, names)
    assert kept.columns == full.columns and rows(kept) == rows(full)


@pytest.fixture()
def location(spark):
    return scratch_path(spark, "flags-test")


FIRST = [stay(1, "a", 0), stay(2, "a", 10), stay(3, "b", 5), stay(4, None, 3), stay(5, "c", 7), stay(5, "c", 7)]


def test_a_new_day_reads_tails_of_its_patients_only(spark, location, monkeypatch):
    store.add(frame(spark, FIRST), location)
    assert_full_run(spark, location, FIRST)
    seen, write = {}, store.stored
    monkeypatch.setattr(store, "stored", lambda df, name: seen.setdefault(name, write(df, name)))
    day = [stay(6, "a", 20), stay(7, "d", 20), stay(8, None, 20)]
    assert store.add(frame(spark, day), location) == []
    old = {r["Admission_ID"] for r in seen["touched-rows"].collect()}
    assert old == {2, 4}                                                  # not 1 (closed), not b or c (untouched)
    assert_full_run(spark, location, FIRST + day)


def test_rows_of_the_tails_own_day(spark, location):
    store.add(frame(spark, FIRST), location)
    more = [stay(0, "a", 10), stay(9, "a", 10), stay(5, "c", 7), stay(None, "b", 5), stay(3, "b", 5)]
    assert store.add(frame(spark, more), location) == []
    assert_full_run(spark, location, FIRST + more)


@pytest.mark.parametrize("late", [
    [stay(9, "a", 5)], [stay(9, "a", -5), stay(10, "a", 40)], [stay(9, "a", None)], [stay(9, None, 1), stay(10, "z", 1)]])
def test_late_rows_rebuild_their_buckets_only(spark, location, late):
    store.add(frame(spark, FIRST), location)
    day = [stay(6, "b", 20)]
    store.add(frame(spark, day), location)
    assert len(store.add(frame(spark, late), location)) == 1
    assert_full_run(spark, location, FIRST + day + late)
    again = [stay(30, "a", 60), stay(31, None, 60), stay(32, "b", 60)]
    assert store.add(frame(spark, again), location) == []
    assert_full_run(spark, location, FIRST + day + late + again)


def test_patients_known_without_a_date(spark, location):
    first = [stay(1, "a", None), stay(2, "a", None), stay(3, "b", None), stay(4, "c", 3)]
    store.add(frame(spark, first), location)
    more = [stay(5, "a", 4), stay(6, "c", 9)]
    assert store.add(frame(spark, more), location)
    assert_full_run(spark, location, first + more)
    last = [stay(7, "b", 4), stay(8, "a", 9)]
    store.add(frame(spark, last), location)
    assert_full_run(spark, location, first + more + last)


def test_empty_batches_and_missing_store(spark, location):
    with pytest.raises(ValueError):
        store.read(spark, location)
    assert store.add(frame(spark, []), location) == []
    store.add(frame(spark, FIRST), location)
    assert store.add(frame(spark, []), location) == []
    assert_full_run(spark, location, FIRST)


def test_a_batch_that_died_before_its_ledger_row_is_not_seen(spark, location, monkeypatch):
    store.add(frame(spark, FIRST), location)
    day = [stay(6, "a", 20)]
    with monkeypatch.context() as m:
        m.setattr(store, "_append", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.add(frame(spark, day), location)
    assert_full_run(spark, location, FIRST)
    store.add(frame(spark, day), location)
    assert_full_run(spark, location, FIRST + day)


def test_same_person_and_compaction(spark, location):
    names = store.Names(same_person=F.lower)
    parts = [FIRST, [stay(6, "A", 12), stay(7, "B", 30)], [stay(8, "C", 1)], [stay(9, "a", 50)]]
    for part in parts[:3]:
        store.add(frame(spark, part), location, names)
    store.compact(spark, location, names)
    assert len(store._ledger(spark, location)) == 1
    store.add(frame(spark, parts[3]), location, names)
    assert_full_run(spark, location, sum(parts, []), names)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_batches_in_any_order(spark, location, seed):
    rng = random.Random(seed)
    everything = []
    for k in range(4):
        part = [stay(rng.choice([None, rng.randrange(30)]), rng.choice(["a", "b", "A", None, "e"]),
                     rng.choice([None, *range(12 * k, 12 * k + 20)]), rng.choice([None, 0, 3])) for _ in range(12)]
        store.add(frame(spark, part), location)
        everything += part
    assert_full_run(spark, location, everything)


def test_reports_over_kept_flags(spark, location):
    adm = FX.admissions(spark, SF_SMALL)
    cut = F.lit("1996-06-01").cast("date")
    store.add(adm.where(F.col("Date_of_Admission") < cut), location)
    assert store.add(adm.where(F.col("Date_of_Admission") >= cut), location) == []
    kept = store.read(spark, location)
    assert rows(RA.rate_from_flags(kept, "Medical_Condition")) == rows(RA.readmission_rate(adm, "Medical_Condition"))
    p = plan_text(RA.rate_from_flags(kept, "Medical_Condition"))
    assert "Window" not in p and "SortAggregate" not in p and "Billing_Amount" not in p


def test_rows_are_dealt_once_without_a_day_table(spark, location, monkeypatch):
    """No batch, late or not, goes through the day table and its joins while no patient is crowded."""
    late, day = [stay(9, "a", 5), stay(9, "a", 5), stay(None, "c", 7)], [stay(6, "b", 20), stay(5, "c", 7), stay(7, None, None)]
    with monkeypatch.context() as m:
        m.setattr(store, "flag_readmissions", None)
        m.setattr(store, "BUCKET_ROWS", 0.001)
        for part in (FIRST, day, late):
            store.add(frame(spark, part), location)
    assert_full_run(spark, location, FIRST + day + late)


@pytest.mark.parametrize("bound", [1, 3])
def test_crowded_patients_are_flagged_apart(spark, location, monkeypatch, bound):
    monkeypatch.setattr(store, "CROWDED", bound)
    seen, full = [], store.flag_readmissions
    monkeypatch.setattr(store, "flag_readmissions", lambda df, **o: seen.append(df.count()) or full(df, **o))
    parts = [FIRST, [stay(6, "a", 20), stay(7, None, 20), stay(8, "d", 20)], [stay(9, "a", 5), stay(10, None, 0), stay(8, "d", 20)]]
    for part in parts:
        store.add(frame(spark, part), location)
    assert seen
    assert_full_run(spark, location, sum(parts, []))


def test_generations_that_were_rebuilt_whole_are_not_read_again(spark, location, monkeypatch):
    """Once every bucket was rebuilt, readers open the last generation only and join nothing."""
    monkeypatch.setattr(store, "BUCKETS", 2)
    day, late = [stay(6, "b", 20), stay(7, "f", 20)], [stay(9, p, -5) for p in ("a", "b", "c", "d", "e", "f", None)]
    for part in (FIRST, day):
        store.add(frame(spark, part), location)
    assert store.add(frame(spark, late), location) == [0, 1]
    kept = store.read(spark, location)
    assert len({f.split("flag_version=")[1].split("/")[0] for f in kept.inputFiles()}) == 1
    assert "Join" not in plan_text(kept)
    assert_full_run(spark, location, FIRST + day + late)
    again, one = [stay(30, "a", 60), stay(31, None, 60)], [stay(40, "a", 1)]
    assert store.add(frame(spark, again), location) == []
    assert len(store.add(frame(spark, one), location)) == 1
    assert len(store._ledger(spark, location)) == 3
    assert_full_run(spark, location, FIRST + day + late + again + one)


def test_generations_left_behind_by_several_rebuilds(spark, location, monkeypatch):
    monkeypatch.setattr(store, "BUCKETS", 2)
    everything = [stay(k, p, 10) for k, p in enumerate("abcdefgh")]
    store.add(frame(spark, everything), location)
    at = {r["Name"]: r["b"] for r in frame(spark, everything).select("Name", store.Names().bucket().alias("b")).collect()}
    assert set(at.values()) == {0, 1}
    for b in (0, 1):
        part = [stay(20 + k, p, 5) for k, p in enumerate(at) if at[p] == b]
        assert store.add(frame(spark, part), location) == [b]
        everything += part
        assert_full_run(spark, location, everything)
    assert [r["generation"] for r in store._ledger(spark, location)] == [2, 3]


def test_patients_are_counted_in_crowded_groups_only(spark, location, monkeypatch):
    """Many patients of one hash are not taken for one with many rows."""
    late, day = [stay(9, "a", 5), stay(7, None, None)], [stay(6, "b", 20), stay(8, "d", 20)]
    monkeypatch.setattr(store, "CROWDED", 3)
    seen, write = [], store.stored
    monkeypatch.setattr(store, "stored", lambda df, name: seen.append(name) or write(df, name))
    with monkeypatch.context() as m:
        m.setattr(store, "flag_readmissions", None)
        store.add(frame(spark, FIRST), location)
        assert seen == []
        m.setattr(store, "GROUPS", 1)
        store.add(frame(spark, day), location)
        store.add(frame(spark, late), location)
    assert "crowded" in seen
    assert_full_run(spark, location, FIRST + day + late)
    monkeypatch.setattr(store, "GROUPS", 1)
    more = [stay(50 + k, "a", 60 + k) for k in range(5)]
    store.add(frame(spark, more), location)
    assert "to-flag" in seen
    assert_full_run(spark, location, FIRST + day + late + more)
